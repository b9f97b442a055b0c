"""Decontamination: conflicting values, letter case, windows with few literal words."""

from tessitura.llm import decontaminate
from tests.llm.fixtures import frame
from tests.llm.test_pairs import QUESTION


def leaks(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string, hash int")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs), bench, **options).collect()}


TAIL = " while rain fell softly on the old stone bridge and nobody came to see the river rise again"
ROLES = "a boy who has 2 apples walks to the market and there he buys 2 more before he walks home again"


def test_contamination_with_a_conflicting_value_keeps_the_other_windows(spark):
    docs = [(1, (QUESTION + TAIL + TAIL).replace("carries 12", "carries 40"), "en", "a"), (2, "clean words only, of no question at all, in a row", "en", "a")]
    assert set(leaks(spark, docs, [(10, QUESTION + TAIL + TAIL, 1)])) == {(1, 10)}


def test_lenient_contamination_in_any_case_and_role(spark):
    docs = [(1, QUESTION.upper(), "en", "a"), (2, QUESTION.lower(), "en", "a"), (3, QUESTION.replace("carries 12", "carries 40"), "en", "a"), (4, ROLES.replace("has 2", "has 3").replace("buys 2", "buys 5"), "en", "a"),
            (5, "ÄPFEL UND BIRNEN ÜBER ALLEM IM SCHÖNEN GARTEN", "de", "a"), (6, "the driver carries 12 of them before noon", "en", "a")]
    items = [(10, QUESTION, 1), (11, ROLES, 1), (12, "Äpfel und Birnen über allem im schönen Garten", 1)]
    assert set(leaks(spark, docs, items, lenient=True)) == {(1, 10), (2, 10), (3, 10), (4, 11), (5, 12)}


def test_items_with_few_literal_words(spark):
    sums, names = "12 + 7 = 19; 3 * 14 = 42; 90 / 6 = 15; 8 - 11 = -3", "Anna Karenina Alexei Vronsky Konstantin Levin Kitty Oblonsky Dolly Betsy"
    few = names + " went to the old station and waited there " + names
    docs = [(1, f"see {sums} here", "en", "a"), (2, f"with {names} in it", "en", "a"), (3, sums.replace("1", "5"), "en", "a"), (4, "she went to the old station and waited there alone", "en", "a"), (5, few, "en", "a"), (6, QUESTION.replace("12", "40").replace("Anna", "Olga"), "en", "a")]
    got = leaks(spark, docs, [(10, sums, 1), (11, names, 1), (12, few, 1), (13, QUESTION, 1)])
    assert set(got) == {(1, 10), (2, 11), (5, 11), (5, 12), (6, 13)}
    assert (got[5, 12].n_windows, got[5, 12].n_matched) == (21, 21) and got[6, 13].coverage == 1


def test_short_items_match_whole_texts_only(spark):
    docs = [(1, "the", "en", "a"), (2, "over the hill and far away", "en", "a"), (3, " The. ", "en", "a"), (4, "as is well known here", "en", "a")]
    assert set(leaks(spark, docs, [(10, "the", 1), (11, "is well known here", 1)])) == {(1, 10), (3, 10), (4, 11)}


SHARED = "the red boat of {} carries {} barrels to the far island while our blue ship from {} brings {} crates over to the near shore"


def test_values_are_one_for_one_both_ways_and_over_inserted_words(spark):
    item = SHARED.format("Anna", 12, "Bob", 15)
    both = SHARED.format("Olga", 40, "Olga", 40)  # two benchmark values on one: no longer one for one
    other = SHARED.format("Olga", 40, "Carl", 55)
    late = other.replace("far island", "far quiet island")
    torn = late.replace("Carl", "Olga").replace("55", "40")
    got = leaks(spark, [(1, both, "en", "a"), (2, other, "en", "a"), (3, late, "en", "a"), (4, torn, "en", "a")], [(10, item, 1)], coverage=0.01)
    assert got[2, 10].coverage == 1 and got[2, 10].n_slots == 4
    assert got[3, 10].n_matched == got[3, 10].n_windows - 7 and got[3, 10].n_slots == 4
    assert all(got[k].n_slots == 0 and got[k].coverage < 0.3 for k in got if k[0] in (1, 4))
    # The majority stays when lenient; ties go to the greater string.
    assert set(leaks(spark, [(2, other, "en", "a"), (3, late, "en", "a")], [(10, item, 1)], lenient=True)) == {(2, 10), (3, 10)}


def brute(doc, item, width=8):
    """Windows of the item that stand in the document word for word, by case-blind words."""
    a, b = doc.lower().split(), item.lower().split()
    held = {tuple(a[i : i + width]) for i in range(len(a) - width + 1)}
    return sum(tuple(b[i : i + width]) in held for i in range(len(b) - width + 1)), len(b) - width + 1


def test_plain_words_against_brute_force(spark):
    import random

    rng = random.Random(2)
    vocab = [f"w{k}x" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(9, 30))), 1) for k in range(12)]
    docs = []
    for i in range(60):
        w = items[i % 12][1].split()
        del w[rng.randrange(len(w))]
        w[rng.randrange(len(w)) : rng.randrange(len(w))] = [rng.choice(vocab)]
        docs.append((i, " ".join(vocab[:3] + w), "en", "a"))
    want = {}
    for i, text, *_ in docs:
        for k, item, _ in items:
            n, of = brute(text, item)
            if n and n / of >= 0.5:
                want[i, k] = (n, of)
    for lenient in (False, True):
        got = leaks(spark, docs, items, lenient=lenient)
        assert {k: (r.n_matched, r.n_windows) for k, r in got.items()} == want


def test_chants_meet_as_runs(spark):
    """Repeated words make few rows, and the same matches as before."""
    from tests.llm.fixtures import frame

    chant = "ha " * 8000
    docs = frame(spark, [(1, chant, "en", "a"), (2, "ha " * 40 + "and so " + "ha " * 300, "en", "a"), (3, "no such word in this one at all here", "en", "a")])
    items = spark.createDataFrame([(10, "ha " * 800), (11, "ha " * 20), (12, "ho " * 30)], "item_id long, text string")
    seen = []
    original = decontaminate.staged

    def counting(df):
        table = original(df)
        seen.append(table.count())
        return table

    decontaminate.staged = counting
    try:
        got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched) for r in decontaminate.contaminated(docs, items).collect()}
    finally:
        decontaminate.staged = original
    assert got == {(1, 10): (793, 793), (1, 11): (13, 13), (2, 10): (793, 793), (2, 11): (13, 13)}
    assert max(seen) < 100


def brute_leaks(docs, items, width=8, coverage=0.5):
    """Pairs whose literal words agree and whose numbers are one for one along
    each alignment; for texts of lower-case words and numbers, mostly words."""
    found = set()
    for i, text in docs:
        d = text.split()
        for j, item in items:
            b = item.split()
            at = {k for k in range(len(b) - width + 1) if 2 * sum(not w.isdigit() for w in b[k : k + width]) >= width}
            matched = set()
            meets = [(k, p) for k in at for p in range(len(d) - width + 1) if all(x == y or (x.isdigit() and y.isdigit()) for x, y in zip(b[k : k + width], d[p : p + width], strict=True))]
            shifts = sorted({p - k for k, p in meets})
            passage, here = {}, 0
            for n, x in enumerate(shifts):
                here += n > 0 and x - shifts[n - 1] > width
                passage[x] = here
            for line in set(passage.values()):
                mine = [(k, p) for k, p in meets if passage[p - k] == line]
                pairs = {(x, y) for k, p in mine for x, y in zip(b[k : k + width], d[p : p + width], strict=True) if x.isdigit()}
                bad = {q for q in pairs for r in pairs if q != r and (q[0] == r[0] or q[1] == r[1])}
                matched |= {k for k, p in mine if not bad & {(x, y) for x, y in zip(b[k : k + width], d[p : p + width], strict=True) if x.isdigit()}}
            if at and len(matched) >= coverage * (len(b) - width + 1):
                found.add((i, j))
    return found


def test_templates_and_slots_are_those_of_brute_force(spark):
    import random

    from tests.llm.fixtures import frame

    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in "bdfgklm" for b in ("ab", "el", "in", "or")]
    word = lambda: str(rng.randint(2, 60)) if rng.random() < 0.15 else rng.choice(vocab)
    items = [(j, " ".join(word() for _ in range(rng.randint(24, 60)))) for j in range(12)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(10, 40))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            part = part[rng.randint(0, 12) :]
            values = {x: str(rng.randint(100, 999)) for x in part if x.isdigit()} if rng.random() < 0.7 else {}
            part = [values.get(x, x) if rng.random() < 0.97 else word() for x in part]
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, [(i, t, "en", "a") for i, t in docs]), bench).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 15 and got == want
