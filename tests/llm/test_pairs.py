"""Exact copies, the Jaccard join, decontamination: against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tessitura.llm import decontaminate, exact_dedup, jaccard_join
from tessitura.llm.components import components
from tests.llm.fixtures import AWKWARD, corpus, frame, words


def brute_copies(rows):
    groups = defaultdict(list)
    for at, (i, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), i is None, i or 0, at))
    want = {}
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            want[m[3]] = (rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return list(want.values()), len(groups)


@pytest.mark.parametrize("copies", [0, 400])
def test_exact_duplicates(spark, copies):
    rows = corpus(1) + AWKWARD + [(5000 + i, "hot  text" if i % 3 else "hot text", "en", "a") for i in range(copies)]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    want, groups = brute_copies(rows)
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(repr, want))
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_plan_has_no_python_and_one_content_shuffle(spark):
    df = exact_dedup.exact_duplicates(frame(spark, corpus(1)))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for a in range(len(rows)):
        ids[find(a)].append(rows[a][0])
    return [(rows[a][0], len(sets[a]), min((i for i in ids[find(a)] if i is not None), default=None)) for a in range(len(rows))]


def test_near_duplicates_at_the_threshold(spark):
    """Families of edited texts: n-grams of a pair fall into the same fragment
    of the order whatever else their texts hold."""
    draw = random.Random(1)
    rows = []
    for family in range(40):
        base = [f"w{family}_{i}" for i in range(draw.randrange(3, 60))]
        for _ in range(8):
            text = list(base)
            for _ in range(draw.randrange(3)):
                at, kind = draw.randrange(len(text)), draw.randrange(3)
                if kind == 0:
                    text[at] = f"x{draw.random()}"
                elif kind == 1:
                    text = text[: at + 1]
                else:
                    text.append(f"y{draw.random()}")
            rows.append((len(rows), " ".join(text), "en", "a"))
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


@pytest.mark.parametrize(("seed", "n"), [(2, 60), (3, 120)])
def test_near_duplicates(spark, seed, n):
    rows = corpus(seed, n) + AWKWARD
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, brute_components(rows)))


def test_near_duplicates_of_a_large_group_of_variants(spark):
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in range(i % 5):
            w[(i * 7 + k * 19) % 90] = f"v{i}_{k}"
        rows.append((i, " ".join(w), "en", "a"))
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard_join.near_duplicates(frame(spark, [(1, None, None, None)])).collect() == [(1, 0, 1)]


def test_hot_ngrams_bypass_their_fragment(spark, monkeypatch):
    """Few sets make an n-gram hot here; the components stay the same."""
    rows = [(i, " ".join(f"c{k}" for k in range(30)) + " " + " ".join(f"u{i}_{k}" for k in range(i % 9)), "en", "a") for i in range(80)]
    got = jaccard_join.near_duplicates(frame(spark, rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_template_kinds():
    from tessitura.llm.common import WordTable

    known = WordTable(decontaminate._fact, 2)
    _, _, kind = decontaminate.template(b"Anna has 5 kg. Then Bob sees Carl, 3.5 apples and kg", known)
    assert kind.tolist() == [3, 0, 1, 2, 3, 3, 0, 3, 1, 0, 0, 0]


QUESTION = "On Monday the driver Anna carries 12 kg of apples from Paris to Rome and sells 12 of them before noon"


def run_leaks(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string, hash int")
    found = decontaminate.contaminated(frame(spark, docs), bench).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_contamination_finds_copies_and_new_parameters(spark):
    changed = QUESTION.replace("12", "40").replace("Anna", "Olga").replace("kg", "lb")
    broken = QUESTION.replace("carries 12", "carries 40")
    clean = " ".join(f"word{i}" for i in range(60))
    docs = [
        (1, f"some text before. {QUESTION} and after", "en", "a"), (2, f"intro words here {changed}. more", "en", "a"), (3, f"intro words here {broken} more", "en", "a"), (4, clean, "en", "a"),
        (5, "On Monday the driver", "en", "a"), (6, None, None, None), (7, QUESTION.upper(), "en", "a"), (1, QUESTION, "en", "a"), (None, QUESTION, "en", "a"), *AWKWARD[1:4],
    ]
    got = run_leaks(spark, docs, [(10, QUESTION, 1), (11, None, 1), (12, "", 1), (13, "On Monday the driver", 1), (None, QUESTION, 1)])
    assert set(got) == {(1, 10), (2, 10), (1, 13), (2, 13), (3, 13), (5, 13)}
    assert got[2, 10].n_slots >= 3


def test_contamination_of_nothing(spark):
    assert run_leaks(spark, [], [(1, QUESTION, 1)]) == {}
    assert run_leaks(spark, [(1, QUESTION, "en", "a")], []) == {}


def test_same_rows_as_sql(spark, sf_dir):
    from tessitura.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf_dir)
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*rel.columns).collect()))) == sorted(map(repr, rel.fetchall()))


def pages_of_one_template(n, own=1):
    """Texts of 34 words that differ in words of their own, none similar."""
    return [(i, " ".join([f"t{k}" for k in range(17)] + [f"own{i}_{k}" for k in range(own)] + [f"t{k}" for k in range(17, 34 - own)]), "en", "a") for i in range(n)]


@pytest.mark.parametrize("own", [1, 2])
def test_pages_of_one_template_meet_nobody(spark, monkeypatch, own):
    tested, seen = [], []
    verified, meetings = jaccard_join._verified, jaccard_join.meetings
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets: (tested.append(pairs.count()), verified(pairs, sets))[1])
    monkeypatch.setattr(jaccard_join, "meetings", lambda known: (seen.append(known.count()), meetings(known))[1])
    got = jaccard_join.near_duplicates(frame(spark, pages_of_one_template(300, own))).collect()
    assert len(got) == 300 and all(r.doc_id == r.component_id for r in got)
    assert sum(tested) == sum(seen) == 0


def test_mixed_lengths_of_one_bucket_meet_by_class_and_place(spark):
    """Random unions of a few passages: many shared n-grams, few similar sets."""
    import random

    rng = random.Random(4)
    passages = [" ".join(f"p{k}_{j}" for j in range(rng.randint(9, 40))) for k in range(12)]
    rows = [(i, " ".join(rng.sample(passages, rng.randint(2, 9))), "en", "a") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail" * (i % 3), "en", "a") for i in range(0, 120, 4)]
    got = jaccard_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_classes_of_length_hold_what_can_be_similar():
    starts = jaccard_join._length_starts()
    of = lambda n: sum(s <= n for s in starts)
    for n in [*range(1, 400), *(s + d for s in starts[5:60] for d in (-1, 0, 1))]:
        assert of(5 * n // 4) - of(n) in (0, 1)


def test_overlaps_are_counted_by_fragments_of_the_order(spark):
    order = lambda df, s: spark.range(1).select(jaccard_join._order(jaccard_join.F.lit(df), jaccard_join.F.lit(s).cast("long"))).first()[0]
    ordered = [(2, -(2**63)), (2, -5), (2, 2**63 - 1), (3, -(2**63)), (9, 4), (jaccard_join.MOST, -(2**62)), (jaccard_join.MOST, 2**62)]
    places = [order(*x) for x in ordered]
    assert places == sorted(places) and len(set(places)) >= len(places) - 1


def test_many_ranges_are_dealt_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAN", 4)
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rows = corpus(3, 120) + AWKWARD
    got = jaccard_join.near_duplicates(frame(spark, rows).repartition(3), ranges=37).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(repr, brute_components(rows)))


def test_a_batch_walks_only_the_ranges_that_it_meets():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(500)]
    sigs = list(range(500))

    def took(ranges):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            rows = list(jaccard_join._batch_rows(sets, sigs, ranges, 1, -(-ranges // jaccard_join.FAN)))
            best = min(best, time.perf_counter() - began)
        return best, len(rows)

    (few, _), (many, rows) = took(4_000), took(12_500_000)
    assert many < 2 * few + 0.05 and rows <= jaccard_join.FAN + 1
