"""Collocations against plain counting."""

import re
from collections import Counter, defaultdict

import pytest

from tessitura.llm import collocations
from tests.llm.fixtures import AWKWARD, corpus, frame


def plain(rows, least, first=2000):
    runs, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                runs[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in runs.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return out


MIXED = [
    (1, "New York, new  york\tNEW YORK! new york; in new york city. In New York City", "en", "a"), (2, None, "en", "a"), (3, "a a a a a a a a", None, "a"), (4, "a a a", "und", "b"),
    (5, "Ära ära Ära ära", "de", "a"), (6, "x y z\x00w x y z\x00w", "", "a"), (7, "one,two.three:four", "en", "a"), (8, "... ,,, !!", "fr", "a"),
]


@pytest.mark.parametrize(("rows", "least", "buckets"), [(corpus(4, 240) + AWKWARD, 3, None), (MIXED * 3, 2, 5), (MIXED, 1, 1)])
def test_collocations_are_those_of_plain_counting(spark, rows, least, buckets):
    got = collocations.collocations(frame(spark, rows).repartition(3), least=least, buckets=buckets).collect()
    want = plain(rows, least)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and want


def test_first_of_each_language_and_chunks(spark, monkeypatch):
    rows = corpus(4, 240)
    monkeypatch.setattr(collocations._packer, "__defaults__", (64,))
    got = collocations.collocations(frame(spark, rows), least=2, first=5).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, 2, 5)))
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None, None), (2, " ", "en", "a")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    schema = "lang string, phrase string, words int, f long"
    f = 10**13 + 7
    counts = spark.createDataFrame([("en", "a", 1, f), ("en", "b", 1, f + 12), ("en", "a b", 2, f - 5), ("en", "", 0, 5 * f)], schema)
    original, collocations.phrase_counts = collocations.phrase_counts, lambda *_: counts
    try:
        (row,) = collocations.collocations(frame(spark, [])).collect()
    finally:
        collocations.phrase_counts = original
    assert row.score == 1_000_000 * (f - 5) ** 2 // (f * (f + 12)) and (row.a, row.l, row.r, row.n) == (f - 5, f, f + 12, 5 * f)


def test_a_bucket_counts_out_of_core(spark):
    rows = [(i, " ".join(f"w{(i * 37 + k * 11) % 5000}" for k in range(60)), "en", "a") for i in range(400)]
    small = collocations._counter(2, 24)
    packed = collocations.pieces(frame(spark, rows)).coalesce(1).mapInArrow(collocations._packer(1), "bucket long, packet binary")
    got = packed.mapInArrow(small, collocations._COUNTS).where("words = 1").collect()
    want = Counter(w for _, text, *_ in rows for w in text.split())
    assert {r.phrase: r.f for r in got} == {w: n for w, n in want.items() if n >= 2}
