"""Mixing by row: null and repeated doc_ids, sources that are small beside the corpus."""

from collections import Counter

import corpus_pipeline
from tessitura.llm import mixing
from tests.llm.fixtures import AWKWARD, corpus, frame


def test_stage_mixing_repeats_every_row_by_its_own_words(spark):
    rows = corpus(12, 120) + AWKWARD[:10] + [(i % 5, f"other text {i} of a repeated id", "en", "abc"[i % 3]) for i in range(60)] + [(None, f"a row without id {i}", "en", "a") for i in range(40)]
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    want, got = Counter(), Counter(map(tuple, corpus_pipeline.mixing(spark, docs, "").collect()))
    for r in mixing.mix_sources(docs, keep=corpus_pipeline.COLUMNS).collect():
        times = int(r.taken / r["size"] + 0.5) if r["size"] else 0
        want[tuple(r[c] for c in corpus_pipeline.COLUMNS)] += times
    assert got == +want
    assert any(r[0] is None for r in got)
    by_row = Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(docs).collect())
    assert by_row == Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(docs, keep=corpus_pipeline.COLUMNS).collect())


def test_small_sources_meet_their_targets_beside_a_large_one(spark, monkeypatch):
    """With few slots, a block of the whole is longer than a small source."""
    monkeypatch.setattr(mixing, "SLOTS", 32)
    rows = [(i, "word " * 100, "en", "z") for i in range(600)] + [(1000 + i, "word " * 500, "en", f"s{i % 12:02}") for i in range(48)]
    source, taken, target = {r[0]: r[3] for r in rows}, Counter(), {}
    for r in mixing.mix_sources(frame(spark, rows)).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    off = {s: (taken[s], t) for s, t in target.items() if abs(taken[s] - t) > 0.06 * t}
    assert len(target) == 13 and not off
