"""Operators on hand-made scores with known answers, and on random ones."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.operators import contracts, evaluation, events, features, histograms, intervals, melody, meter, pianoroll, profiles, resampling, similarity, tasks, transform

NOTE = "piece_id long, tick long, channel int, pitch int, velocity int, duration_ticks long"
METER = "piece_id long, tick long, numerator int, denominator int"
FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def notes(spark, rows, piece=1):
    return spark.createDataFrame([(piece, t, 0, p, 80, d) for t, p, d in rows], NOTE)


def meters(spark, rows=((0, 4, 4),), piece=1):
    return spark.createDataFrame([(piece, *r) for r in rows], METER)


SCORE = [(0, 60, 480), (0, 64, 960), (480, 62, 240), (960, 67, 480)]


def test_composition_features_of_a_small_score(spark):
    v = features.composition_vector(notes(spark, SCORE), meters(spark), 480).first()
    assert len(features.COMPOSITION_FEATURES) == 93
    expected = {
        "pitch_range": 7, "ascending_interval_ratio": 0.5, "descending_interval_ratio": 0.5, "downbeat_onset_ratio": 1 / 3, "metrical_pulse_onset_ratio": 1,
        "mean_polyphony": 1.5, "max_polyphony": 2, "chord_onset_ratio": 1 / 3, "chord_consonance_ratio": 1,
    }
    for name, value in expected.items():
        assert v[name] == pytest.approx(value), name


def test_offbeat_and_syncopation(spark):
    v = features.rhythm_features(notes(spark, [(240, 60, 360), (720, 64, 240)]), meters(spark), 480).first()
    assert v.offbeat_onset_ratio == 1 and v.syncopated_note_ratio == 0.5


def test_degenerate_pieces_have_features(spark):
    for rows in ([(0, 60, 0)], [(0, 60, 0), (0, 64, 0), (0, 64, 0)], [(5, 0, 1)]):
        v = features.composition_vector(notes(spark, rows), meters(spark), 480).first()
        assert all(x is not None and math.isfinite(x) for x in v[1:])


def test_a_piece_without_notes_is_neutral(spark):
    pieces = spark.createDataFrame([(1,), (2,)], "piece_id long")
    tempo = spark.createDataFrame([(1, 0, 500000)], "piece_id long, tick long, tempo int")
    rows = {r.piece_id: r for r in features.legacy_vector(pieces, notes(spark, SCORE), tempo, 480).collect()}
    assert rows[2].tempo_bpm == 120 and rows[2].rest_ratio == 1 and rows[2].key_name == "C major" and rows[2].pitch_class_3 == pytest.approx(1 / 12)
    assert rows[1].tempo_bpm == 120 and rows[1].rest_ratio == 0


spans = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=25)


@FEW
@given(spans)
def test_interval_union_and_sweep_against_counting(spark, rows):
    df = notes(spark, [(t, 60, d) for t, d in rows])
    active = {x for t, d in rows for x in range(t, t + d)}
    end = max(t + d for t, d in rows)
    got = intervals.rest_ratio(df).first()
    assert got.active == len(active) and got.rest_ratio == pytest.approx(1 - len(active) / end if end else 0)
    voices = intervals.polyphony(df).collect()
    most = max((sum(t <= x < t + d for t, d in rows) for x in active), default=0)
    assert (voices[0].max_polyphony if voices else 0) == most
    if voices:
        assert voices[0].area == sum(d for _, d in rows)


@FEW
@given(st.lists(st.sampled_from([1, -1]), min_size=1, max_size=40))
def test_fifo_pairing_against_a_queue(spark, signs):
    df = spark.createDataFrame([(1, i, i, d) for i, d in enumerate(signs)], "f int, seq int, tick int, d int")
    got = {(r.seq, r.end_tick) for r in events.pair_notes(df, ["f"], ["f"]).collect()}
    queue, want = [], set()
    for i, d in enumerate(signs):
        if d == 1:
            queue.append(i)
        elif queue:
            want.add((queue.pop(0), i))
    assert got == want | {(i, len(signs) - 1) for i in queue}


@FEW
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=20))
def test_frame_cleanup_against_a_walk(spark, cells):
    frames, onsets = {s for s, _ in cells}, {s for s, o in cells if o}
    make = lambda x: spark.createDataFrame([(1, 60, s) for s in sorted(x)], "piece_id long, pitch int, step long")
    got = {r.step for r in pianoroll.frame_cleanup(make(frames), make(onsets)).collect()}
    active, want = False, set()
    for s in range(14):
        active = s in frames and (active or s in onsets)
        if active:
            want.add(s)
    assert got == want


def test_bars_follow_meter_changes_and_end_with_the_piece(spark):
    ends = spark.createDataFrame([(1, 7000)], "piece_id long, end_tick long")
    got = meter.bars(meters(spark, [(0, 4, 4), (3840, 3, 4)]), ends, 480).orderBy("bar_start").collect()
    assert [(r.bar_start, r.bar_end) for r in got] == [(0, 1920), (1920, 3840), (3840, 5280), (5280, 6720), (6720, 7000)]
    assert meter.length_in_bars(meters(spark, [(0, 4, 4), (3840, 3, 4)]), ends, 480).first().length_bars == pytest.approx(2 + 3160 / 1440)


def test_meter_default_and_bad_signatures(spark):
    none = meters(spark, [(100, 3, 0)])
    row = meter.with_meter(notes(spark, [(500, 60, 1)]), none).first()
    assert (row.numerator, row.denominator, row.segment_tick) == (4, 4, 0)
    assert meter.meter_problems(meters(spark, [(0, 4, 4), (1, 3, 0), (2, 5, 6), (3, 4, 8)]), 480).count() == 2


def test_key_of_a_scale(spark):
    scale = notes(spark, [(i * 10, p, 10) for i, p in enumerate((60, 62, 64, 65, 67, 69, 71, 72, 60, 67, 64))])
    shares = histograms.histogram(scale, F.pmod("pitch", F.lit(12)), 12)
    assert histograms.estimated_key(shares).first().key_name == "C major"


def test_global_transformation_rounds_half_even_and_drops(spark):
    got = transform.transform_notes(notes(spark, [(5, 60, 5), (3, 120, 1)]), transpose=10, density=0.5, duration=0.5, velocity=60).collect()
    assert [(r.tick, r.pitch, r.duration_ticks, r.velocity) for r in got] == [(2, 70, 2, 127)]


VOICES = [(t, p, d) for i, t in enumerate((0, 480, 960, 1440)) for p, d in (((48, 50, 52, 53)[i], 240), ((72, 74, 76, 77)[i], 480))]


def _local(spark, **genome):
    structured = features.structured_notes(notes(spark, VOICES), meters(spark), 480)
    onset = F.array(*[F.lit(float(i == 8)) for i in range(16)])
    length = F.array(*[F.lit(float(i == 2)) for i in range(6)])
    return transform.local_transform(structured, onset, length, F.lit(6), genome, 480, seed=3).collect()


def test_local_transformation_keeps_the_melody(spark):
    same = {(r.tick, r.pitch, r.duration_ticks) for r in _local(spark)}
    assert same == set(VOICES)
    moved = _local(spark, rhythm=1.0, duration=1.0, transpose=2)
    melody_notes = {(r.tick, r.pitch - 2, r.duration_ticks) for r in moved if r.pitch >= 70}
    assert melody_notes == {v for v in VOICES if v[1] >= 70}
    assert {r.tick for r in moved if r.pitch < 70} == {1020}
    assert {r.duration_ticks for r in moved if r.pitch < 70} == {360}


def test_local_transformation_thins_doubles_and_cancels(spark):
    assert len(_local(spark, thin=1.0)) == 4
    assert len(_local(spark, double=1.0)) == 12
    assert {r.pitch for r in _local(spark, transpose=60)} == {v[1] for v in VOICES}


def test_content_metrics_of_identical_pieces(spark):
    n = notes(spark, [(0, 60, 480), (480, 64, 480)])
    m = similarity.content_metrics(n, n, meters(spark), 480).first()
    assert m.length_error == 0 and m.onset_f1 == 1 and m.melody_trigram_jaccard == 1 and m.chroma_cosine == pytest.approx(1)


def test_greedy_onsets_take_the_nearest_unused(spark):
    a, b = notes(spark, [(0, 60, 1), (20, 60, 1)]), notes(spark, [(10, 60, 1), (100, 60, 1)])
    assert similarity.onset_f1(a, b, 30).first().onset_f1 == pytest.approx(0.5)
    assert similarity.onset_exact_f1(a, a).first().onset_f1 == 1


def test_ambiguous_pairs_are_semantically_equal(spark):
    a = notes(spark, [(0, 60, 480), (0, 60, 0)])
    b = notes(spark, [(0, 60, 0), (0, 60, 480)])
    c = notes(spark, [(0, 60, 1), (0, 60, 480)])
    assert similarity.semantic_equal(a, b).first().semantic_equal
    assert not similarity.semantic_equal(a, c).first().semantic_equal


def test_constraints_name_what_is_broken(spark):
    source = melody.melody_flags(notes(spark, VOICES))
    limit = spark.createDataFrame([(1, 4)], "piece_id long, limit int")
    report = lambda out: similarity.constraint_report(source, out, 0, limit, 480).first()
    assert report(notes(spark, VOICES)).feasible
    assert set(report(notes(spark, VOICES[:4])).violations) == {"melody", "length", "note_count"}


def test_grouped_folds_keep_groups_and_spread_labels(spark):
    groups = spark.createDataFrame([(g, f"c{g % 3}", 1 + g % 4) for g in range(30)], "group_id int, label string, n long")
    folds = contracts.grouped_folds(groups, 5, 3, seed=1).collect()
    assert len({(r.repeat, r.group_id) for r in folds}) == len(folds) == 90
    for repeat in range(3):
        for label in ("c0", "c1", "c2"):
            assert len({r.fold for r in folds if r.repeat == repeat and r.label == label}) == 5


def test_leakage_names_the_field(spark):
    train = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "sample_id int, group_id string, sha string")
    test = spark.createDataFrame([(3, "a", "z"), (4, "c", "y")], "sample_id int, group_id string, sha string")
    got = {(r.field, r.value) for r in contracts.leakage(train, test, ["sample_id", "group_id", "sha"], []).collect()}
    assert got == {("group_id", "a"), ("sha", "y")}


def test_metrics_of_a_known_confusion(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] * 2
    df = spark.createDataFrame(rows, "true_label string, predicted_label string")
    got = evaluation.summary_metrics(df, []).first()
    assert got.balanced_accuracy == pytest.approx((0.75 + 1 + 0) / 3) and got.macro_f1 == pytest.approx((2 / 3 + 0.8 + 0) / 3)


def test_special_functions():
    assert resampling.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert resampling.student_quantile(0.95, 9) == pytest.approx(2.262157, abs=1e-5)
    assert resampling.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)


def test_holm_steps_down(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    got = {r.k: r.p_adjusted for r in resampling.holm(df, "p", "k").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert resampling.safe_correlation(df, "x", "y").first().r is None


def test_mahalanobis_survives_a_singular_covariance(spark):
    import numpy as np

    inverse = profiles.pseudo_inverse(np.array([[1.0, 1.0], [1.0, 1.0]]))
    df = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(profiles.mahalanobis(F.col("a"), F.col("b"), inverse).alias("d")).first().d == pytest.approx(1.0)


def test_resuming_leaves_what_is_not_done(spark):
    sources = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "fold int, source_id long, source_label string")
    matrix = tasks.task_matrix(sources, spark.createDataFrame([("a",), ("b",), ("c",)], "label string"), "full")
    assert matrix.count() == 4
    results = matrix.limit(1).withColumn("status", F.lit("completed"))
    assert tasks.pending(matrix, results).count() == 3


def test_ranking_prefers_feasible(spark):
    df = spark.createDataFrame([(1, True, 0.1, 0.0), (2, False, 9.0, 2.0), (3, True, 0.3, 0.0)], "id int, f boolean, g double, v double")
    key = tasks.ranking_key(F.col("f"), F.col("g"), F.col("v"))
    assert [r.id for r in df.orderBy(key.desc()).collect()] == [3, 1, 2]


def test_frames_where_a_bar_has_fewer_ticks_than_cells(spark):
    """Cells without ticks share their start with one that has some."""
    from tessitura.operators import segments

    bars = spark.createDataFrame([(1, 0, 0, 10)], "piece_id long, bar_index int, bar_start long, bar_end long")
    notes = spark.createDataFrame([(1, 60, 9, 1), (1, 62, 0, 10)], "piece_id long, pitch int, tick long, duration_ticks long")
    want = [(60, 15, True), *((62, k, k == 0) for k in range(16))]
    for up in (True, False):
        cells = segments.grid(bars).coalesce(1).sortWithinPartitions(F.col("step").asc() if up else F.col("step").desc())
        got = segments.frame_cells(notes, cells)
        assert sorted((r.pitch, r.step, r.onset) for r in got.collect()) == want
