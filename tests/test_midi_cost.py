"""MIDI files are written and read with few scans and shuffles, and as before."""

from collections import Counter

import pyarrow as pa

from tessitura.operators import events
from tessitura.sources import midi, smf

NOTE = "piece_id long, tick long, channel int, pitch int, velocity int, duration_ticks long"
META = "piece_id long, tick long, kind string, tempo int, numerator int, denominator int"
NOTES = [(1, 0, 0, 60, 80, 480), (1, 480, 1, 62, 70, 0), (1, 480, 0, 60, 90, 100), (1, 480, 0, 60, None, None), (1, 480, 0, 60, 90, 100), (1, 40000, 2, 127, 0, 2100000), (2, 7, 0, 64, 1, 3), (None, 5, 3, 0, 9, -4)]
METAS = [(1, 0, "tempo", 400000, None, None), (1, 0, "time_signature", None, 6, 8), (1, 960, "time_signature", None, 3, 4), (3, 0, "tempo", 500000, None, None)]


def written(key, smf_format):
    """A file by the rules, event by event."""
    rows = [(t, 0, kind, None, None, None, *rest) for k, t, kind, *rest in METAS if k == key]
    for k, t, c, p, v, d in NOTES:
        if k == key:
            rows += [(t, 3, "note_on", c, p, v, None, None, None), (t + max(d or 0, 0), 4 if d is not None and d <= 0 else 2, "note_off", c, p, v, None, None, None)]
    rows.sort(key=lambda r: [-1 if x is None else x for x in r[:6]])
    rows = [(t, kind, c, p, 0 if kind == "note_off" else v, *rest, None) for t, _, kind, c, p, v, *rest in rows]
    head = [r for r in rows if r[1] in ("tempo", "time_signature")]
    return smf.encode(0, 480, [rows]) if smf_format == 0 else smf.encode(1, 480, [head, [r for r in rows if r not in head]])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_files_hold_the_events_of_a_piece_in_writing_order(spark):
    notes, meta = spark.createDataFrame(NOTES, NOTE), spark.createDataFrame(METAS, META)
    for smf_format in (0, 1, 2):
        got = {r.piece_id: bytes(r.content) for r in midi.encoded(notes, meta, 480, smf_format).collect()}
        assert got == {k: written(k, smf_format) for k in (1, 2, 3, None)}


def test_notes_are_read_once_and_shuffled_as_notes(spark):
    notes, meta = spark.createDataFrame(NOTES, NOTE), spark.createDataFrame(METAS, META)
    found = plan(midi.encoded(notes, meta, 480))
    assert found.count("Scan ExistingRDD") == 2 and found.count("Exchange hashpartitioning") == 2
    assert all("phase" not in line for line in found.splitlines() if "Scan ExistingRDD" in line)
    assert found.index("Generate explode") < found.rindex("Exchange hashpartitioning")


def test_notes_are_paired_without_a_join_of_ons_and_offs(spark):
    rows = [("a", 1, 0, 0, 60, 1), ("a", 1, 1, 5, 60, -1), ("a", 1, 2, 6, 60, -1), ("a", 1, 3, 7, 60, 1), ("a", 1, 4, 8, 60, 1), ("a", 1, 5, 9, 60, -1), ("a", 1, 6, 20, 61, -1)]
    rows += [("a", 2, 0, 1, None, 1), ("a", 2, 1, 4, None, -1), (None, 1, 0, 0, 60, 1), (None, 1, 1, 3, 60, -1), ("b", 1, 0, 0, 60, 1), ("b", 1, 1, None, 60, -1), ("b", 1, 2, 2, 60, 1)]
    raw = spark.createDataFrame(rows, "path string, track int, seq int, tick long, data1 int, d int")
    paired = events.pair_notes(raw, ["path", "track", "data1"], ["path", "track"])
    got = Counter((r.path, r.track, r.seq, r.end_seq, r.end_tick, r.duration_ticks) for r in paired.collect())
    # Null parts of a stream have no partner, a null path or track no note; an off without a tick ends with its track.
    assert got == Counter([("a", 1, 0, 1, 5, 5), ("a", 1, 3, 5, 9, 2), ("a", 1, 4, None, 20, 12), ("a", 2, 0, None, 4, 3), ("b", 1, 0, 1, 2, 2), ("b", 1, 2, None, 2, 0)])
    found = plan(paired)
    assert found.count("Scan ExistingRDD") == 2 and found.count("Join") == 1


def test_raw_events_are_read_twice_for_their_notes(spark):
    files = spark.createDataFrame([("1", smf.encode(1, 480, [[], [(0, "note_on", 0, 60, 1, None, None, None, None), (9, "control_change", 0, 1, 1, None, None, None, None)]]))], "path string, content binary")
    raw = spark.createDataFrame(midi.raw_events(files).collect(), midi.RAW_EVENT)
    notes = midi.notes_of(raw)
    assert [(r.tick, r.pitch, r.duration_ticks) for r in notes.collect()] == [(0, 60, 9)]
    assert plan(notes).count("Scan ExistingRDD") == 2


def test_batches_name_each_event_by_its_file():
    track = [(0, "tempo", None, None, None, 500000, None, None, None), (3, "note_on", 2, 60, 7, None, None, None, None)]
    content = [smf.encode(0, 480, [track]), b"no midi", smf.encode(0, 480, [track])]
    found = pa.Table.from_batches(midi.event_batches(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b", None]), pa.array(content)], ["path", "content"])])))
    assert found.column("path").to_pylist() == ["a"] * 3 + [None] * 3
    assert found.column("kind").to_pylist() == ["tempo", "note_on", "end_of_track"] * 2
    assert found.column("channel").to_pylist() == [None, 2, None] * 2 and found.column("seq").to_pylist() == [0, 1, 2] * 2
    assert found.schema.names == [f.name for f in midi.RAW_EVENT]


def test_events_of_named_kinds_alone_become_rows(spark):
    track = [(0, "tempo", None, None, None, 500000, None, None, None), (3, "note_on", 2, 60, 7, None, None, None, None), (3, "program_change", 2, 5, None, None, None, None, None)]
    whole = smf.encode(1, 480, [track[:1], track])
    torn = whole[:-3] + b"\xff\x51\x09"  # its last event goes past the end, after a tempo
    files = spark.createDataFrame([("a", whole), ("b", torn), (None, whole), ("d", smf.encode(0, 480, [[]]))], "path string, content binary")
    found = midi.raw_events(files, midi.META_KINDS)
    assert {r.kind for r in found.collect()} == {"tempo", "program_change"}
    every = Counter(midi.meta_of(midi.raw_events(files)).collect())
    assert Counter(midi.meta_of(found).collect()) == every and sum(every.values()) == 6


def test_meta_events_leave_the_decoder_without_notes(spark, sf_dir):
    from tessitura.queries import QUERIES

    seen, raw_events = [], midi.raw_events

    def counted(files, *kinds):
        seen.append(raw_events(files, *kinds))
        return seen[-1]

    midi.raw_events = counted
    try:
        found = QUERIES["midi_meta_round_trip"](spark, sf_dir)
    finally:
        midi.raw_events = raw_events
    assert seen[0].count() == found.count() > 0
