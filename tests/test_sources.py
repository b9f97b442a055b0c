import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.sources import midi, smf, tables

TRACK = [(0, "tempo", None, None, None, 500000, None, None, None), (0, "time_signature", None, None, None, None, 3, 4, None), (0, "key_signature", None, None, None, None, None, None, "C# minor"),
         (0, "note_on", 0, 60, 80, None, None, None, None), (480, "note_off", 0, 60, 0, None, None, None, None), (480, "note_on", 0, 62, 90, None, None, None, None)]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_decoding_never_crashes(raw):
    for data in (raw, smf.encode(0, 480, [TRACK])[: 14 + len(raw) % 40] + raw):
        try:
            smf.decode(data)
        except smf.SmfError as e:
            assert 0 <= e.offset <= len(data)


def test_bytes_and_events_round_trip():
    kind, division, found = smf.decode(smf.encode(0, 480, [TRACK]))
    assert (kind, division) == (0, 480)
    assert [(e[1], *e[2:]) for _, e in found][:-1] == TRACK
    assert found[-1][1][2] == "end_of_track"


@pytest.mark.parametrize(("raw", "message"), [(b"", "no MThd header"), (b"MThd\0\0\0\6\0\0\0\2\1\xe0", "format 0 must have one track"), (b"MThd\0\0\0\6\0\1\0\1\1\xe0", "fewer tracks than announced"), (b"MThd\0\0\0\6\0\1\0\1\1\xe0MTrk\0\0\0\x09", "chunk goes past the end")])
def test_structure_errors_are_named(raw, message):
    with pytest.raises(smf.SmfError, match=message):
        smf.decode(raw)


def write(folder, name, raw):
    (folder / name).write_bytes(raw)


def test_scan_pairs_notes_and_reports_bad_files(spark, tmp_path):
    write(tmp_path, "a.mid", smf.encode(1, 480, [TRACK[:3], TRACK[3:]]))
    write(tmp_path, "b.midi", b"no midi")
    write(tmp_path, "c.txt", b"")
    files = midi.midi_files(spark, str(tmp_path))
    checked = {r.path.rsplit("/", 1)[1]: r for r in midi.checked_files(files).collect()}
    assert set(checked) == {"a.mid", "b.midi"} and checked["a.mid"].ok and checked["b.midi"].error == "no MThd header"
    raw = midi.raw_events(files)
    got = sorted((r.tick, r.pitch, r.velocity, r.duration_ticks) for r in midi.notes_of(raw).collect())
    assert got == [(0, 60, 80, 480), (480, 62, 90, 0)]
    probe = midi.probe(files).first()
    assert probe.tracks == 2 and probe.duration_s == pytest.approx(0.5)
    assert {r.problem for r in midi.input_problems(files).collect()} == {"unreadable"}
    assert midi.described(files).where("notes IS NOT NULL").count() == 1
    assert midi.acquire(files, "x", 0.1, 10).first().artist_id == "x"


def test_written_pieces_read_back(spark, tmp_path):
    notes = spark.createDataFrame([(1, 0, 0, 60, 80, 480), (1, 480, 1, 62, 70, 0), (1, 480, 0, 60, 90, 100), (2, 7, 0, 64, 1, 3)], "piece_id long, tick long, channel int, pitch int, velocity int, duration_ticks long")
    meta = spark.createDataFrame([(1, 0, "tempo", 400000, None, None), (1, 0, "time_signature", None, 6, 8)], "piece_id long, tick long, kind string, tempo int, numerator int, denominator int")
    for fmt in (0, 1):
        files = midi.encoded(notes, meta, 480, fmt).select(F.col("piece_id").cast("string").alias("path"), "content", F.length("content").alias("length"), F.sha2("content", 256).alias("sha256"))
        back = midi.notes_of(midi.raw_events(files))
        want = sorted((str(r.piece_id), r.tick, r.channel, r.pitch, r.velocity, r.duration_ticks) for r in notes.collect())
        assert sorted((r.path, r.tick, r.channel, r.pitch, r.velocity, r.duration_ticks) for r in back.collect()) == want
        assert {(r.kind, r.tempo, r.numerator) for r in midi.meta_of(midi.raw_events(files)).collect()} == {("tempo", 400000, None), ("time_signature", None, 6)}


def test_tables_scan_and_sink(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿composer,title,midi_score,x\nBach,Fugue,a.mid,1\nOther,T,b.mid,2\nBach,Fugue,a2.mid,3\n", encoding="utf-8")
    rows = tables.metadata_csv(spark, str(tmp_path / "m.csv"), ["Bach"])
    assert tables.scores_by_title(rows).first().paths == ["a.mid", "a2.mid"]
    (tmp_path / "bad.csv").write_text("composer\nBach\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.metadata_csv(spark, str(tmp_path / "bad.csv"), ["Bach"])
    files = spark.createDataFrame([("d/x_input.mid",), ("d/x_output.mid",), ("input/y.mid",), ("output/y.mid",), ("z.mid",)], "path string")
    assert {(r.name, r.input, r.output) for r in tables.file_pairs(files).collect()} == {("x.mid", "d/x_input.mid", "d/x_output.mid"), ("y.mid", "input/y.mid", "output/y.mid")}
    df = spark.createDataFrame([(2, float("nan"), [1]), (1, 0.5, [2])], "k int, v double, a array<int>")
    tables.write_json(df, str(tmp_path / "j"))
    assert sorted(json.loads(x).get("v", -1) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()) == [-1, 0.5]
    tables.write_csv(df, str(tmp_path / "c"), ["k", "a"], ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        tables.write_csv(df, str(tmp_path / "c"), ["k", "a"], ["k"])
    assert "| k | v |" in tables.markdown(df.select("k", "v"))
    gates = {r.criterion: r.passed for r in tables.gate(df, {"some": "count(*) > 1", "none": "max(k) > 5"}).collect()}
    assert gates == {"some": True, "none": False}
    assert tables.survey_form(df.select(F.col("k").alias("pair_id")), ["style", "quality"]).count() == 4


def test_event_batches_are_bounded_however_many_files_come_at_once():
    import pyarrow as pa

    one = smf.encode(1, 480, [[], [(t, "note_on", 0, 60, 1, None, None, None, None) for t in range(1000)]])
    found = list(midi.event_batches(iter([pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(90)]), pa.array([one] * 90)], ["path", "content"])])))
    assert sum(b.num_rows for b in found) == 90 * 1002
    assert len(found) > 1 and max(b.num_rows for b in found) < midi.EVENTS + 1002


def test_files_are_encoded_and_decoded_once(spark, sf_dir):
    from tessitura.queries import QUERIES

    for name in ("midi_probe", "midi_upload_problems", "midi_description", "midi_bytes_round_trip", "midi_acquisition_report"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "MapIn" not in plan and "PythonUDF" not in plan, name
