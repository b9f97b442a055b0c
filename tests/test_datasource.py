"""The MIDI data source and table function: push-down, partitions by bytes, commit and abort."""

import os

import pytest
from pyspark.sql import functions as F

from tessitura.sources import datasource, midi, smf, udtf


def piece(pitch, n=1):
    events = [e for k in range(n) for e in ((960 * k, "note_on", 0, pitch, 80, None, None, None, None), (960 * k + 480, "note_off", 0, pitch, 0, None, None, None, None))]
    return smf.encode(0, 480, [events])


@pytest.fixture
def folder(tmp_path):
    for name, content in (("a.mid", piece(60)), ("b.MIDI", piece(61, 40)), ("c.txt", b"no"), ("d.mid", b"MThd broken")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.mid").write_bytes(piece(62))
    return tmp_path


def test_reading_lists_checks_and_descends(spark, folder):
    datasource.register(spark)
    rows = {os.path.basename(r.path): r for r in spark.read.format("midi").load(str(folder)).collect()}
    assert set(rows) == {"a.mid", "b.MIDI", "d.mid"}
    assert rows["a.mid"].problem is None and rows["d.mid"].problem and bytes(rows["a.mid"].content) == piece(60) and rows["a.mid"].length == len(piece(60))
    every = spark.read.format("midi").option("recursive", "true").option("partitionBytes", "60").load(f"file://{folder}")
    assert {os.path.basename(r.path) for r in every.select("path").collect()} == {"a.mid", "b.MIDI", "d.mid", "e.mid"}
    assert every.rdd.getNumPartitions() > 1


def test_filters_reach_the_listing(spark, folder, monkeypatch):
    reader = datasource.MidiReader({"path": str(folder)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    left = list(reader.pushFilters([StringEndsWith(("path",), ".mid"), GreaterThan(("length",), 20), EqualTo(("problem",), "x")]))
    assert len(left) == 1 and left[0].attribute == ("problem",)
    assert [os.path.basename(f[0]) for p in reader.partitions() for f in p.files] == ["a.mid"]
    datasource.register(spark)
    found = spark.read.format("midi").load(str(folder)).where(F.col("path").endswith(".mid") & (F.col("length") > 20))
    assert [os.path.basename(r.path) for r in found.collect()] == ["a.mid"]


def test_partitions_are_dealt_by_bytes():
    files = [(f"{k}", size, 0) for k, size in enumerate((5, 5, 30, 1, 1, 9))]
    assert [[f[1] for f in p] for p in datasource.dealt(files, 10)] == [[5, 5], [30], [1, 1], [9]]
    assert datasource.dealt([], 10) == []


def test_a_commit_is_whole_or_nothing(spark, tmp_path):
    datasource.register(spark)
    df = spark.createDataFrame([(f"{k}.mid", piece(60 + k)) for k in range(6)], "name string, content binary").repartition(3)
    df.write.format("midi").mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"{k}.mid" for k in range(6)]
    other = spark.createDataFrame([("9.mid", piece(9)), ("3.mid", piece(1))], "name string, content binary")
    with pytest.raises(Exception, match="exists"):
        other.write.format("midi").mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"{k}.mid" for k in range(6)] and (tmp_path / "3.mid").read_bytes() == piece(63)
    other.write.format("midi").option("overwrite", "true").mode("append").save(str(tmp_path))
    assert (tmp_path / "3.mid").read_bytes() == piece(1) and (tmp_path / "9.mid").exists()


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    datasource.register(spark)
    df = spark.createDataFrame([(f"{k}.mid" if k != 4 else "up/../4.mid", piece(60 + k)) for k in range(6)], "name string, content binary").repartition(3, "name")
    with pytest.raises(Exception, match="no file can be written"):
        df.write.format("midi").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    twice = spark.createDataFrame([("a.mid", piece(60)), ("a.mid", piece(61))], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="repeated"):
        twice.write.format("midi").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_the_table_function_gives_events_or_an_error(spark):
    udtf.register(spark)
    files = spark.createDataFrame([("a", piece(60)), ("b", b"MThd broken"), ("c", None)], "path string, content binary")
    rows = spark.sql("SELECT f.path, e.* FROM {f} f, LATERAL midi_events(f.content) e", f=files).collect()
    assert {(r.path, r.error is None) for r in rows} == {("a", True), ("b", False)}
    mine = sorted(tuple(r[c] for c in ("track", "seq", "tick", "kind", "channel", "data1", "data2")) for r in rows if r.path == "a")
    want = sorted(tuple(r[c] for c in ("track", "seq", "tick", "kind", "channel", "data1", "data2")) for r in midi.raw_events(files.where("path = 'a'")).collect())
    assert mine == want
