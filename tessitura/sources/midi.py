"""MIDI scans and sinks on binary columns.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads
will do. Decoding is per file in Arrow batches; pairing notes, ordering events
and delta times are relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clip_seconds
from ..operators import events, intervals, meter
from ..plans.checkpoints import checkpoint, staged
from ..schemas import RAW_EVENT
from . import smf


def midi_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content, length, sha256) of ``*.mid`` and ``*.midi``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mid,midi}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content", "length", F.sha2("content", 256).alias("sha256"))


#: Events that a task holds before it passes them on, but for one file's.
EVENTS = 20_000
_SUMMARY = {
    "path": pa.string(), "ok": pa.bool_(), "error": pa.string(), "error_offset": pa.int64(), "smf_format": pa.int32(), "ticks_per_beat": pa.int32(), "tracks": pa.int32(),
    "end_tick": pa.int64(), "notes": pa.int64(), "tempos": pa.list_(pa.struct([("tick", pa.int64()), ("tempo", pa.int32())])),
}
_EVENT = {
    "path": pa.string(), "track": pa.int32(), "seq": pa.int32(), "tick": pa.int64(), "kind": pa.string(), "channel": pa.int32(), "data1": pa.int32(), "data2": pa.int32(),
    "tempo": pa.int32(), "numerator": pa.int32(), "denominator": pa.int32(), "text": pa.string(),
}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def summaries(files: DataFrame) -> DataFrame:
    """(path, ok, error, error_offset, smf_format, ticks_per_beat, tracks,
    end_tick, notes, tempos): what one decoding tells of each file; ``end_tick``
    is null without events, ``notes`` counts note-ons that sound."""
    def one(path: str, raw: bytes) -> tuple:
        try:
            kind, division, tracks, _ = smf.header(raw)
            found = [e for _, e in smf.decode(raw)[2]]
        except smf.SmfError as e:
            return path, False, e.message, e.offset, None, None, None, None, None, None
        tempos = [{"tick": e[1], "tempo": e[6]} for e in found if e[2] == "tempo"]
        return path, True, None, None, min(kind, 1), division, tracks, max((e[1] for e in found), default=None), sum(e[2] == "note_on" and e[5] > 0 for e in found), tempos

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch([one(p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)], _SUMMARY)

    schema = "path string, ok boolean, error string, error_offset long, smf_format int, ticks_per_beat int, tracks int, end_tick long, notes long, tempos array<struct<tick: long, tempo: int>>"
    return files.select("path", "content").mapInArrow(read, schema)


def checked_files(files: DataFrame) -> DataFrame:
    """(path, ok, error, error_offset, smf_format, ticks_per_beat, tracks):
    structure and events of each file; trouble is a row, not an exception."""
    return summaries(files).select("path", "ok", "error", "error_offset", "smf_format", "ticks_per_beat", "tracks")


def event_batches(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Events of (path, content), of some ``kinds`` if they are named: no batch
    passes :data:`EVENTS` by more than the events of one file, however many
    files come at once."""
    names, sizes, held = [], [], []
    for batch in batches:
        for path, raw in zip(batch.column(0), batch.column(1), strict=True):
            try:
                found = smf.decode(raw.as_py())[2]
            except smf.SmfError:
                continue
            if kinds:
                found = [(track, event) for track, event in found if event[2] in kinds]
            names.append(path.as_py())
            sizes.append(len(found))
            held += found
            if len(held) >= EVENTS:
                yield _events(names, sizes, held)
                names, sizes, held = [], [], []
    if held:
        yield _events(names, sizes, held)


def _events(names: list[str], sizes: list[int], held: list[tuple[int, smf.Event]]) -> pa.RecordBatch:
    """(track, event) of files that have so many each, as a batch."""
    path = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
    columns = [[track for track, _ in held], *zip(*[event for _, event in held], strict=True)]
    return pa.RecordBatch.from_arrays([path, *(pa.array(c, t) for c, t in zip(columns, list(_EVENT.values())[1:], strict=True))], list(_EVENT))


def raw_events(files: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Events of the files that decode, one row each, absolute ticks. Every file
    is decoded to its end; where ``kinds`` are named, only theirs become rows."""
    return files.select("path", "content").mapInArrow(partial(event_batches, kinds=kinds), RAW_EVENT)


def notes_of(raw: DataFrame, key: str = "path") -> DataFrame:
    """(key, tick, channel, pitch, velocity, duration_ticks): note-ons paired
    first in, first out by track, channel and pitch."""
    marked = raw.withColumn("d", F.when(F.col("kind") == "note_on", 1).when(F.col("kind") == "note_off", -1))
    stream = [key, "track", "channel", "data1"]
    ends = marked.groupBy(key, "track").agg(F.max("tick").alias("_track_end"), F.max(F.when(F.col("d").isNotNull(), F.col("tick"))).alias("_last"))
    met = events.pair_notes(marked.where("d IS NOT NULL").select(*stream, "seq", "tick", "data2", "d"), stream, [key, "track"], ends=ends)
    length = F.when(F.col("end_seq").isNull(), F.col("_track_end") - F.col("tick")).otherwise(F.col("duration_ticks"))
    return met.select(key, "tick", "channel", F.col("data1").alias("pitch"), F.col("data2").alias("velocity"), length.alias("duration_ticks"))


#: Kinds of events that :func:`meta_of` tells of.
META_KINDS = ("tempo", "time_signature", "key_signature", "program_change")


def meta_of(raw: DataFrame, key: str = "path") -> DataFrame:
    return raw.where(F.col("kind").isin(*META_KINDS)).select(key, "tick", "kind", "tempo", "numerator", "denominator", "text", F.when(F.col("kind") == "program_change", F.col("data1")).alias("program"), F.when(F.col("kind") == "program_change", F.col("channel")).alias("channel"))


def probe(files: DataFrame) -> DataFrame:
    """(path, sha256, tracks, duration_s) of the files that decode."""
    return _probed(checkpoint(summaries(files)), files)


def _probed(found: DataFrame, files: DataFrame) -> DataFrame:
    """:func:`probe` from the :func:`summaries` of the files."""
    checked = found.where("ok")
    ends = checked.where("end_tick IS NOT NULL").select("path", "end_tick")
    tempo = checked.select("path", F.explode("tempos").alias("t")).select("path", "t.*")
    seconds = meter.duration_seconds(ends, tempo, 1, "path")  # in beats of one tick
    met = checked.join(seconds, "path").withColumn("duration_s", F.col("duration_s") / F.col("ticks_per_beat"))
    return met.join(files.select("path", "sha256"), "path").select("path", "sha256", "tracks", "duration_s")


def acquire(files: DataFrame, artist: str, shortest: float = 5.0, longest: float = 1800.0) -> DataFrame:
    """Manifest rows (artist_id, path, sha256, duration_s, tracks, source) of
    files whose length is within bounds; :func:`acquisition_report` says whether
    they are enough."""
    found = probe(files).where(F.col("duration_s").between(shortest, longest))
    return found.select(F.lit(artist).alias("artist_id"), "path", "sha256", "duration_s", "tracks", F.lit("local").alias("source"))


def acquisition_report(files: DataFrame, accepted: DataFrame, least: int = 30) -> DataFrame:
    """One row (n_files, n_accepted, warning, error): a warning below ``least``
    files, an error without any."""
    met = files.select("path").join(accepted.select("path", F.lit(1).alias("_a")), "path", "left")
    counts = met.agg(F.count("*").alias("n_files"), F.count("_a").alias("n_accepted"))
    few = F.when(F.col("n_accepted").between(1, least - 1), F.format_string("fewer than %d files", F.lit(least)))
    return counts.select("*", few.alias("warning"), F.when(F.col("n_accepted") == 0, F.lit("no usable file")).alias("error"))


def clips(rows: DataFrame, limit: int = 15) -> DataFrame:
    """Adds clip_s: the length of a clip, clamped."""
    return rows.withColumn("clip_s", clip_seconds(F.col("duration_s"), limit))


# Bounds of an input that is offered for transformation.
LIMITS = {"bytes": 10_000_000, "notes": 10_000, "seconds": 900.0, "bars": 10_000}
WARNINGS = {"control_change": "controllers", "pitch_bend": "pitch bends", "aftertouch": "channel pressure", "polytouch": "key pressure"}


def input_problems(files: DataFrame) -> DataFrame:
    """(path, problem) of files that may not be transformed: unreadable, too
    large, drums, note-offs without note-ons, no or too many notes, too long,
    too many bars."""
    checked = checked_files(files).join(files.select("path", "length"), "path")
    raw = raw_events(files)
    marked = raw.withColumn("d", F.when(F.col("kind") == "note_on", 1).when(F.col("kind") == "note_off", -1)).where("d IS NOT NULL")
    lost = events.unmatched_offs(marked, ["path", "track", "channel", "data1"], ["path"])
    counts = raw.groupBy("path").agg(F.count_if(F.col("kind") == "note_on").alias("notes"), F.count_if((F.col("channel") == 9) & (F.col("kind") == "note_on")).alias("drums"))
    ends = raw.groupBy("path").agg(F.max("tick").alias("end_tick"))
    beats = raw.join(checked_files(files).where("ok").select("path", "ticks_per_beat"), "path").withColumn("tick", F.col("tick") / F.col("ticks_per_beat"))
    signatures = beats.where("kind = 'time_signature'").select("path", "tick", "numerator", "denominator")
    bars = meter.length_in_bars(signatures, ends.join(checked.select("path", "ticks_per_beat"), "path").select("path", (F.col("end_tick") / F.col("ticks_per_beat")).alias("end_tick")), 1, "path")
    every = checked.join(counts, "path", "left").join(lost, "path", "left").join(probe(files).select("path", "duration_s"), "path", "left").join(bars, "path", "left").na.fill(0, ["notes", "drums", "unmatched"])
    tests = [
        ("unreadable", ~F.col("ok")), ("size", F.col("length") > LIMITS["bytes"]), ("drums", F.col("drums") > 0), ("unbalanced", F.col("unmatched") > 0),
        ("notes", F.col("ok") & ~F.col("notes").between(1, LIMITS["notes"])), ("length", F.col("duration_s") > LIMITS["seconds"]), ("bars", F.col("length_bars") > LIMITS["bars"]),
    ]
    found = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in tests]))
    return every.select("path", F.explode(found).alias("problem"))


# Bounds of an upload to the catalogue.
UPLOAD = {"bytes": 10_000_000, "seconds": 900.0, "notes": 200_000}


def upload_problems(files: DataFrame, limits: dict[str, float] = UPLOAD) -> DataFrame:
    """(path, problem) of files that the catalogue refuses; the first that holds
    of: size, unreadable, length, notes (too many), empty."""
    known = checkpoint(summaries(files))
    every = known.select("path", "ok", "notes").join(files.select("path", "length"), "path").join(_probed(known, files).select("path", "duration_s"), "path", "left")
    problem = (
        F.when(F.col("length") > limits["bytes"], "size").when(~F.col("ok"), "unreadable").when(F.col("duration_s") > limits["seconds"], "length")
        .when(F.col("notes") > limits["notes"], "notes").when(F.coalesce("notes", F.lit(0)) == 0, "empty")
    )
    return every.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def performance_warnings(raw: DataFrame, key: str = "path") -> DataFrame:
    """(key, warning): what a score keeps not of a performance, with counts."""
    named = F.create_map(*(F.lit(x) for pair in WARNINGS.items() for x in pair))
    counts = raw.where(F.col("kind").isin(*WARNINGS)).groupBy(key, "kind").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), named[F.col("kind")])))
    return counts.groupBy(key).agg(F.concat(F.lit("performance events: "), F.array_join(parts, ", ")).alias("warning"))


def encoded(notes: DataFrame, meta: DataFrame, ticks_per_beat: int, smf_format: int = 1, key: str = "piece_id") -> DataFrame:
    """(key, content): a MIDI file per piece; format 1 has a track of meta
    events and one of notes. A piece's events are bounded and meet in one group."""
    ordered = events.phased_events(notes.repartition(key), meta.repartition(key), key)

    def rows(found: pa.Table) -> list[tuple]:
        return list(zip(*(_values(found.column(c)) for c in ("tick", "kind", "channel", "pitch", "velocity", "tempo", "numerator", "denominator")), repeat(None)))

    def write(found: pa.Table) -> pa.Table:
        every = found.sort_by([(c, "ascending") for c in events.WRITE_ORDER], null_placement="at_start")
        silent = pc.if_else(pc.equal(every.column("kind"), "note_off"), pa.scalar(0, pa.int32()), every.column("velocity"))
        every = every.set_column(every.column_names.index("velocity"), "velocity", silent)
        head = pc.is_in(every.column("kind"), pa.array(["tempo", "time_signature", "key_signature"]))
        tracks = [every] if smf_format == 0 else [every.filter(head), every.filter(pc.invert(head))]
        content = smf.encode(0 if smf_format == 0 else 1, ticks_per_beat, [rows(t) for t in tracks])
        return pa.table({key: found.column(key).slice(0, 1), "content": pa.array([content], pa.binary())})

    return ordered.groupBy(key).applyInArrow(write, f"{key} {notes.schema[key].dataType.simpleString()}, content binary")


def _values(column: pa.ChunkedArray) -> list:
    """As ``to_pylist``, which makes an object of Arrow's for every value; here
    only where some are null and some are not."""
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def write_midi(pieces: DataFrame, folder: str) -> None:
    """The sink: a file ``name`` with ``content`` per row, under ``folder`` of
    any store that the executors reach. Tasks overwrite what an attempt before
    them left, so retries do no harm."""
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        for pdf in batches:
            for name, raw in zip(pdf["name"], pdf["content"], strict=True):
                path = f"{root}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(bytes(raw))
            yield pdf[["name"]]

    pieces.select("name", "content").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()


def merged_performance(encoded_events: DataFrame, original: DataFrame, policy: str) -> DataFrame:
    """Output events with the original's controllers and bends put back."""
    return encoded_events.unionByName(events.kept_performance(original, policy), allowMissingColumns=True)


def performance_problems(written: DataFrame, original: DataFrame, merged: DataFrame, policy: str, key: str) -> DataFrame:
    """(key, kind, problem): events that the merge lost or invented."""
    columns = merged.columns
    wanted = merged_performance(written, original, policy).select(*columns)
    lost = wanted.exceptAll(merged).select(key, "kind", F.lit("lost").alias("problem"))
    return lost.unionAll(merged.exceptAll(wanted).select(key, "kind", F.lit("invented").alias("problem")))


def described(files: DataFrame) -> DataFrame:
    """(path, sha256, tracks, duration_s, notes): notes of each file as sorted
    structs, in seconds under the file's tempo map."""
    raw, found = staged(raw_events(files)), checkpoint(summaries(files))
    known = _probed(found, files)
    n = notes_of(raw).withColumn("end_tick", F.col("tick") + F.col("duration_ticks"))
    times = F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(c).alias("at")) for e, c in ((0, "tick"), (1, "end_tick")))))
    marks = n.withColumn("n", F.monotonically_increasing_id()).select("path", "n", "channel", "pitch", "velocity", times.alias("t")).select("path", "n", "channel", "pitch", "velocity", "t.end", F.col("t.at").alias("tick"))
    timed = meter.seconds_at(marks, raw.where("kind = 'tempo'").select("path", "tick", "tempo"), 1, "path")  # in beats of one tick
    timed = timed.join(found.where("ok").select("path", "ticks_per_beat"), "path").withColumn("s", F.col("second") / F.col("ticks_per_beat"))
    each = timed.groupBy("path", "n", "channel", "pitch", "velocity").agg(F.max(F.when(F.col("end") == 0, F.col("s"))).alias("start_s"), F.max(F.when(F.col("end") == 1, F.col("s"))).alias("end_s"))
    lists = each.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_s", "pitch", "channel", "end_s", "velocity"))).alias("notes"))
    return known.join(lists, "path", "left").select("path", "sha256", "tracks", "duration_s", "notes")


def end_of(notes: DataFrame, key: str = "path") -> DataFrame:
    return intervals.end_ticks(notes, key)
