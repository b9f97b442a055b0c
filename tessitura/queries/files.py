"""Scans and sinks: what is written is read back and must be the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans.checkpoints import shared_dir, staged
from ..plans.score import TICKS_PER_BEAT as TPB
from ..sources import datasource, midi, tables, udtf
from .registry import query

FOLD = "(SELECT fold FROM piece p WHERE p.piece_id = x.piece_id)"
#: Note-ons and note-offs of a pitch pair first in, first out.
BACK = """SELECT a.piece_id, a.tick, a.channel, a.pitch, a.velocity, b.e - a.tick AS duration_ticks
    FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, channel, pitch ORDER BY tick, velocity) AS k FROM note) a
    JOIN (SELECT piece_id, channel, pitch, tick + duration_ticks AS e, row_number() OVER (PARTITION BY piece_id, channel, pitch ORDER BY tick + duration_ticks) AS k FROM note) b USING (piece_id, channel, pitch, k)"""


def _folder(s):
    return f"{shared_dir(s.spark)}/files-{uuid.uuid4().hex}"


def _content(s):
    return midi.encoded(s.note, s.meta, TPB)


def _bytes(s):
    """The pieces as a table of files, written once however often it is read."""
    return staged(_content(s).select(F.col("piece_id").cast("string").alias("path"), "content", F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256")))


def _notes(raw):
    """Notes of raw events, which their pairing reads four times."""
    return _id(midi.notes_of(staged(raw))).select("piece_id", "tick", "channel", "pitch", "velocity", "duration_ticks")


def _stored(s):
    """The pieces as files in one folder per fold, beside files of other kinds."""
    name = F.format_string("%d/%05d.%s", "fold", "piece_id", F.when(F.pmod("piece_id", F.lit(2)) == 0, "mid").otherwise("midi"))
    pieces = _content(s).join(s.piece.select("piece_id", "fold"), "piece_id").withColumn("name", name)
    other = s.piece.where("piece_id % 5 = 0").select(F.format_string("%d/%05d.txt", "fold", "piece_id").alias("name"), F.encode(F.lit("no music"), "UTF-8").alias("content"))
    folder = _folder(s)
    midi.write_midi(pieces.select("name", "content").unionAll(other), folder)
    return folder


def _id(df):
    return df.withColumn("piece_id", F.regexp_extract("path", r"(\d+)(\.midi?)?$", 1).cast("long"))


@query(BACK)
def midi_file_round_trip(s):
    files = midi.midi_files(s.spark, _stored(s), recursive=True)
    return _notes(midi.raw_events(files))


@query(BACK)
def midi_bytes_round_trip(s):
    return _notes(midi.raw_events(_bytes(s)))


@query(BACK)
def midi_source_round_trip(s):
    """Written and read by the data source: every file moves to its place at the commit."""
    datasource.register(s.spark)
    folder = _folder(s)
    _bytes(s).select(F.concat(F.regexp_extract("path", r"(\d+)(\.midi?)?$", 1), F.lit(".mid")).alias("name"), "content").write.format("midi").mode("append").save(folder)
    files = s.spark.read.format("midi").load(folder).where("path LIKE '%.mid' AND length > 0 AND problem IS NULL")
    return _notes(midi.raw_events(files))


@query(BACK)
def midi_events_lateral(s):
    """Events by the table function in SQL text; broken files among them are rows with an error."""
    udtf.register(s.spark)
    files = _bytes(s).select("path", "content")
    torn = files.select(F.concat(F.lit("torn-"), "path").alias("path"), F.expr("substring(content, 3)").alias("content"))
    raw = s.spark.sql("SELECT f.path, e.* FROM {files} f, LATERAL midi_events(f.content) e WHERE e.error IS NULL", files=files.unionAll(torn))
    return _notes(raw.drop("error"))


@query("SELECT piece_id, tick, 'tempo' AS kind, tempo, NULL::INTEGER AS numerator, NULL::INTEGER AS denominator FROM tempo UNION ALL SELECT piece_id, tick, 'time_signature', NULL, numerator, denominator FROM meter")
def midi_meta_round_trip(s):
    return _id(midi.meta_of(midi.raw_events(_bytes(s), midi.META_KINDS))).select("piece_id", "tick", "kind", "tempo", "numerator", "denominator")


@query("SELECT format('{:05d}.{}', piece_id, CASE WHEN piece_id % 2 = 0 THEN 'mid' ELSE 'midi' END) AS name, true AS whole FROM piece WHERE fold = 1")
def midi_folder_scan(s):
    """One folder, both suffixes, nothing else; the digest is the content's."""
    files = midi.midi_files(s.spark, f"{_stored(s)}/1")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), ((F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("length"))).alias("whole"))


@query(
    """SELECT piece_id, piece_id % 4 <> 0 AS ok, CASE WHEN piece_id % 4 = 0 THEN 'no MThd header' END AS error, CASE WHEN piece_id % 4 <> 0 THEN 1 END AS smf_format,
    CASE WHEN piece_id % 4 <> 0 THEN 480 END AS ticks_per_beat, CASE WHEN piece_id % 4 <> 0 THEN 2 END AS tracks FROM piece"""
)
def midi_structure_check(s):
    broken = F.when(F.pmod(F.col("path").cast("long"), F.lit(4)) == 0, F.expr("substring(content, 3)")).otherwise(F.col("content"))
    return _id(midi.checked_files(_bytes(s).withColumn("content", broken))).select("piece_id", "ok", "error", "smf_format", "ticks_per_beat", "tracks")


ENDS = "(SELECT piece_id, greatest(e.end_tick, m.tick) AS end_tick FROM ends e JOIN (SELECT piece_id, max(tick) AS tick FROM meter GROUP BY piece_id) m USING (piece_id))"
PROBED = f"SELECT piece_id, 2 AS tracks, end_tick * tempo / 480e6::DOUBLE AS duration_s FROM {ENDS} e JOIN tempo USING (piece_id)"


@query(PROBED, rounds="duration_s")
def midi_probe(s):
    return _id(midi.probe(_bytes(s))).select("piece_id", "tracks", "duration_s")


@query(f"SELECT 'star' AS artist_id, CAST(piece_id AS VARCHAR) AS path, duration_s, tracks, 'local' AS source FROM ({PROBED}) p WHERE duration_s BETWEEN 5 AND 290", rounds="duration_s")
def midi_acquisition(s):
    return midi.acquire(_bytes(s), "star", 5.0, 290.0).drop("sha256")


@query(
    f"""SELECT piece_id, problem FROM (
        SELECT piece_id, CASE WHEN piece_id % 4 = 0 THEN 'unreadable' WHEN duration_s > 285 THEN 'length' WHEN n > 600 THEN 'notes' END AS problem
        FROM ({PROBED}) p JOIN (SELECT piece_id, count(*) AS n FROM note GROUP BY piece_id) n USING (piece_id)
    ) x WHERE problem IS NOT NULL"""
)
def midi_upload_problems(s):
    torn = F.when(F.pmod(F.col("path").cast("long"), F.lit(4)) == 0, F.expr("substring(content, 3)")).otherwise(F.col("content"))
    return _id(midi.upload_problems(_bytes(s).withColumn("content", torn), midi.UPLOAD | {"seconds": 285.0, "notes": 600})).select("piece_id", "problem")


@query(
    f"""SELECT CAST((SELECT count(*) FROM piece) AS BIGINT) AS n_files, n AS n_accepted, CASE WHEN n BETWEEN 1 AND 29 THEN 'fewer than 30 files' END AS warning, CASE WHEN n = 0 THEN 'no usable file' END AS error
    FROM (SELECT count(*) AS n FROM ({PROBED}) p WHERE duration_s BETWEEN 5 AND 240) c"""
)
def midi_acquisition_report(s):
    files = _bytes(s)
    return midi.acquisition_report(files, midi.acquire(files, "star", 5.0, 240.0))


@query(f"SELECT piece_id, count(*) AS n_notes, min(n.tick * tempo) / 480e6::DOUBLE AS first_s, sum(duration_ticks * tempo) / 480e6::DOUBLE AS sounding_s, true AS ordered FROM ({BACK}) n JOIN tempo USING (piece_id) GROUP BY piece_id", rounds="first_s sounding_s")
def midi_description(s):
    notes = midi.described(_bytes(s))
    return _id(notes).select(
        "piece_id",
        F.size("notes").cast("long").alias("n_notes"),
        F.col("notes")[0]["start_s"].alias("first_s"),
        F.aggregate("notes", F.lit(0.0), lambda a, n: a + n["end_s"] - n["start_s"]).alias("sounding_s"),
        (F.col("notes") == F.array_sort("notes")).alias("ordered"),
    )


@query("SELECT format('x{:05d}.mid', piece_id) AS name, format('pairs/x{:05d}_input.mid', piece_id) AS input, format('pairs/x{:05d}_output.mid', piece_id) AS output FROM piece WHERE piece_id % 3 = 0 UNION ALL SELECT format('y{:05d}.mid', piece_id), format('input/y{:05d}.mid', piece_id), format('output/y{:05d}.mid', piece_id) FROM piece WHERE piece_id % 3 = 1")
def file_pair_scan(s):
    named = lambda rest, form: s.piece.where(f"piece_id % 3 = {rest}").select(F.format_string(form, "piece_id").alias("path"))
    forms = [(0, "pairs/x%05d_input.mid"), (0, "pairs/x%05d_output.mid"), (1, "input/y%05d.mid"), (1, "output/y%05d.mid"), (2, "pairs/z%05d_input.mid")]
    files = named(*forms[0])
    for form in forms[1:]:
        files = files.unionAll(named(*form))
    return tables.file_pairs(files)


@query("SELECT composer, 'Suite ' || fold AS title, count(*) AS n, min(format('{:05d}.mid', piece_id)) AS first_path FROM piece WHERE composer IN ('ASIA', 'EUROPE') AND piece_id % 7 <> 0 GROUP BY ALL")
def metadata_csv_scan(s):
    """Written with a byte order mark and more columns, read for two labels."""
    path = _folder(s)
    score = F.when(F.pmod("piece_id", F.lit(7)) != 0, F.format_string("%05d.mid", "piece_id"))
    marked = s.piece.select(F.col("composer").alias("﻿composer"), F.concat(F.lit("Suite "), "fold").alias("title"), score.alias("midi_score"), "group_id")
    marked.write.option("header", True).csv(path)
    rows = tables.scores_by_title(tables.metadata_csv(s.spark, path, ["ASIA", "EUROPE"]))
    return rows.select("composer", "title", F.size("paths").cast("long").alias("n"), F.col("paths")[0].alias("first_path"))


@query("SELECT CAST(piece_id AS VARCHAR) AS path, sha256(CAST(piece_id AS VARCHAR)) AS sha256, piece_id / 4 AS duration_s, 2 AS tracks, composer AS source FROM piece", rounds="duration_s")
def manifest_round_trip(s):
    path = _folder(s)
    key = F.col("piece_id").cast("string")
    tables.write_json(s.piece.select(key.alias("path"), F.sha2(key, 256).alias("sha256"), (F.col("piece_id") / 4).alias("duration_s"), F.lit(2).alias("tracks"), F.col("composer").alias("source")), path)
    return tables.manifest(s.spark, path)


@query("SELECT composer, piece_id, CASE WHEN piece_id % 3 <> 0 THEN piece_id / 8 END AS value, CASE WHEN piece_id % 2 = 0 THEN 'again' ELSE 'first' END AS note FROM piece UNION ALL SELECT composer, piece_id, 1.5, 'later' FROM piece WHERE piece_id % 5 = 0", rounds="value")
def json_lines_round_trip(s):
    """Infinite values become null; progress is appended."""
    path = _folder(s)
    value = F.when(F.pmod("piece_id", F.lit(3)) == 0, F.lit(float("inf"))).otherwise(F.col("piece_id") / 8)
    tables.write_json(s.piece.select("composer", "piece_id", value.alias("value"), F.when(F.pmod("piece_id", F.lit(2)) == 0, "again").otherwise("first").alias("note")), path)
    tables.append_progress(s.piece.where("piece_id % 5 = 0").select("composer", "piece_id", F.lit(1.5).alias("value"), F.lit("later").alias("note")), path)
    return s.spark.read.schema("composer string, piece_id long, value double, note string").json(path)


@query("SELECT piece_id, composer, group_id AS content_group, fold AS content_fold, '[' || group_id || ',' || fold || ']' AS both FROM piece")
def csv_round_trip(s):
    """Structs are opened into columns, lists are JSON text; a path is written once."""
    path = _folder(s)
    nested = s.piece.select("piece_id", "composer", F.struct(F.col("group_id").alias("group"), F.col("fold").alias("fold")).alias("content"), F.array("group_id", "fold").alias("both"))
    flat = tables.opened(nested)
    tables.write_csv(flat, path, flat.columns, ["piece_id"])
    try:
        tables.write_csv(flat, path, flat.columns, ["piece_id"])
    except Exception as e:  # the second write must be refused
        if "ALREADY_EXISTS" not in str(e):
            raise
    else:
        raise AssertionError("written twice")
    return s.spark.read.schema("piece_id long, composer string, content_group int, content_fold int, both string").option("header", True).csv(path)


@query("SELECT sha256(CAST(piece_id AS VARCHAR)) AS sha256, CAST(piece_id AS VARCHAR) AS path, CASE WHEN piece_id % 3 = 0 THEN piece_id / 2 END AS gain, CASE WHEN piece_id % 2 = 0 THEN CAST(fold AS DOUBLE) END AS duration_s, CASE WHEN piece_id % 2 = 0 THEN composer END AS source FROM piece", rounds="gain duration_s")
def library_catalog(s):
    key = F.col("piece_id").cast("string")
    named = s.piece.withColumn("path", key).withColumn("sha256", F.sha2(key, 256))
    results = named.where("piece_id % 3 = 0").select("sha256", (F.col("piece_id") / 2).alias("gain"))
    manifests = named.where("piece_id % 2 = 0").select("sha256", F.col("fold").cast("double").alias("duration_s"), F.col("composer").alias("source"))
    return tables.catalog(named, results, manifests)


@query("SELECT composer, problem FROM (SELECT DISTINCT composer FROM piece) l, (VALUES ('AFRICA', 'size'), ('ASIA', 'not finite'), ('EUROPE', 'not unique')) p(c, problem) WHERE composer = c")
def profile_store_check(s):
    means = s.piece.select("composer").distinct().withColumn("mean", F.when(F.col("composer") == "AFRICA", F.array(F.lit(1.0))).when(F.col("composer") == "ASIA", F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array(F.lit(0.5), F.lit(0.5))))
    return tables.profile_problems(means.unionAll(means.where("composer = 'EUROPE'")), 2)


CONTROL = "SELECT user_id AS f, event_id AS tick, CASE event_type WHEN 'click' THEN 'control_change' WHEN 'view' THEN 'pitch_bend' ELSE event_type END AS kind FROM events"


def _performance(s):
    kind = F.when(F.col("event_type") == "click", "control_change").when(F.col("event_type") == "view", "pitch_bend").otherwise(F.col("event_type"))
    return s.table("events").select(F.col("user_id").alias("f"), F.col("event_id").alias("tick"), kind.alias("kind"))


@query(f"SELECT f, tick, kind FROM ({CONTROL}) c")
def performance_merge(s):
    """Events of a score with the controllers and bends of its source put back."""
    every = _performance(s)
    score = every.where("kind NOT IN ('control_change', 'pitch_bend')")
    return midi.merged_performance(score, every, "preserve")


@query(f"SELECT f, kind, 'lost' AS problem FROM ({CONTROL}) c WHERE kind = 'pitch_bend' AND tick % 10 = 0 UNION ALL SELECT f, kind, 'invented' FROM ({CONTROL}) c WHERE kind = 'purchase' AND tick % 20 = 0")
def performance_merge_check(s):
    every = _performance(s)
    score = every.where("kind NOT IN ('control_change', 'pitch_bend')")
    merged = midi.merged_performance(score, every, "preserve")
    torn = merged.where("NOT (kind = 'pitch_bend' AND tick % 10 = 0)").unionAll(merged.where("kind = 'purchase' AND tick % 20 = 0"))
    return midi.performance_problems(score, every, torn, "preserve", "f")


@query(f"SELECT f, 'performance events: ' || string_agg(n || ' ' || CASE kind WHEN 'control_change' THEN 'controllers' ELSE 'pitch bends' END, ', ' ORDER BY n || ' ' || CASE kind WHEN 'control_change' THEN 'controllers' ELSE 'pitch bends' END) AS warning FROM (SELECT f, kind, count(*) AS n FROM ({CONTROL}) c WHERE kind IN ('control_change', 'pitch_bend') GROUP BY ALL) g GROUP BY f")
def performance_warnings(s):
    return midi.performance_warnings(_performance(s), "f")


@query("SELECT piece_id AS pair_id, piece_id || '__abx' AS question_id, CASE WHEN l THEN 'in' ELSE 'out' END AS a, CASE WHEN l THEN 'out' ELSE 'in' END AS b, CASE WHEN x THEN 'a' ELSE 'b' END AS x_is FROM (SELECT piece_id, CAST(('0x' || substr(sha256('5|side|' || piece_id), 1, 16)) AS UBIGINT) < 9223372036854775808 AS l, CAST(('0x' || substr(sha256('5|x|' || piece_id), 1, 16)) AS UBIGINT) < 9223372036854775808 AS x FROM piece) q")
def abx_form(s):
    return tables.abx_form(s.piece.select(F.col("piece_id").alias("pair_id"), F.lit("in").alias("input"), F.lit("out").alias("output")), 5)


@query("SELECT format('{}__{:02d}', piece_id, i) AS question_id, piece_id AS pair_id, d AS dimension, format('Rate {} of pair {} from 1 to 5.', d, piece_id) AS text FROM piece, (VALUES (0, 'style'), (1, 'quality')) v(i, d)")
def opinion_form(s):
    return tables.survey_form(s.piece.select(F.col("piece_id").alias("pair_id")), ["style", "quality"])


