"""Metadata, manifests, profiles and results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import hash_uniform, json_safe
from ..schemas import MANIFEST


def metadata_csv(spark: SparkSession, path: str, composers: list[str]) -> DataFrame:
    """(composer, title, midi_score) for the wanted composers; other columns of
    the file are ignored, a byte order mark is dropped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    named = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = {"composer", "title", "midi_score"} - set(named.columns)
    if missing:
        raise ValueError(f"metadata lacks {sorted(missing)}")
    return named.select("composer", "title", "midi_score").where(F.col("composer").isin(*composers) & F.col("midi_score").isNotNull())


def scores_by_title(rows: DataFrame) -> DataFrame:
    return rows.groupBy("composer", "title").agg(F.array_sort(F.collect_set("midi_score")).alias("paths"))


def json_rows(spark: SparkSession, path: str, schema: StructType, whole: bool = False) -> DataFrame:
    """A JSON artifact under a fixed schema; anything else fails to parse. Lines
    are rows; a ``whole`` file is one document, an object or an array of them."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=whole)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, MANIFEST)


def file_pairs(files: DataFrame) -> DataFrame:
    """(name, input, output): ``input/`` and ``output/`` with one name, or
    names that end in ``_input`` and ``_output``."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(base, r"_(input|output)(\.[^.]+)$", "$2")
    suffixed = base.rlike(r"_(input|output)\.[^.]+$")
    side = F.when(suffixed, F.regexp_extract(base, r"_(input|output)\.[^.]+$", 1)).when(folder.isin("input", "output"), folder)
    sides = files.select("path", stem.alias("name"), side.alias("side")).where("side IS NOT NULL")
    met = sides.groupBy("name").agg(F.min(F.when(F.col("side") == "input", F.col("path"))).alias("input"), F.min(F.when(F.col("side") == "output", F.col("path"))).alias("output"))
    return met.where("input IS NOT NULL AND output IS NOT NULL")


def profile_problems(profiles: DataFrame, size: int) -> DataFrame:
    """(composer, problem): wrong size, not finite, or not the only one."""
    fine = F.forall("mean", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    each = profiles.select("composer", F.when(F.size("mean") != size, "size").when(~fine, "not finite").alias("problem")).where("problem IS NOT NULL")
    twice = profiles.groupBy("composer").agg(F.count("*").alias("n")).where("n > 1").select("composer", F.lit("not unique").alias("problem"))
    return each.unionByName(twice)


def catalog(files: DataFrame, results: DataFrame, manifests: DataFrame) -> DataFrame:
    """Library entries: files with what results and manifests know of them."""
    return files.select("path", "sha256").join(results, "sha256", "left").join(manifests.select("sha256", "duration_s", "source"), "sha256", "left")


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Fixed columns, nested ones as JSON text, sorted within a file each."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    flat = df.select(*[(F.to_json(c) if c in nested else F.col(c)).alias(c) for c in columns])
    flat.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("header", True).csv(path)


def opened(df: DataFrame) -> DataFrame:
    """Structs opened into columns ``struct_field``; other nested columns as JSON text."""
    columns = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            columns += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}_{x}") for x in f.dataType.names]
        else:
            columns.append(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map") else F.col(f.name))
    return df.select(*columns)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; doubles that JSON can't hold become null."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    df.withColumns({c: json_safe(F.col(c)) for c in doubles}).write.mode(mode).json(path)


def append_progress(df: DataFrame, path: str) -> None:
    write_json(df, path, "append")


def report_lines(sections: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(section, line_no, line): a Markdown table per section, of any size, as
    rows; each is ordered by the columns named with it."""
    found = None
    for name, df, order in sections:
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        body = df.select(F.lit(name).alias("section"), (F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)) + 2).cast("long").alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
        head = [(name, 1, "| " + " | ".join(df.columns) + " |"), (name, 2, "|" + "---|" * len(df.columns))]
        body = df.sparkSession.createDataFrame(head, "section string, line_no long, line string").unionAll(body)
        found = body if found is None else found.unionAll(body)
    return found


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; ``most`` rows are a report's limit."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])


def survey_form(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """(question_id, pair_id, dimension, text) for every pair and dimension."""
    each = pairs.select("pair_id", F.posexplode(F.array(*map(F.lit, dimensions))).alias("i", "dimension"))
    return each.select(F.format_string("%s__%02d", F.col("pair_id").cast("string"), F.col("i")).alias("question_id"), "pair_id", "dimension", F.format_string("Rate %s of pair %s from 1 to 5.", "dimension", F.col("pair_id").cast("string")).alias("text"))


def abx_form(pairs: DataFrame, seed: int) -> DataFrame:
    """(question_id, pair_id, a, b, x_is): for every pair which side is A, and
    which of them X repeats, drawn from the pair's hash."""
    left, x = hash_uniform(F.lit(seed), F.lit("side"), F.col("pair_id")) < 0.5, hash_uniform(F.lit(seed), F.lit("x"), F.col("pair_id")) < 0.5
    return pairs.select(
        F.format_string("%s__abx", F.col("pair_id").cast("string")).alias("question_id"), "pair_id",
        F.when(left, F.col("input")).otherwise(F.col("output")).alias("a"), F.when(left, F.col("output")).otherwise(F.col("input")).alias("b"),
        F.when(x, F.lit("a")).otherwise(F.lit("b")).alias("x_is"),
    )


def gate(records: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """(criterion, passed): each an aggregate SQL predicate over the records."""
    one = records.agg(*[F.expr(p).alias(f"c{i}") for i, p in enumerate(criteria.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("criterion"), F.coalesce(F.col(f"c{i}"), F.lit(False)).alias("passed")) for i, n in enumerate(criteria)])).alias("x")).select("x.*")
