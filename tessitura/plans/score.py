"""The score projection: notes, pieces and meta events from star-schema tables.

The operators take ``notes`` and ``meta`` DataFrames and don't care whether
they come from MIDI files or from here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS_PER_BEAT = 480
#: The fixed transformation behind the paired ``output`` notes.
OUTPUT_GENOME = {"transpose": 3.0, "density": 1.01, "duration": 0.9, "velocity": 5.0}


class Score:
    """Views over the tables of one directory, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def note(self) -> DataFrame:
        days = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("piece_id"),
            (days * 120).cast("long").alias("tick"),
            F.pmod("l_linenumber", F.lit(4)).cast("int").alias("channel"),
            (36 + F.pmod("l_partkey", F.lit(48))).cast("int").alias("pitch"),
            (1 + F.pmod(F.floor("l_extendedprice"), F.lit(127))).cast("int").alias("velocity"),
            (F.floor("l_quantity") * 10 - 10).cast("long").alias("duration_ticks"),
        )

    @cached_property
    def piece(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("piece_id"),
            F.col("r_name").alias("composer"),
            F.col("n_nationkey").cast("int").alias("group_id"),
            F.floor(F.col("n_nationkey") / 5).cast("int").alias("fold"),
            F.lit(TICKS_PER_BEAT).alias("ticks_per_beat"),
            F.lit(1).alias("smf_format"),
        )

    @cached_property
    def tempo(self) -> DataFrame:
        return self.piece.select("piece_id", F.lit(0).cast("long").alias("tick"), (400000 + 10000 * F.col("group_id")).cast("int").alias("tempo"))

    @cached_property
    def meter(self) -> DataFrame:
        kind = F.pmod("piece_id", F.lit(3))
        change = F.when(kind == 1, F.struct(F.lit(115200).cast("long").alias("tick"), F.lit(3).alias("numerator"), F.lit(4).alias("denominator"))).when(
            kind == 2, F.struct(F.lit(172800).cast("long").alias("tick"), F.lit(6).alias("numerator"), F.lit(8).alias("denominator"))
        )
        first = F.struct(F.lit(0).cast("long").alias("tick"), F.lit(4).alias("numerator"), F.lit(4).alias("denominator"))
        return self.piece.select("piece_id", F.explode(F.array_compact(F.array(first, change))).alias("m")).select("piece_id", "m.*")

    @cached_property
    def meta(self) -> DataFrame:
        none = F.lit(None).cast("int")
        tempo = self.tempo.select("piece_id", "tick", F.lit("tempo").alias("kind"), "tempo", none.alias("numerator"), none.alias("denominator"))
        meter = self.meter.select("piece_id", "tick", F.lit("time_signature").alias("kind"), none.alias("tempo"), "numerator", "denominator")
        return tempo.unionByName(meter)

    @cached_property
    def output(self) -> DataFrame:
        from ..operators.transform import transform_notes

        return transform_notes(self.note, **OUTPUT_GENOME)

    @cached_property
    def ev(self) -> DataFrame:
        """Stream-shaped notes of the events table."""
        return self.table("events").select(
            F.col("user_id").alias("piece_id"),
            "event_id",
            F.col("ts"),
            (36 + F.pmod(F.floor(F.col("value") * 100), F.lit(48))).cast("int").alias("pitch"),
            (F.get_json_object("props", "$.k").cast("long") * 10).alias("dur"),
        )
