"""Transformations of notes by genomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, half_even, hash_uniform, preferred_bin

#: Upper edges matter half-open; the last bin has no end.
DURATION_EDGES = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)


def _value(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def transform_notes(notes: DataFrame, transpose=0.0, density=1.0, duration=1.0, velocity=0.0) -> DataFrame:
    """Global transformation: every argument is a number or a column. Notes
    that leave the pitches 0 to 127 go; roundings are half to even."""
    moved = (F.col("pitch") + half_even(_value(transpose))).cast("int")
    return notes.where(moved.between(0, 127)).withColumns(
        {
            "pitch": moved,
            "tick": F.greatest(half_even(F.col("tick") * _value(density)), F.lit(0)),
            "duration_ticks": F.greatest(half_even(F.col("duration_ticks") * _value(duration)), F.lit(0)),
            "velocity": clamp(half_even(F.col("velocity") + _value(velocity)), 0, 127).cast("int"),
        }
    )


def genome_sweep(notes: DataFrame, genomes: DataFrame) -> DataFrame:
    """Every note under every genome (genome_id, transpose, density, duration,
    velocity); the genomes are a short list, so the product stays a map."""
    pairs = notes.join(F.broadcast(genomes.withColumnsRenamed({"duration": "g_duration", "velocity": "g_velocity"})))
    return transform_notes(pairs, F.col("transpose"), F.col("density"), F.col("g_duration"), F.col("g_velocity"))


def local_transform(structured: DataFrame, onset_histogram: Column, duration_histogram: Column, max_polyphony: Column, genome: dict[str, float], ticks_per_beat: int, seed: int, key: str = "piece_id") -> DataFrame:
    """Bar-relative transformation that keeps the melody's timing.

    ``structured``: notes with bar_start, bar_end, is_melody, ordinal, and
    whatever the histogram columns refer to. Genome: transpose, rhythm,
    duration, thin, double. Accompaniment moves towards the preferred onset
    bin of its bar and the preferred duration; the lowest accompaniment notes
    thin out, or one is doubled at the octave. The transposition is cancelled
    if any note would leave 0 to 127.
    """
    rhythm, pull, thin, double = (min(1.0, max(0.0, float(genome.get(k, 0.0)))) for k in ("rhythm", "duration", "thin", "double"))
    asked = half_even(F.lit(float(genome.get("transpose", 0.0))))
    piece, onset = Window.partitionBy(key), Window.partitionBy(key, "tick")
    n = F.count("*").over(onset)
    leaves = F.max((~(F.col("pitch") + asked).between(0, 127)).cast("int")).over(piece)
    low_first = onset.orderBy(F.col("is_melody").cast("int"), "pitch", "channel", "velocity", "duration_ticks", "ordinal")

    length = F.greatest(F.col("bar_end") - F.col("bar_start"), F.lit(1))
    current = F.least(F.floor((F.col("tick") - F.col("bar_start")) * 16 / length), F.lit(15)).cast("int")
    desired = F.col("bar_start") + half_even((preferred_bin(onset_histogram, current) + 0.5) * length / 16.0)
    moved = clamp(half_even(F.col("tick") + F.lit(rhythm) * (desired - F.col("tick"))), F.col("bar_start"), F.col("bar_end") - 1)
    middles = [(a + b) / 2 for a, b in zip(DURATION_EDGES, DURATION_EDGES[1:], strict=False)] + [DURATION_EDGES[-1] * 1.5]
    beats = F.element_at(F.array(*map(F.lit, middles)), preferred_bin(duration_histogram, F.lit(0)) + 1)
    target = F.greatest(half_even(beats * ticks_per_beat), F.lit(1))

    staged = structured.select(
        "*",
        F.when(leaves > 0, 0).otherwise(asked).alias("_up"),
        n.alias("_n"),
        (n - 1).alias("_others"),
        F.row_number().over(low_first).alias("_low"),
        moved.alias("_moved"),
        target.alias("_target"),
        max_polyphony.alias("_most"),
        F.max(F.when(F.col("is_melody"), F.col("pitch"))).over(onset).alias("_top"),
    )
    thinning = thin >= double
    gone = F.least(half_even(F.col("_others") * F.lit(thin)), F.col("_n") - 1) if thinning else F.lit(0)
    kept = staged.where(F.col("is_melody") | (F.col("_low") > F.when(F.col("_n") > 1, gone).otherwise(0)))
    at = F.when(F.col("is_melody"), F.col("tick")).otherwise(F.col("_moved"))
    pulled = half_even(F.col("duration_ticks") + F.lit(pull) * (F.col("_target") - F.col("duration_ticks")))
    lasts = F.when(F.col("is_melody"), F.col("duration_ticks")).otherwise(F.greatest(F.least(pulled, F.col("bar_end") - at), F.lit(1)))
    columns = [key, "tick", "channel", "pitch", "velocity", "duration_ticks"]
    done = kept.select(
        key, at.alias("tick"), "channel", (F.col("pitch") + F.col("_up")).cast("int").alias("pitch"), "velocity", lasts.alias("duration_ticks"),
        "is_melody", "_low", "_n", "_most", (F.col("_top") + F.col("_up")).alias("_roof"), F.col("tick").alias("_onset"),
    )
    if thinning:
        return done.select(*columns)
    chosen = done.where(~F.col("is_melody") & (F.col("_low") == 1) & (F.col("_most") > F.col("_n")))
    chosen = chosen.where(hash_uniform(F.lit(seed), F.lit("double"), F.col("_onset")) < double)
    choices = F.filter(F.array(F.col("pitch") - 12, F.col("pitch") + 12), lambda p: p.between(0, 127) & (p < F.col("_roof")))
    octave = chosen.withColumn("pitch", F.array_max(choices)).where("pitch IS NOT NULL")
    return done.select(*columns).unionByName(octave.select(*columns))
