"""Similarity of paired pieces: multisets, chroma, onsets, content, constraints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .intervals import end_ticks, polyphony
from .melody import contour, ngrams
from .meter import empty_bar_ratio


def multiset_jaccard(a: DataFrame, b: DataFrame, items: list[str], key: str = "piece_id") -> DataFrame:
    """(key, common, every, jaccard) of the rows of a and b as multisets.

    Both sides are counted in one aggregation instead of a full outer join.
    Keys that only an empty multiset has do not occur; treat them as 1.
    """
    sides = a.select(key, *items, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, *items, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = sides.groupBy(key, *items).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sums = counts.groupBy(key).agg(F.sum(F.least("_a", "_b")).alias("common"), F.sum(F.greatest("_a", "_b")).alias("every"))
    return sums.withColumn("jaccard", ratio(F.col("common"), F.col("every")))


def contour_similarity(source: DataFrame, output: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, melody_trigram_jaccard) of the contour trigrams."""
    grams = [ngrams(contour(n, key), "sign", 3, key) for n in (source, output)]
    found = multiset_jaccard(*grams, ["g0", "g1", "g2"], key)
    keys = source.select(key).union(output.select(key)).distinct()
    return keys.join(found, key, "left").select(key, F.coalesce("jaccard", F.lit(1.0)).alias("melody_trigram_jaccard"))


def chroma_cosine(source: DataFrame, output: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, chroma_cosine), by sounding length; 1 if both are silent."""
    weight = F.greatest("duration_ticks", F.lit(0)).cast("double")
    pc = F.pmod("pitch", F.lit(12)).alias("pc")
    both = source.select(key, pc, weight.alias("x"), F.lit(0.0).alias("y")).unionByName(output.select(key, pc, F.lit(0.0).alias("x"), weight.alias("y")))
    bins = both.groupBy(key, "pc").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = bins.groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    silent = F.when((F.col("xx") == 0) & (F.col("yy") == 0), F.lit(1.0)).otherwise(0.0)
    return sums.select(key, F.coalesce(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")), silent).alias("chroma_cosine"))


def _f1(matches, n_a, n_b):
    return F.when((n_a == 0) & (n_b == 0), F.lit(1.0)).otherwise(ratio(2 * matches, n_a + n_b))


def onset_exact_f1(source: DataFrame, output: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, onset_f1) of onset ticks that are equal."""
    sides = source.select(key, "tick", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(output.select(key, "tick", F.lit(0).alias("a"), F.lit(1).alias("b")))
    met = sides.groupBy(key, "tick").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = met.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("m"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return sums.select(key, _f1(F.col("m"), F.col("na"), F.col("nb")).alias("onset_f1"))


def _greedy(a: list[int], b: list[int], tolerance: float) -> int:
    used: set[int] = set()
    low = 0
    for x in a:
        while low < len(b) and b[low] < x - tolerance:
            low += 1
        best, i = None, low
        while i < len(b) and b[i] <= x + tolerance:
            if i not in used and (best is None or abs(b[i] - x) < abs(b[best] - x)):
                best = i
            i += 1
        if best is not None:
            used.add(best)
    return len(used)


def onset_f1(source: DataFrame, output: DataFrame, tolerance_ticks: float, key: str = "piece_id") -> DataFrame:
    """(key, onset_f1): each source onset in order takes the nearest unused
    output onset within the tolerance. Consuming is sequential, so the onsets of
    a piece meet in one Arrow row; a piece's onsets are bounded."""
    ticks = lambda n, c: n.groupBy(key).agg(F.array_sort(F.collect_set("tick")).alias(c))
    paired = ticks(source, "a").join(ticks(output, "b"), key, "full_outer")

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, a, b in zip(pdf[key], pdf["a"], pdf["b"], strict=True):
                a, b = ([] if x is None else [int(t) for t in x] for x in (a, b))
                rows.append((k, _greedy(a, b, tolerance_ticks), len(a), len(b)))
            yield pd.DataFrame(rows, columns=[key, "m", "na", "nb"])

    return paired.select(key, "a", "b").mapInPandas(matched, f"{key} long, m long, na long, nb long").select(key, _f1(F.col("m"), F.col("na"), F.col("nb")).alias("onset_f1"))


def semantic_equal(a: DataFrame, b: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, semantic_equal): the same note-on and note-off events, however the
    notes pair them."""
    def events(n: DataFrame, sign: int) -> DataFrame:
        on = F.struct(F.lit(1).alias("on"), "tick", "channel", "pitch", "velocity")
        off = F.struct(F.lit(0).alias("on"), (F.col("tick") + F.col("duration_ticks")).alias("tick"), "channel", "pitch", F.lit(0).alias("velocity"))
        return n.select(key, F.explode(F.array(on, off)).alias("e"), F.lit(sign).alias("sign"))

    net = events(a, 1).unionByName(events(b, -1)).groupBy(key, "e").agg(F.sum("sign").alias("net"))
    return net.groupBy(key).agg(F.bool_and(F.col("net") == 0).alias("semantic_equal"))


def content_metrics(source: DataFrame, output: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id", tolerance_beats: float = 1 / 16) -> DataFrame:
    """One row per key with the paired content metrics of source and output."""
    def side(notes: DataFrame, name: str) -> DataFrame:
        counts = notes.groupBy(key).agg(F.count("*").alias(f"note_count_{name}"), ratio(F.count_if(F.col("duration_ticks") <= 0), F.count("*")).alias(f"zero_duration_ratio_{name}"))
        ends = end_ticks(notes, key).withColumnRenamed("end_tick", f"end_tick_{name}")
        voices = polyphony(notes, key).select(key, F.col("max_polyphony").alias(f"max_polyphony_{name}"), F.col("mean_polyphony").alias(f"mean_polyphony_{name}"))
        bars = empty_bar_ratio(notes, meter, ticks_per_beat, key).withColumnsRenamed({"bar_count": f"bar_count_{name}", "empty_bar_ratio": f"empty_bar_ratio_{name}"})
        return counts.join(ends, key, "left").join(voices, key, "left").join(bars, key, "left")

    every = side(source, "input").join(side(output, "output"), key, "left").na.fill(0).na.fill(0.0)
    every = every.join(onset_f1(source, output, tolerance_beats * ticks_per_beat, key), key, "left").join(contour_similarity(source, output, key), key, "left").join(chroma_cosine(source, output, key), key, "left")
    gap = F.abs(F.col("end_tick_output") - F.col("end_tick_input"))
    return every.withColumns(
        {
            "nonempty": F.col("note_count_output") > 0,
            "length_error_ticks": gap,
            "length_error": gap / F.greatest("end_tick_input", F.lit(1)),
            "bar_count_preserved": F.col("bar_count_input") == F.col("bar_count_output"),
            "note_count_ratio": F.col("note_count_output") / F.greatest("note_count_input", F.lit(1)),
        }
    )


def constraint_report(source: DataFrame, output: DataFrame, transpose: int, most_voices: DataFrame, ticks_per_beat: int, key: str = "piece_id", preserved: DataFrame | None = None) -> DataFrame:
    """(key, violations, violation_score, feasible) of outputs against sources.

    ``source`` has is_melody flags; ``most_voices`` has (key, limit);
    ``preserved``, if given, has (key, roundtrip, ticks_per_beat, smf_format,
    meta), whether the output kept these.
    """
    fields = ["tick", "duration_ticks", "pitch", "channel", "velocity"]
    wanted = source.where("is_melody").withColumn("pitch", F.col("pitch") + transpose)
    sides = wanted.select(key, *fields, F.lit(1).alias("_w"), F.lit(0).alias("_h")).unionByName(output.select(key, *fields, F.lit(0).alias("_w"), F.lit(1).alias("_h")))
    lost = sides.groupBy(key, *fields).agg(F.sum("_w").alias("w"), F.sum("_h").alias("h")).groupBy(key).agg(F.bool_or(F.col("w") > F.col("h")).alias("melody_lost"))

    def side(notes: DataFrame, name: str) -> DataFrame:
        counts = notes.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.count_if(F.col("duration_ticks") <= 0).alias(f"zero_{name}"), F.max(F.col("tick") + F.col("duration_ticks")).alias(f"end_{name}"))
        return counts.join(polyphony(notes, key).select(key, F.col("max_polyphony").alias(f"voices_{name}")), key, "left")

    every = side(source, "a").join(side(output, "b"), key, "left").na.fill(0).join(lost, key, "left").join(most_voices, key, "left")
    gap = F.abs(F.col("end_b") - F.col("end_a"))
    error = gap / F.greatest("end_a", F.lit(1))
    share = F.col("n_b") / F.greatest("n_a", F.lit(1))
    kept = ("roundtrip", "ticks_per_beat", "smf_format", "meta") if preserved is not None else ()
    if preserved is not None:
        every = every.join(preserved.select(key, *kept), key, "left")
    checks = [
        ("empty_midi", F.col("n_b") == 0),
        *((name, ~F.coalesce(name, F.lit(False))) for name in kept),
        ("melody", F.col("melody_lost")),
        ("length", (gap > max(1, ticks_per_beat // 16)) | (error > 0.05)),
        ("note_count", ~share.between(0.9, 1.1)),
        ("polyphony", F.col("voices_b") > F.greatest("limit", "voices_a")),
        ("zero_duration_growth", F.col("zero_b") > F.col("zero_a")),
    ]
    found = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in checks]))
    return every.select(key, found.alias("violations"), error.alias("length_error"), share.alias("note_count_ratio"), F.col("voices_b").alias("max_polyphony")).select(
        "*", (F.size("violations") + F.col("length_error") + F.abs(F.col("note_count_ratio") - 1)).alias("violation_score"), (F.size("violations") == 0).alias("feasible")
    )


def task_content(source: DataFrame, parsed: DataFrame, pieces: DataFrame, meta: DataFrame, parsed_meta: DataFrame, key: str = "piece_id") -> DataFrame:
    """Content metrics of a task's output as it was parsed: lengths in beats, as
    a ratio and its error, note counts, voices, notes without length, and what
    of the source was preserved. ``pieces``: (key, ticks_per_beat)."""
    def side(notes: DataFrame, name: str) -> DataFrame:
        voices = polyphony(notes, key).select(key, F.col("max_polyphony").alias(f"max_polyphony_{name}"), F.col("mean_polyphony").alias(f"mean_polyphony_{name}"))
        counts = notes.groupBy(key).agg(F.count("*").alias(f"note_count_{name}"), ratio(F.count_if(F.col("duration_ticks") == 0), F.count("*")).alias(f"zero_duration_ratio_{name}"), F.max(F.col("tick") + F.col("duration_ticks")).alias(f"_end_{name}"))
        return counts.join(voices, key, "left")

    events = lambda m, name: m.groupBy(key).agg(F.count("*").alias(f"meta_event_count_{name}"))
    torn = meta.exceptAll(parsed_meta).unionAll(parsed_meta.exceptAll(meta)).select(key).distinct().withColumn("_torn", F.lit(True))
    every = pieces.select(key, "ticks_per_beat").join(side(source, "input"), key).join(side(parsed, "output"), key, "left")
    every = every.join(events(meta, "input"), key, "left").join(events(parsed_meta, "output"), key, "left").join(torn, key, "left").na.fill(0)
    length = F.when(F.col("_end_input") > 0, F.col("_end_output") / F.col("_end_input")).otherwise(1.0)
    return every.withColumns(
        {
            "length_beats_input": F.col("_end_input") / F.col("ticks_per_beat"),
            "length_beats_output": F.col("_end_output") / F.col("ticks_per_beat"),
            "length_ratio": length,
            "length_error": F.abs(length - 1),
            "note_count_ratio": F.when(F.col("note_count_input") > 0, F.col("note_count_output") / F.col("note_count_input")).otherwise(1.0),
            "meta_preserved": ~F.coalesce("_torn", F.lit(False)),
        }
    ).drop("_end_input", "_end_output", "_torn", "ticks_per_beat")
