"""Feature vectors of pieces: 42 legacy, 93 composition, 67 style features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite_or, half_even, ratio
from .histograms import dense_bins, entropy, estimated_key, histogram, tonal_clarity
from .intervals import polyphony, rest_ratio
from .melody import best_lag, contour, melody_flags, ngram_stats, ngrams, skyline, successive
from .meter import mean_tempo, notes_in_bars, positions
from .pieces import composition_vectors

CONTOURS = ("down", "same", "up")
CONSONANT = (0, 3, 4, 5, 7, 8, 9)


def _named(prefix: str, labels) -> list[str]:
    return [f"{prefix}_{x}" for x in labels]


COMPOSITION_GROUPS: dict[str, list[str]] = {
    "pitch": ["pitch_range", "pitch_mean", "pitch_std", "pitch_entropy", *_named("pitch_class", range(12))],
    "melody": [
        "directed_interval_mean", "directed_interval_std", "absolute_interval_mean", "absolute_interval_std",
        "ascending_interval_ratio", "descending_interval_ratio", "repeated_interval_ratio", "stepwise_interval_ratio",
        "leap_interval_ratio", *_named("absolute_interval_class", range(13)),
        *_named("contour_bigram", [f"{a}_{b}" for a in CONTOURS for b in CONTOURS]),
    ],
    "rhythm": [
        "duration_mean", "duration_std", "duration_median", "duration_cv",
        *_named("duration_bin", ("lt_1_4", "1_4_to_1_2", "1_2_to_1", "1_to_2", "ge_2")),
        "ioi_mean", "ioi_std", "ioi_cv", "downbeat_onset_ratio", "metrical_pulse_onset_ratio", "offbeat_onset_ratio",
        "syncopated_note_ratio",
    ],
    "texture": ["mean_polyphony", "max_polyphony", "chord_onset_ratio", "chord_size_mean", "chord_size_std", "chord_size_max", "monophonic_onset_ratio"],
    "harmony": [*_named("duration_chroma", range(12)), "chroma_entropy", "tonal_clarity", "chord_consonance_ratio", "successive_chroma_jaccard", "bass_motion_mean"],
    "structure": [
        "pitch_trigram_repeat_ratio", "pitch_trigram_vocabulary_ratio", "rhythm_trigram_repeat_ratio", "rhythm_trigram_vocabulary_ratio",
        "pitch_best_lag_similarity", "rhythm_best_lag_similarity",
    ],
}
COMPOSITION_FEATURES = [name for names in COMPOSITION_GROUPS.values() for name in names]
LEGACY_FEATURES = ["tempo_bpm", *_named("pitch_class", range(12)), *_named("interval", range(-12, 13)), "note_density_per_s", "mean_note_duration_s", "std_note_duration_s", "rest_ratio"]
STYLE_GROUPS = {"rhythm": [*_named("onset_bin", range(16)), *_named("duration_bin", range(6))], "pitch": [*_named("pitch_class", range(12)), *_named("melody_interval", range(-12, 13))], "texture": _named("chord_size", range(1, 9))}
STYLE_FEATURES = [name for names in STYLE_GROUPS.values() for name in names]


def spread(df: DataFrame, key: str, values: str, names: list[str]) -> DataFrame:
    """(key, one column per name) from an array column."""
    return df.select(key, *[F.col(values)[i].alias(n) for i, n in enumerate(names)])


def long_vector(wide: DataFrame, names: list[str], key: str = "piece_id") -> DataFrame:
    """(key, idx, name, value) from one column per name."""
    cells = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)])
    return wide.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def packed(wide: DataFrame, names: list[str], key: str = "piece_id", into: str = "vector") -> DataFrame:
    """(key, array of doubles) in the frozen order of names."""
    return wide.select(key, F.array(*[F.col(n).cast("double") for n in names]).alias(into))


def _joined(first: DataFrame, *rest: DataFrame, key: str) -> DataFrame:
    for df in rest:
        first = first.join(df, key, "left")
    return first


def pitch_features(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    shares = histogram(notes, F.pmod("pitch", F.lit(12)), 12, key)
    basic = notes.groupBy(key).agg((F.max("pitch") - F.min("pitch")).cast("double").alias("pitch_range"), F.avg("pitch").alias("pitch_mean"), F.stddev_pop("pitch").alias("pitch_std"))
    return _joined(basic, shares.select(key, entropy(F.col("values")).alias("pitch_entropy")), spread(shares, key, "values", _named("pitch_class", range(12))), key=key)


def melody_features(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    steps = successive(skyline(notes, key), F.col("pitch"), "step", key).where("step IS NOT NULL").withColumn("size", F.abs("step"))
    share = lambda p: F.avg(p.cast("double"))
    basic = steps.groupBy(key).agg(
        F.avg("step").alias("directed_interval_mean"), F.stddev_pop("step").alias("directed_interval_std"),
        F.avg("size").alias("absolute_interval_mean"), F.stddev_pop("size").alias("absolute_interval_std"),
        share(F.col("step") > 0).alias("ascending_interval_ratio"), share(F.col("step") < 0).alias("descending_interval_ratio"),
        share(F.col("step") == 0).alias("repeated_interval_ratio"), share(F.col("size") <= 2).alias("stepwise_interval_ratio"),
        share(F.col("size") >= 5).alias("leap_interval_ratio"),
    )
    classes = histogram(steps, F.least("size", F.lit(12)), 13, key)
    pairs = histogram(ngrams(contour(notes, key), "sign", 2, key), (F.col("g0") + 1) * 3 + F.col("g1") + 1, 9, key)
    names = COMPOSITION_GROUPS["melody"]
    return _joined(notes.select(key).distinct(), basic, spread(classes, key, "values", names[9:22]), spread(pairs, key, "values", names[22:]), key=key).na.fill(0.0)


def rhythm_features(notes: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    beats = F.col("duration_ticks") / ticks_per_beat
    lengths = notes.withColumn("beats", beats)
    basic = lengths.groupBy(key).agg(
        F.avg("beats").alias("duration_mean"), F.stddev_pop("beats").alias("duration_std"), F.percentile("beats", F.lit(0.5)).alias("duration_median"),
    ).withColumn("duration_cv", ratio(F.col("duration_std"), F.col("duration_mean")))
    bins = histogram(lengths, dense_bins(F.col("beats"), (0.25, 0.5, 1.0, 2.0)), 5, key)
    onsets = notes.select(key, "tick").distinct()
    gaps = successive(onsets, F.col("tick"), "gap", key).where("gap IS NOT NULL").withColumn("ioi", F.col("gap") / ticks_per_beat)
    iois = gaps.groupBy(key).agg(F.avg("ioi").alias("ioi_mean"), F.stddev_pop("ioi").alias("ioi_std")).withColumn("ioi_cv", ratio(F.col("ioi_std"), F.col("ioi_mean")))
    share = lambda p: F.avg(p.cast("double"))
    placed = positions(onsets, meter, ticks_per_beat, key).groupBy(key).agg(
        share(F.col("bar_position") == 0).alias("downbeat_onset_ratio"), share(F.col("pulse_position") == 0).alias("metrical_pulse_onset_ratio"),
        share(F.col("pulse_position") * 2 == F.col("pulse_length")).alias("offbeat_onset_ratio"),
    )
    held = F.col("duration_ticks") * F.col("denominator") > F.col("pulse_length") - F.col("pulse_position")
    off = positions(notes, meter, ticks_per_beat, key).groupBy(key).agg(share((F.col("pulse_position") > 0) & held).alias("syncopated_note_ratio"))
    return _joined(basic, spread(bins, key, "values", COMPOSITION_GROUPS["rhythm"][4:9]), iois, placed, off, key=key).na.fill(0.0)


def texture_features(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    sizes = notes.groupBy(key, "tick").agg(F.count("*").alias("size"))
    chords = sizes.groupBy(key).agg(
        F.avg((F.col("size") >= 2).cast("double")).alias("chord_onset_ratio"), F.avg("size").alias("chord_size_mean"), F.stddev_pop("size").alias("chord_size_std"),
        F.max("size").cast("double").alias("chord_size_max"), F.avg((F.col("size") == 1).cast("double")).alias("monophonic_onset_ratio"),
    )
    voices = polyphony(notes, key, zero_span="max").select(key, "mean_polyphony", F.col("max_polyphony").cast("double").alias("max_polyphony"))
    return _joined(chords, voices, key=key).na.fill(0.0)


def chord_pairs(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, tick, interval_class) of every pair of notes of an onset, from one
    array per onset instead of a self join."""
    chord = notes.groupBy(key, "tick").agg(F.sort_array(F.collect_list("pitch")).alias("p")).where(F.size("p") > 1)
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.pmod(y - x, F.lit(12)))))
    return chord.select(key, "tick", F.explode(pairs).alias("interval_class"))


def successive_chroma(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    """(key, tick, jaccard, bass_step): each onset against the one before."""
    chord = notes.groupBy(key, "tick").agg(F.collect_set(F.pmod("pitch", F.lit(12))).alias("chroma"), F.min("pitch").alias("bass"))
    w = Window.partitionBy(key).orderBy("tick")
    before = chord.withColumn("last", F.lag("chroma").over(w)).withColumn("bass_step", F.abs(F.col("bass") - F.lag("bass").over(w))).where("last IS NOT NULL")
    return before.select(key, "tick", ratio(F.size(F.array_intersect("chroma", "last")), F.size(F.array_union("chroma", "last"))).alias("jaccard"), "bass_step")


def harmony_features(notes: DataFrame, key: str = "piece_id") -> DataFrame:
    chroma = histogram(notes, F.pmod("pitch", F.lit(12)), 12, key, weight=F.col("duration_ticks"))
    consonance = chord_pairs(notes, key).groupBy(key).agg(F.avg(F.col("interval_class").isin(*CONSONANT).cast("double")).alias("chord_consonance_ratio"))
    motion = successive_chroma(notes, key).groupBy(key).agg(F.avg("jaccard").alias("successive_chroma_jaccard"), F.avg("bass_step").alias("bass_motion_mean"))
    bits = chroma.select(key, entropy(F.col("values")).alias("chroma_entropy"))
    return _joined(spread(chroma, key, "values", COMPOSITION_GROUPS["harmony"][:12]), bits, tonal_clarity(chroma, key), consonance, motion, key=key).na.fill(0.0)


def structure_features(notes: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    pitches = skyline(notes, key).withColumn("x", F.pmod("pitch", F.lit(12)))
    gaps = successive(notes.select(key, "tick").distinct(), F.col("tick"), "gap", key).where("gap IS NOT NULL")
    rhythms = gaps.withColumn("x", half_even(F.col("gap") / ticks_per_beat * 8))
    parts = []
    for name, rows in (("pitch", pitches), ("rhythm", rhythms)):
        stats = ngram_stats(ngrams(rows, "x", 3, key), key)
        parts.append(stats.select(key, F.col("repeat_ratio").alias(f"{name}_trigram_repeat_ratio"), F.col("vocabulary_ratio").alias(f"{name}_trigram_vocabulary_ratio")))
        parts.append(best_lag(rows, "x", key).withColumnRenamed("best_lag_similarity", f"{name}_best_lag_similarity"))
    return _joined(notes.select(key).distinct(), *parts, key=key).na.fill(0.0)


def composition_vector(notes: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, the 93 features): tempo and velocity play no part. Measured a piece
    at a time, so that the notes are shuffled once."""
    return spread(composition_vectors(notes, meter, ticks_per_beat, key), key, "vector", COMPOSITION_FEATURES)


def composition_groups(notes: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """As :func:`composition_vector`, from the operators of the six groups."""
    return _joined(
        pitch_features(notes, key), melody_features(notes, key), rhythm_features(notes, meter, ticks_per_beat, key),
        texture_features(notes, key), harmony_features(notes, key), structure_features(notes, ticks_per_beat, key), key=key,
    ).select(key, *COMPOSITION_FEATURES)


def variants() -> dict[str, list[str]]:
    """Feature names of ``full``, ``only_<group>`` and ``without_<group>``."""
    found = {"full": COMPOSITION_FEATURES}
    for group, names in COMPOSITION_GROUPS.items():
        found[f"only_{group}"] = names
        found[f"without_{group}"] = [n for n in COMPOSITION_FEATURES if n not in names]
    return found


def legacy_vector(pieces: DataFrame, notes: DataFrame, tempo: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, key_name, the 42 features); a piece without notes is neutral: 120
    BPM, C major, flat pitch classes, rest ratio 1."""
    bpm = mean_tempo(pieces, tempo, key)
    shares = histogram(notes, F.pmod("pitch", F.lit(12)), 12, key)
    steps = successive(skyline(notes, key), F.col("pitch"), "step", key).where("step IS NOT NULL")
    intervals = histogram(steps, F.least(F.greatest("step", F.lit(-12)), F.lit(12)) + 12, 25, key)
    long = F.greatest("duration_ticks", F.lit(0))
    lengths = notes.groupBy(key).agg(F.count("*").alias("_n"), F.avg(long).alias("_mean"), F.stddev_pop(long).alias("_std"))
    rests = rest_ratio(notes, key).select(key, "end_tick", "rest_ratio")
    every = _joined(bpm, shares.withColumnRenamed("values", "_pc"), intervals.withColumnRenamed("values", "_iv"), lengths, rests, estimated_key(shares, key), key=key)
    second = F.try_divide(F.lit(60.0), F.col("tempo_bpm") * ticks_per_beat)
    flat = F.array(*[F.lit(1.0 / 12)] * 12)
    none = F.array(*[F.lit(0.0)] * 25)
    density = finite_or(F.try_divide(F.col("_n").cast("double"), F.col("end_tick") * second), 0.0)
    whole = every.select(
        key, F.coalesce("key_name", F.lit("C major")).alias("key_name"),
        F.when(F.col("_n").isNull(), F.lit(120.0)).otherwise(F.col("tempo_bpm")).alias("tempo_bpm"),
        F.coalesce("_pc", flat).alias("_pc"), F.coalesce("_iv", none).alias("_iv"), density.alias("note_density_per_s"),
        F.coalesce(F.col("_mean") * second, F.lit(0.0)).alias("mean_note_duration_s"), F.coalesce(F.col("_std") * second, F.lit(0.0)).alias("std_note_duration_s"),
        F.coalesce("rest_ratio", F.lit(1.0)).alias("rest_ratio"),
    )
    return whole.select(
        key, "key_name", "tempo_bpm", *[F.col("_pc")[i].alias(f"pitch_class_{i}") for i in range(12)],
        *[F.col("_iv")[i].alias(f"interval_{i - 12}") for i in range(25)], *LEGACY_FEATURES[38:],
    )


def structured_notes(notes: DataFrame, meter: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """Notes with bar_index, bar_start, bar_end, ordinal, is_melody, ambiguous."""
    return notes_in_bars(melody_flags(notes, key), meter, ticks_per_beat, key)


def style_vector(structured: DataFrame, ticks_per_beat: int, key: str = "piece_id") -> DataFrame:
    """(key, the 67 features): histograms of the accompaniment, and chord sizes."""
    onset = Window.partitionBy(key, "tick")
    marked = structured.withColumn("_top", F.max(F.when(F.col("is_melody"), F.col("pitch"))).over(onset))
    rest = marked.where("NOT is_melody")
    length = F.greatest(F.col("bar_end") - F.col("bar_start"), F.lit(1))
    where = F.least(F.floor((F.col("tick") - F.col("bar_start")) * 16 / length), F.lit(15))
    delta = F.least(F.greatest(F.col("pitch") - F.coalesce("_top", "pitch") + 12, F.lit(0)), F.lit(24))
    sizes = structured.groupBy(key, "tick").agg(F.count("*").alias("size"))
    parts = [
        (histogram(rest, where, 16, key), STYLE_FEATURES[:16]),
        (histogram(rest, dense_bins(F.col("duration_ticks") / ticks_per_beat, (0.25, 0.5, 1.0, 2.0, 4.0)), 6, key), STYLE_FEATURES[16:22]),
        (histogram(rest, F.pmod("pitch", F.lit(12)), 12, key), STYLE_FEATURES[22:34]),
        (histogram(rest, delta, 25, key), STYLE_FEATURES[34:59]),
        (histogram(sizes, F.least(F.col("size") - 1, F.lit(7)), 8, key), STYLE_FEATURES[59:]),
    ]
    return _joined(structured.select(key).distinct(), *[spread(h, key, "values", names) for h, names in parts], key=key).na.fill(0.0)


def group_of(feature: Column, groups: dict[str, list[str]]) -> Column:
    found = F.lit(None).cast("string")
    for group, names in groups.items():
        found = F.when(feature.isin(*names), group).otherwise(found)
    return found
