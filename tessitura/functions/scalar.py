"""Scalar column functions with the semantics that the score operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = 18446744073709551616.0


def half_even(x: Column) -> Column:
    """Nearest whole number, ties to even, as a long."""
    return F.bround(x, 0).cast("long")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def r6(x: Column) -> Column:
    """Rounded for comparison across engines; never negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def hash_bits(*key: Column) -> Column:
    """First 64 bits of sha256 of the parts joined by ``|``, as decimal(20,0)."""
    digest = F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def hash_uniform(*key: Column) -> Column:
    """Uniform in [0, 1), reproducible from its key."""
    return hash_bits(*key).cast("double") / F.lit(TWO_64)


def hash_ordinal(n: Column, *key: Column) -> Column:
    """Whole number in [0, n), reproducible from its key."""
    return F.pmod(hash_bits(*key), n.cast("decimal(20,0)")).cast("long")


def finite_or(x: Column, neutral: float) -> Column:
    """``neutral`` where x is null, NaN or infinite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(neutral)).otherwise(x)


def json_safe(x: Column) -> Column:
    """Null where x is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by ``-``; common accents are folded."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Coarse musical forms by ordered token rules.
FORMS = (
    ("prelude_fugue", ("prelude", "fugue")),
    ("sonata", ("sonata", "piano_sonatas")),
    ("etude", ("etude", "etudes")),
    ("ballade", ("ballade", "ballades")),
    ("scherzo", ("scherzo", "scherzi")),
    ("concerto", ("concerto",)),
    ("mazurka", ("mazurka", "mazurkas")),
    ("nocturne", ("nocturne", "nocturnes")),
    ("polonaise", ("polonaise", "polonaises")),
    ("waltz", ("waltz", "waltzes", "valse")),
)


def musical_form(title: Column) -> Column:
    """First form whose token occurs in the normalised title, else ``other``."""
    name = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_")
    found = F.lit("other")
    for form, tokens in reversed(FORMS):
        hit = F.lit(False)
        for token in tokens:
            hit = hit | name.contains(token)
        found = F.when(hit, form).otherwise(found)
    return found


def clip_seconds(seconds: Column, limit: int = 15) -> Column:
    """A clip's length clamped to [0, limit]."""
    return clamp(seconds, 0, limit)


def seconds_per_tick(bpm: Column, ticks_per_beat: Column) -> Column:
    """0 for degenerate tempo or resolution."""
    return F.when((ticks_per_beat <= 0) | (bpm <= 0), F.lit(0.0)).otherwise(
        F.try_divide(F.lit(60.0), bpm * ticks_per_beat)
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))


KEY_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def transpose_key(key: Column, semitones: Column) -> Column:
    """``"C# minor"`` moved by semitones on the circle of names."""
    names = F.array(*map(F.lit, KEY_NAMES))
    tonic, mode = F.split(key, " ")[0], F.split(key, " ")[1]
    at = F.pmod(F.array_position(names, tonic) - 1 + semitones, F.lit(12))
    return F.concat_ws(" ", F.element_at(names, (at + 1).cast("int")), mode)


def tempo_microseconds(tempo: Column, bpm: Column) -> Column:
    """Tempo in microseconds a beat from either, 500000 without both; null
    outside what a MIDI file can hold."""
    value = F.coalesce(tempo.cast("long"), half_even(F.try_divide(F.lit(60e6), bpm)), F.lit(500000))
    return F.when(value.between(1, (1 << 24) - 1), value)


def task_id(phase: Column, repeat: Column, fold: Column, source: Column, target: Column) -> Column:
    return F.format_string("%s__r%02d__f%02d__%s__%s", phase, repeat, fold, source.cast("string"), target)


def masked_euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def valid_vector(a: Column) -> Column:
    """Not empty and finite throughout."""
    return (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def comparable(a: Column, b: Column) -> Column:
    """Both valid and of one length, so that a distance between them is defined."""
    return F.coalesce(valid_vector(a) & valid_vector(b) & (F.size(a) == F.size(b)), F.lit(False))


def preferred_bin(histogram: Column, current: Column) -> Column:
    """Bin of the largest mass, then the nearest to ``current``, then the
    lowest; ``current`` if the histogram is empty."""
    ranked = F.transform(
        histogram, lambda m, i: F.struct((-m).alias("m"), F.abs(i - current).alias("d"), i.cast("int").alias("i"))
    )
    best = F.array_min(F.filter(ranked, lambda r: r["m"] < 0))
    return F.coalesce(best["i"], current.cast("int"))
