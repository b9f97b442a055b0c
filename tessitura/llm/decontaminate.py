"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of edge punctuation; numbers, units after
numbers, and names (capitalised words, wherever they stand, so that a passage
has one template in any context) become typed placeholders. Windows of such
templates are hash-joined with those of the benchmark, their words are then
compared, and so are the values behind the placeholders, over each passage:
alignments that a few inserted or missing words set apart are one passage. One
benchmark value must always stand for one document value, and one document value
for one benchmark value; windows with another value do not count. So
re-parameterised questions match, and texts that only share a shape do not.
Windows that equal the benchmark's word for word, in any case of letters, can
count without their template; those that are less than half literal, whose
templates are too common, count only so.

The windows of documents pass a bitmap of fixed size first, made from the
benchmark's hashes; the join behind it is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, raw_texts, small_batches, staged, window_hashes

WINDOW = 8
#: Share of an item's windows that a document must have, consistently.
COVERAGE = 0.5
#: Items of fewer words are too common as windows; only whole texts match them.
LEAST_WORDS = 4
BITS = 1 << 22
#: Sets the hashes of windows of plain words apart from those of templates.
PLAIN = 1 << 32

LITERAL, NUMBER, UNIT, NAME, EMPTY = range(5)
EDGES = b".,;:!?%&*#|\"'()[]{}<>-_/\\$"
_NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*(st|nd|rd|th)?$")
# Units of measure.
UNITS = frozenset(
    b"mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg lb lbs oz ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    b"s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal "
    b"c f k degree degrees percent dollar dollars euro euros cent cents pound pounds usd eur gbp kb mb gb tb".split()
)


def _fact(word: bytes) -> tuple[int, int]:
    """(kind, hash of the bare lower-case word)."""
    bare = word.strip(EDGES)
    if not bare:
        return EMPTY, 0
    if _NUMBER.match(bare):
        return NUMBER, xxhash.xxh3_64_intdigest(bare.lower())
    low = bare.lower()
    kind, text = LITERAL, bare.decode("utf-8", "replace")
    if low in UNITS:
        kind = UNIT
    elif len(text) > 1 and text[0].isupper() and text[1:].islower():
        kind = NAME
    return kind, xxhash.xxh3_64_intdigest(low if bare.isascii() else text.lower().encode())


def template(text: bytes | None, known: WordTable) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, template hash of each, its kind) without empty words."""
    words, _, hashes, kind = parsed(text, known)
    return words, hashes, kind


def parsed(text: bytes | None, known: WordTable) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`template`, with the hash of each lower-case word after the words."""
    words = text.split() if text else []
    if not words:
        return [], np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    facts = known.of(words)
    kind = facts[:, 0].astype(np.int64)
    real = np.flatnonzero(kind != EMPTY)
    kind, hashes = kind[real], facts[real, 1]
    after = np.concatenate([[False], kind[:-1] == NUMBER])
    kind[(kind == UNIT) & ~after] = LITERAL
    return [words[i] for i in real], hashes, np.where(kind == LITERAL, hashes, kind.astype(np.uint64)), kind


def windows(hashes: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of a template that are half literal
    at least."""
    found = window_hashes(hashes, width) + np.uint64(width)
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    at = np.flatnonzero(2 * (literal[width:] - literal[:-width]) >= width) if len(found) else np.zeros(0, np.int64)
    return at, found[at]


def _slots(at: int, width: int, words: list[bytes], kind: np.ndarray) -> list[str]:
    return [words[i].strip(EDGES).lower().decode("utf-8", "replace") for i in range(at, at + width) if kind[i] != LITERAL]


def _canonical(at: int, width: int, words: list[bytes], kind: np.ndarray, plain: bool) -> str:
    """What two windows with one hash must have in common."""
    return " ".join(str(kind[i]) + "\0" if kind[i] != LITERAL and not plain else words[i].strip(EDGES).decode("utf-8", "replace").lower() for i in range(at, at + width))


_OUT = "id long, at int, run int, hash long, words string, slots array<string>, plain boolean, half boolean, total int, halves int, wide int"


def _runs(at: np.ndarray, found: np.ndarray, is_plain: np.ndarray, is_half: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The first of every run of equal windows without values, and its length."""
    if not len(at):
        return at, at, found, is_plain
    values = np.concatenate([[0], np.cumsum(kind != LITERAL)])
    free = values[at + width] == values[at]
    goes_on = free[1:] & free[:-1] & (at[1:] == at[:-1] + 1) & (found[1:] == found[:-1]) & (is_plain[1:] == is_plain[:-1]) & (is_half[at[1:]] == is_half[at[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return at[first], np.diff(np.append(first, len(at))), found[first], is_plain[first]


def _windowed(table: DataFrame, key: str, width: int, plain: bool, bits=None) -> DataFrame:
    """Windows of templates that are half literal at least, and windows of
    lower-case words: those that are not, with ``plain`` or ``bits`` all.

    Windows without values that follow each other and are equal, as a repeated
    word makes them, are one row: ``run`` of them from ``at`` on.

    ``halves`` counts the former where they hold half the words of a text at
    least, and is 0 else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(_fact, 2)
        near = None if bits is None else np.unpackbits(np.frombuffer(bits.value[0], np.uint8)).astype(bool)
        widths = None if bits is None else bits.value[1]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                words, lower, hashes, kind = parsed(text, known)
                # A short item is one window; documents have windows of every such width.
                for w in ([min(width, len(words))] if widths is None else widths) if words else ():
                    if w < LEAST_WORDS and len(words) != w:
                        continue
                    at, found = windows(hashes, kind, w)
                    same = window_hashes(lower, w) + np.uint64(w + PLAIN)
                    total, n = len(same), len(at)
                    is_half = np.zeros(total, bool)
                    is_half[at] = True
                    held = int((np.convolve(is_half, np.ones(w, np.int64)) > 0).sum()) if near is None else 0
                    halves = n if 2 * held >= len(words) else 0
                    # A document's kinds may differ from the item's, so all its windows count here.
                    where = np.arange(total) if plain or near is not None or w < LEAST_WORDS else np.flatnonzero(~is_half)
                    at, found = np.concatenate([at, where]), np.concatenate([found, same[where]])
                    is_plain = np.arange(len(at)) >= n
                    if near is not None:
                        hit = near[(found & np.uint64(BITS - 1)).astype(np.int64)] & near[(found >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64)]
                        at, found, is_plain = at[hit], found[hit], is_plain[hit]
                    at, run, found, is_plain = _runs(at, found, is_plain, is_half, kind, w)
                    rows.extend(
                        (key, a, r, h, _canonical(a, w, words, kind, p), _slots(a, w, words, kind), p, f, total, halves, w)
                        for a, r, h, p, f in zip(at.tolist(), run.tolist(), found.view(np.int64).tolist(), is_plain.tolist(), is_half[at].tolist(), strict=True)
                    )
            columns = list(zip(*rows, strict=True)) or [()] * 11
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "at", "run", "hash", "words", "slots", "plain", "half", "total", "halves", "wide"])

    return table.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: float = COVERAGE, lenient: bool = False) -> DataFrame:
    """Pairs of a row of ``docs`` (doc_id, text) and a benchmark item (item_id,
    text) of which it holds ``coverage`` of the template windows or more, along
    alignments with consistent slot values. Whole texts are read.

    Windows less than half literal match word for word only, in any case of
    letters. As new values change them, an item of which the other windows hold
    half the words is judged by those alone too, and the larger share counts.

    Where several document values stand for one benchmark value in a passage,
    or one for several, the windows with that value do not count; the others do.
    With ``lenient``, those with the value found in most windows count (ties: the
    greater string), and so does every window that equals the item's word for
    word, whatever its values and the case of its letters.

    Items with fewer than ``width`` words are one window of their own length;
    those with fewer than ``LEAST_WORDS`` are held by texts of these words only.
    Null and empty texts hold nothing and are held by nothing, so are rows with
    a null id; rows that repeat a doc_id count as one document. Other columns
    are ignored.

    Returns doc_id, item_id, n_windows, n_matched, coverage, n_slots (values
    compared in the windows that count).
    """
    spark = docs.sparkSession
    items = staged(_windowed(benchmark.where("item_id IS NOT NULL"), "item_id", width, lenient))
    # At most BITS rows, whatever the size of the benchmark.
    marks = items.select(F.explode(F.array(F.pmod("hash", F.lit(BITS)), F.pmod(F.shiftrightunsigned("hash", 40), F.lit(BITS)))).alias("bit")).distinct()
    on = np.zeros(BITS, np.uint8)
    on[marks.toArrow().column("bit").to_numpy()] = 1
    wides = sorted({width, *(r.wide for r in items.select("wide").distinct().collect())})  # at most `width` values
    bits = spark.sparkContext.broadcast((np.packbits(on).tobytes(), wides))

    left = _windowed(docs.where("doc_id IS NOT NULL"), "doc_id", width, lenient, bits).select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), F.col("run").alias("doc_run"), "hash", "words", F.col("slots").alias("doc_slots"))
    right = items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("run").alias("item_run"), "hash", "words", F.col("slots").alias("item_slots"), "plain", "half", "total", "halves")
    with small_batches(spark):
        met = staged(
            left.join(right, ["hash", "words"])
            .drop("words")
            # Equal words have equal values, though kinds may differ.
            .withColumn("doc_slots", F.when(F.col("plain"), F.col("item_slots")).otherwise(F.col("doc_slots")))
            .where(F.size("doc_slots") == F.size("item_slots"))
            # Two runs meet at every shift between these, which are without gaps.
            .withColumn("low", F.col("doc_at") - F.col("item_at") - F.col("item_run") + 1)
            .withColumn("high", F.col("doc_at") + F.col("doc_run") - 1 - F.col("item_at"))
        )
    # Shifts that follow each other within a window's width are one passage.
    pair = ["doc_id", "item_id"]
    by_shift = Window.partitionBy(*pair).orderBy("low", "high")
    reached = F.max("high").over(by_shift.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("low") - reached > width).cast("int"), F.lit(0))
    passages = met.select(*pair, "low", "high").distinct().withColumn("starts", starts).withColumn("passage", F.sum("starts").over(by_shift)).drop("starts")
    line = [*pair, "passage"]
    met = met.join(passages, [*pair, "low", "high"])
    times = (F.col("doc_run") * F.col("item_run")).cast("long").alias("times")
    values = met.select(*line, times, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("x")).groupBy(*line, "x.item_slots", "x.doc_slots").agg(F.sum("times").alias("n"))

    def one_for_one(of: str, to: str, name: str) -> DataFrame:
        """(line, name): for each value ``of`` with several ``to``, which one counts, if any."""
        most = F.max_by(to, F.struct("n", to)) if lenient else F.lit(None).cast("string")
        several = values.groupBy(*line, of).agg(most.alias("keep"), F.count("*").alias("n")).where("n > 1")
        return several.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct(of, "keep"))).alias(name))

    # The values of one passage at most are in a map.
    clash = lambda name, of, to: F.expr(f"coalesce(exists(arrays_zip(item_slots, doc_slots), x -> map_contains_key({name}, x.{of}) AND NOT ({name}[x.{of}] <=> x.{to})), false)")
    good = (
        met.join(one_for_one("item_slots", "doc_slots", "forth"), line, "left")
        .join(one_for_one("doc_slots", "item_slots", "back"), line, "left")
        .where(F.col("plain") | ~(clash("forth", "item_slots", "doc_slots") | clash("back", "doc_slots", "item_slots")))
    )
    good = good.withColumn("item_at", F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.col("item_run") - 1)))
    return (
        good.groupBy(*pair)
        .agg(
            F.max("total").cast("long").alias("n_windows"),
            F.count_distinct("item_at").alias("n_matched"),
            F.max("halves").alias("halves"),
            F.count_distinct(F.when(F.col("half"), F.col("item_at"))).alias("n_halves"),
            F.size(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "doc_slots"))))).cast("long").alias("n_slots"),
        )
        .withColumn("coverage", F.greatest(F.col("n_matched") / F.col("n_windows"), F.when(F.col("halves") > 0, F.col("n_halves") / F.col("halves"))))
        .where(F.col("coverage") >= coverage)
        .select(*pair, "n_windows", "n_matched", "coverage", "n_slots")
    )
