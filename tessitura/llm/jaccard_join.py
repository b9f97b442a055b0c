"""Near-duplicate links by an n-gram Jaccard join with vertical partitioning.

Tasks hash the shingles of whole texts to 64 bits and send, per hash range,
what each distinct set has there, packed. A range sees every set that holds one
of its n-grams, so it alone can count their document frequencies; n-grams of
one set only, most of them, end here and never become rows. The number of
ranges follows from the bytes of text, so what one task holds is bounded
whatever the corpus.

The global order of the n-grams is by document frequency, then hash. Two sets
can only be similar if prefixes under this order meet. Candidates are verified
exactly: the order is cut into fragments at quantiles, overlaps are counted in
each fragment by itself and summed per pair.

Groups of near copies are not expanded into all pairs. Each bucket of the
prefix index first compares its members with one leader; after that only
pairs whose members are still in different components are compared. A link
between them is all that can change a component, so none is lost. They meet by
n-gram and class of length, and the shorter set of a pair, which must share
8/9 of its n-grams, is indexed by its first ninth only: sets whose own n-grams
fill it, such as pages of one template, meet nobody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, partitions, raw_texts, small_batches, staged, window_hashes
from .components import components

WIDTH = 5
#: Overlap counting cuts the order into this many fragments.
COUNT_FRAGMENTS = 4
#: Bytes of text per hash range, and the least ranges. A shingle takes two bytes
#: of text at least, most take six.
RANGE_BYTES = 8_000_000
LEAST_RANGES = 16
#: Shingles per packed batch, and the sets of one batch that make an n-gram hot.
BATCH = 500_000
#: Ranges that a batch is dealt over; where there are more, it is dealt over
#: groups of ranges first, and what meets in a group over its ranges.
FAN = 4096
HOT = 64
MOST = (1 << 31) - 1

_SCHEMA = "key int, payload binary, doc_id long, n long, sig long"
_ENTRIES = "doc_id long, n long, sig long, s long, df int"


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; A-Z lower-cased,
    ASCII white space separates; fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(width, len(words))))


def _pack(sig: np.ndarray, n: np.ndarray, count: np.ndarray, gram: np.ndarray, hot: np.ndarray) -> bytes:
    head = np.array([len(sig), len(gram), len(hot)], "<i8").tobytes()
    return b"".join((head, *(x.astype("<u8").tobytes() for x in (sig, gram, hot)), *(x.astype("<u4").tobytes() for x in (n, count))))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sig, n and number of n-grams of each set, the n-grams, the hot n-grams."""
    k, m, h = np.frombuffer(raw, "<i8", 3).tolist()
    sig, gram, hot = (np.frombuffer(raw, "<u8", size, 24 + 8 * at) for size, at in ((k, 0), (m, k), (h, k + m)))
    n, count = (np.frombuffer(raw, "<u4", k, 24 + 8 * (k + m + h) + 4 * at) for at in (0, k))
    return sig, n, count, gram, hot


def _range_of(gram: np.ndarray, ranges: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _by_range(of: np.ndarray, hot_of: np.ndarray, doc: np.ndarray, sig: np.ndarray, lengths: np.ndarray, gram: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, payload) of the ranges that are met, and of no others."""
    order = np.argsort(of, kind="stable")
    met = np.union1d(of, hot_of)
    cuts, ends = np.searchsorted(of[order], met, "left"), np.searchsorted(of[order], met, "right")
    hot_order = np.argsort(hot_of, kind="stable")
    hot_cuts, hot_ends = np.searchsorted(hot_of[hot_order], met, "left"), np.searchsorted(hot_of[hot_order], met, "right")
    for r, a, b, x, y in zip(met.tolist(), cuts, ends, hot_cuts, hot_ends, strict=True):
        part = order[a:b]
        docs, count = np.unique(doc[part], return_counts=True)
        yield r, _pack(sig[docs], lengths[docs], count, gram[part], hot[hot_order[x:y]])


def _batch_rows(sets: list[np.ndarray], sigs: list[int], ranges: int, salt: int, group: int = 1) -> Iterator[tuple[int, bytes]]:
    """(key, payload) per hash range, or per ``group`` of ranges. N-grams that
    many sets of this batch share go to a salted key beyond the ranges; their
    range gets a mark, so a posting list grows by one entry a batch at most
    times :data:`HOT`."""
    lengths = np.array([len(s) for s in sets])
    gram = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), lengths)
    sig = np.array(sigs, np.uint64)
    found, many = np.unique(gram, return_counts=True)
    hot = found[many >= HOT]
    is_hot = np.zeros(len(gram), bool)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram
    cold = ~is_hot
    yield from _by_range(_range_of(gram[cold], ranges) // group, _range_of(hot, ranges) // group, doc[cold], sig, lengths, gram[cold], hot)
    if len(hot):
        docs, count = np.unique(doc[is_hot], return_counts=True)
        yield ranges + salt % ranges, _pack(sig[docs], lengths[docs], count, gram[is_hot], hot[:0])


def _regroup(ranges: int):
    """Deal what has met in a group of ranges over its ranges; the rest passes."""
    def fine(payloads: list[bytes]) -> pa.RecordBatch:
        parts = [_unpack(p) for p in payloads]
        sig, n, count, gram, hot = (np.concatenate([p[i] for p in parts]) for i in range(5))
        hot = np.unique(hot)
        rows = list(_by_range(_range_of(gram, ranges), _range_of(hot, ranges), np.repeat(np.arange(len(sig)), count), sig, n, gram, hot))
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary()), none, none, none], ["key", "payload", "doc_id", "n", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, size = [], None, 0
        for batch in batches:
            passes = pc.greater_equal(batch.column(0), ranges)
            if (past := batch.filter(passes)).num_rows:
                yield past
            rest = batch.filter(pc.invert(passes))
            for key, payload in zip(rest.column(0).to_pylist(), rest.column(1).to_pylist(), strict=True):
                if held and (key != of or size >= 16 * BATCH):
                    yield fine(held)
                    held, size = [], 0
                of = key
                held.append(payload)
                size += len(payload)
        if held:
            yield fine(held)

    return run


def _packer(ranges: int, group: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        sets: list[np.ndarray] = []
        sigs: list[int] = []
        held = 0

        def packed() -> pa.RecordBatch:
            rows = list(_batch_rows(sets, sigs, ranges, sigs[0], group))
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary()), none, none, none],
                ["key", "payload", "doc_id", "n", "sig"],
            )

        for batch in batches:
            sizes, marks = [], []
            for text in raw_texts(batch.column(1)):
                found = shingle_set(text, hashes)
                sig = xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0
                sizes.append(len(found))
                marks.append(sig)
                if len(found) and sig not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(sig)  # a copy adds nothing to a range
                    sets.append(found)
                    sigs.append(sig)
                    held += len(found)
                    if held >= BATCH:
                        yield packed()
                        sets, sigs, held = [], [], 0
            sig = np.array(marks, np.uint64).view(np.int64)
            # Spread evenly, every batch from a place of its own.
            key = (ranges + (np.arange(len(sig)) + xxhash.xxh3_64_intdigest(sig.tobytes()) % ranges) % ranges).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int32()), pa.nulls(len(sig), pa.binary()), batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sig)],
                ["key", "payload", "doc_id", "n", "sig"],
            )
        if sets:
            yield packed()

    return run


def _counter(ranges: int):
    names = ["doc_id", "n", "sig", "s", "df"]

    def shared(payloads: list[bytes]) -> pa.Table:
        parts = [_unpack(p) for p in payloads]
        sig, n, count, gram = (np.concatenate([p[i] for p in parts]) for i in range(4))
        hot = np.unique(np.concatenate([p[4] for p in parts]))
        del parts
        ordered = np.sort(gram)
        twice = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], hot]))
        del ordered
        if not len(twice):
            return _table([], [], [], [])
        at = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
        keep = np.flatnonzero(twice[at] == gram)
        of = np.repeat(np.arange(len(sig), dtype=np.uint32), count)[keep]
        sig, n, at = sig[of], n[of], at[keep]
        order = np.lexsort((sig, at))
        sig, n, at = sig[order], n[order], at[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (sig[1:] != sig[:-1])  # one set may come from many tasks
        sig, n, at = sig[new], n[new], at[new]
        df = np.bincount(at, minlength=len(twice))
        if len(hot):
            df[np.searchsorted(twice, hot)] = MOST
        real = df[at] > 1
        return _table(n[real], sig[real], twice[at[real]], df[at[real]])

    def _table(n, sig, s, df) -> pa.Table:
        long = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
        return pa.Table.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(np.asarray(n, np.int64)), long(sig), long(s), pa.array(np.asarray(df, np.int32))], names)

    def run(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        payloads = [p for p in group.column("payload").to_pylist() if p is not None]
        if key < ranges:
            return shared(payloads)
        out = []
        for p in payloads:
            sig, n, count, gram, _ = _unpack(p)
            out.append(_table(np.repeat(n, count), np.repeat(sig, count), gram, np.full(len(gram), MOST)))
        docs = group.filter(pa.compute.is_null(group.column("payload")))
        none = pa.nulls(docs.num_rows, pa.int64())
        out.append(pa.Table.from_arrays([docs.column("doc_id"), docs.column("n"), docs.column("sig"), none, pa.nulls(docs.num_rows, pa.int32())], names))
        return pa.concat_tables([t.combine_chunks() for t in out])

    return run


def _similar(overlap, n1, n2):
    """100 * overlap >= 80 * union, with whole numbers."""
    return 9 * overlap >= 4 * (n1 + n2)


def _order(df, s):
    """A number that ascends with the global order, by frequency, then hash."""
    return df + (s / F.lit(2.0**65) + 0.25)


def _order_cuts(entries: DataFrame) -> list[float]:
    """The places of the global order that cut it into even fragments."""
    shares = [k / COUNT_FRAGMENTS for k in range(1, COUNT_FRAGMENTS)]
    return entries.agg(F.percentile_approx(_order(F.col("df"), F.col("s")), shares)).first()[0] or [0.0] * len(shares)


def _below(cut: float):
    """Whether an n-gram comes before ``cut``. Of one parameter: with a second
    one, defaulted or not, ``F.filter`` would pass the place in the array."""
    return lambda g: _order(g["df"], g["s"]) < cut


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar: overlaps are counted
    within each fragment of the order, then summed per pair. ``sets`` has the
    n-grams in order and where in the array each fragment ends."""
    part = lambda k: F.slice("grams", F.when(k > 0, F.col("ends")[k - 1]).otherwise(0) + 1, F.col("ends")[k] - F.when(k > 0, F.col("ends")[k - 1]).otherwise(0))
    cut = sets.select("sig", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), part(F.lit(k)).alias("part")) for k in range(COUNT_FRAGMENTS)))).alias("x")).select("sig", "x.f", "x.part")
    left = cut.select(F.col("sig").alias("a"), "f", F.col("part").alias("part_a"))
    right = cut.select(F.col("sig").alias("b"), "f", F.col("part").alias("part_b"))
    partial = pairs.join(right, "b").join(left, ["a", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap"))
    return summed.where(_similar(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")


def _length_starts() -> list[int]:
    """First size of each class of lengths: sets in classes further apart than
    neighbours differ by more than a quarter."""
    starts = [1]
    while starts[-1] < MOST:
        starts.append(5 * starts[-1] // 4 + 1)
    return starts


def _possible(n1, at1, n2, at2):
    """Whether sets that first meet at these places can be similar."""
    longer, shorter = F.greatest(n1, n2), F.least(n1, n2)
    return (5 * shorter >= 4 * longer) & _similar(F.least(n1 - at1, n2 - at2), n1, n2)


def _is_short_side(n, at):
    """Whether the shorter set of a similar pair can first meet the other at
    this place: the pair shares 8/9 of it at least."""
    return n >= 9 * at


def meetings(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides (s, class, sig, n, at, root) whose equal keys are the
    pairs to compare: the shorter sets, by the first ninth of their n-grams,
    with the longer of the same class of length and the next."""
    starts = F.array(*map(F.lit, _length_starts()))
    of = F.size(F.filter(starts, lambda x: x <= F.col("n")))
    shorter = known.where(_is_short_side(F.col("n"), F.col("at"))).withColumn("class", F.explode(F.array(of, of + 1)))
    return shorter, known.withColumn("class", of)


def near_duplicates(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Component of every row of ``docs`` (doc_id, text) under Jaccard links.

    A document's set: the distinct 5-word shingles of the whole text, or all
    its words as one if fewer. Null texts and texts without words have the
    empty set and no links. Links: Jaccard similarity of 0.8 or more. Equal
    sets are one class; a null doc_id never names a component with another id
    in it. Other columns are ignored; an empty table gives no rows.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if ranges is None:
        ranges = max(LEAST_RANGES, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    with small_batches(spark):
        group = -(-ranges // FAN)
        packed = texts.mapInArrow(_packer(ranges, group), _SCHEMA)
        if group > 1:
            tasks = max(partitions(spark), FAN)
            packed = packed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_regroup(ranges), _SCHEMA)
        table = staged(packed.groupBy("key").applyInArrow(_counter(ranges), _ENTRIES))
    rows = table.where("s IS NULL").select("doc_id", "n", "sig")
    entries = table.where("s IS NOT NULL")
    cuts = _order_cuts(entries)
    # What a set shares with others, rarest first. Its own n-grams come before.
    ends = [F.size(F.filter("x", _below(c))) for c in cuts]
    sets = staged(
        entries.groupBy("sig")
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
        .withColumn("own", F.col("n") - F.size("x"))
        .where(F.col("n") >= 5 * F.col("own"))
        .select("sig", "n", "own", F.col("x.s").alias("grams"), F.array(*ends, F.size("x")).alias("ends"))
    )
    prefix = F.floor(F.col("n") / 5) + 1
    index = checkpointed(
        sets.select("sig", "n", "own", F.posexplode(F.slice("grams", F.lit(1), (prefix - F.col("own")).cast("int"))).alias("at", "s"))
        .select("sig", "n", "s", (F.col("own") + F.col("at")).alias("at"))
    )
    rank = F.struct((F.col("at") / F.col("n")).alias("share"), "sig", "n", "at")
    # Aggregates that a hot key is joined with are checkpointed: the join is then
    # a stage of its own, which adaptive execution can split.
    buckets = index.groupBy("s").agg(F.count("*").alias("members"), F.min(rank).alias("lead"))
    # The leader has the best place; where even it can't be a pair's shorter set, nobody can.
    buckets = checkpointed(buckets.where((F.col("members") > 1) & _is_short_side(F.col("lead.n"), F.col("lead.at"))))

    led = index.join(buckets, "s").where("sig <> lead.sig")
    first = checkpointed(
        led.where(_possible(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
        .select(F.col("lead.sig").alias("a"), F.col("sig").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
        .distinct()
    )
    links = checkpointed(_verified(first, sets))
    roots = components(links)

    # Buckets that still hold more than one component: all their pairs across
    # components. One member at least is outside the bucket's first component.
    known = index.join(buckets.select("s"), "s", "left_semi").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    apart = checkpointed(known.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high"))
    known = checkpointed(known.join(apart.select("s"), "s"))
    shorter, longer = meetings(known)
    x = shorter.select("s", "class", *(F.col(c).alias(f"x_{c}") for c in ("sig", "n", "at", "root")))
    y = longer.select("s", "class", *(F.col(c).alias(f"y_{c}") for c in ("sig", "n", "at", "root")))
    apart_and_possible = (F.col("x_root") != F.col("y_root")) & (F.col("x_n") <= F.col("y_n")) & _possible(F.col("x_n"), F.col("x_at"), F.col("y_n"), F.col("y_at"))
    across = (
        x.join(y, ["s", "class"])
        .where(apart_and_possible)
        .select(
            F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b"),
            F.when(F.col("x_sig") < F.col("y_sig"), F.col("x_n")).otherwise(F.col("y_n")).alias("na"),
            F.when(F.col("x_sig") < F.col("y_sig"), F.col("y_n")).otherwise(F.col("x_n")).alias("nb"),
        )
        .distinct()
    )
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = checkpointed(_verified(across.join(tried, ["a", "b"], "left_anti"), sets))
    roots = components(links.unionAll(more))

    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"))
    joined = checkpointed(classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    names = checkpointed(joined.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = joined.join(names, "root").select("sig", "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionAll(empty)
