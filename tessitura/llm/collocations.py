"""Collocations: phrases of two or three words that are met together by themselves.

Texts are cut into pieces, identical pieces become one with a multiplicity. Of
every piece a task makes runs of three words, those that end with the piece
shorter; it adds up the equal ones it has met and sends them, packed, to the
hash bucket of their first two words. So a bucket has all runs that begin with
a pair, whose sum is the count of the pair, and one exchange counts pairs and
triples. duckdb counts a bucket out of core. The counts of the parts of a
phrase lie in other buckets: each candidate sends a request for each of its
parts there, and the replies meet again by phrase.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, partitions, small_batches, staged

#: What ends a piece, and what separates words inside it.
BREAKS = r"[.,;:!?\x0A-\x0D]"
GAPS = r"[\x20\x09]+"
#: Words whose runs a task adds up before it sends them.
CHUNK_WORDS = 1 << 19
#: Buckets that a task counts one after the other; each then fits into memory as a rule.
BUCKETS_A_TASK = 3
#: Parts of a language that are ranked before the best of them.
DEALS = 64
#: What duckdb holds of a bucket before it goes to the task's disk.
BUCKET_MB = 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: ``key`` is one word or two, a line break (which no word has) and the language;
#: ``tail`` the third word of a run that goes on.
_ENTRIES = pa.schema([("key", pa.large_string()), ("tail", pa.large_string()), ("w", pa.int64())])
_COUNTS = "lang string, phrase string, words int, f long"
#: The word count of a row that holds all words of a language.
TOTAL = 0


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces of lower-cased words with one space
    between them, and how often each is met; pieces without words are left out."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.explode(F.split(text, BREAKS)).alias("piece"))
    cut = cut.select("lang", F.trim(F.regexp_replace("piece", GAPS, " ")).alias("piece")).where("piece <> ''")
    return cut.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct keys, and the sums of their weights."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
    return order[starts], np.add.reduceat(weight[order], starts)


def _entries(langs: pa.Array, texts: pa.Array, m: np.ndarray, buckets: int) -> tuple[pa.Table, np.ndarray]:
    """The summed runs of some pieces, and their buckets in rising order."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    lengths = pc.list_value_length(lists).to_numpy()
    words = lists.flatten().dictionary_encode()
    lang = langs.cast(pa.large_string()).dictionary_encode()
    known, at = words.dictionary, words.indices.to_numpy().astype(np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known.cast(pa.large_binary()).to_pylist()), np.uint64, len(known))
    lang_hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in lang.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(lang.dictionary))
    of = np.repeat(lang.indices.to_numpy().astype(np.int64), lengths)
    weight = np.repeat(m, lengths)
    ends = np.cumsum(lengths) - 1
    left = np.repeat(ends, lengths) - np.arange(len(at))  # words after this one in its piece
    size = len(known) + 1

    first, f = _summed(of * size + at, weight)
    bucket = mixed(lang_hashes[of[first]] * _A + hashes[at[first]] * _B) % np.uint64(buckets)
    texts_of = lambda places: known.take(pa.array(places))
    text = lambda x: pa.scalar(x, pa.large_string())
    ends_with = pc.binary_join_element_wise(text(""), lang.dictionary, text("\n"))
    parts = [(bucket, pc.binary_join_element_wise(texts_of(at[first]), ends_with.take(pa.array(of[first])), text("")), pa.nulls(len(first), pa.large_string()), f)]

    pair = np.flatnonzero(left > 0)
    if len(pair):
        heads = (of[pair] * size + at[pair]) * size + at[pair + 1]
        _, heads = np.unique(heads, return_inverse=True)
        third = np.where(left[pair] > 1, at[np.minimum(pair + 2, len(at) - 1)] + 1, 0)
        chosen, f = _summed(heads.astype(np.int64) * size + third, weight[pair])
        third, spot = third[chosen], pair[chosen]
        bucket = mixed(lang_hashes[of[spot]] * _A + hashes[at[spot]] * _B + hashes[at[spot + 1]] * _C) % np.uint64(buckets)
        head = pc.binary_join_element_wise(texts_of(at[spot]), texts_of(at[spot + 1]), text(" "))
        key = pc.binary_join_element_wise(head, ends_with.take(pa.array(of[spot])), text(""))
        parts.append((bucket, key, known.take(pa.array(third - 1, mask=third == 0)), f))

    bucket = np.concatenate([p[0] for p in parts]).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    columns = [pa.concat_arrays([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts]), pa.array(np.concatenate([p[3] for p in parts]))]
    return pa.Table.from_arrays(columns, schema=_ENTRIES).take(pa.array(order)), bucket[order]


def _packed(table: pa.Table) -> bytes:
    """A table as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ENTRIES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _packer(buckets: int, chunk: int = CHUNK_WORDS) -> Callable:
    def packets(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        table, bucket = _entries(rows["lang"].combine_chunks(), rows["piece"].combine_chunks(), rows["m"].to_numpy(), buckets)
        met, starts = np.unique(bucket, return_index=True)
        for k, low, high in zip(met.tolist(), starts, [*starts[1:], len(bucket)], strict=True):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64()), "packet": pa.array([_packed(table.slice(low, high - low))], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            if not len(batch):
                continue
            spaces = np.cumsum(pc.count_substring(batch.column("piece"), " ").to_numpy() + 1)
            at = 0
            while at < len(batch):  # cut where the chunk is full
                gone = spaces[at - 1] if at else 0
                stop = min(len(batch), at + 1 + int(np.searchsorted(spaces[at:] - gone, chunk - words)))
                held.append(batch.slice(at, stop - at))
                words += int(spaces[stop - 1] - gone)
                at = stop
                if words >= chunk:
                    yield from packets(held)
                    held, words = [], 0
        if held:
            yield from packets(held)

    return pack


def _counter(least: int, megabytes: int = BUCKET_MB) -> Callable:
    def counted(packets: Iterator[pa.Scalar]) -> Iterator[pa.RecordBatch]:
        entries = (batch for packet in packets for batch in pa.ipc.open_stream(packet.as_buffer()))
        with tempfile.TemporaryDirectory() as spill, duckdb.connect() as con:
            con.execute(f"SET threads = 1; SET memory_limit = '{megabytes}MB'; SET preserve_insertion_order = false")
            con.execute(f"SET temp_directory = '{spill}'")
            con.register("packets", pa.RecordBatchReader.from_batches(_ENTRIES, entries))
            con.execute("CREATE TEMP TABLE runs AS SELECT key, tail, sum(w)::BIGINT AS f FROM packets GROUP BY ALL")
            con.execute(f"""
                CREATE TEMP VIEW found AS
                SELECT key, NULL AS tail, sum(f)::BIGINT AS f FROM runs GROUP BY key HAVING sum(f) >= {least}
                UNION ALL SELECT key, tail, f FROM runs WHERE tail IS NOT NULL AND f >= {least}
            """)
            con.execute("CREATE TEMP MACRO lang_of(key) AS substr(key, instr(key, chr(10)) + 1)")
            con.execute("CREATE TEMP MACRO head_of(key) AS substr(key, 1, instr(key, chr(10)) - 1)")
            found = con.sql(f"""
                SELECT lang_of(key) AS lang, head_of(key) || coalesce(' ' || tail, '') AS phrase, (1 + contains(head_of(key), ' ')::INTEGER + (tail IS NOT NULL)::INTEGER)::INTEGER AS words, f FROM found
                UNION ALL SELECT lang_of(key), '', {TOTAL}, sum(f)::BIGINT FROM runs WHERE NOT contains(head_of(key), ' ') GROUP BY ALL
            """)
            yield from found.to_arrow_reader(10_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("bucket").to_pylist(), batch.column("packet"), strict=True))
        for _, packets in groupby(rows, key=itemgetter(0)):
            yield from counted(packet for _, packet in packets)

    return count


def phrase_counts(docs: DataFrame, least: int, buckets: int | None = None) -> DataFrame:
    """(lang, phrase, words, f) of all runs of one to three words met ``least``
    times or more, and rows of ``words`` 0, whose f adds up to all words of a
    language; staged."""
    tasks = max(12, partitions(docs.sparkSession))
    buckets = buckets or BUCKETS_A_TASK * tasks
    with small_batches(docs.sparkSession):
        packets = pieces(docs).mapInArrow(_packer(buckets), "bucket long, packet binary")
        dealt = packets.repartition(tasks, "bucket").sortWithinPartitions("bucket")
        return staged(dealt.mapInArrow(_counter(least), _COUNTS))


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, inside: int = 50, buckets: int | None = None) -> DataFrame:
    """The best ``first`` phrases of two or three words of each language of
    ``docs`` (text, lang).

    Words are runs other than space and tab of the text with A-Z lower-cased,
    inside pieces that ``.,;:!?`` and line breaks end. Null texts count as
    empty, a null lang is ``und``; rows count each, whatever their other
    columns; an empty table gives no rows. Phrases met at least ``least`` times
    score ``floor(1000000 * a * a / (l * r))`` at their worst cut (ties: the
    first); those inside a longer phrase with ``100 * f >= inside * a`` are
    dropped. Arithmetic is decimal with 38 digits: exact up to 10^15 counts.

    Returns lang, rank, phrase, a, l, r, n, score, by score and a, falling,
    then phrase in byte order.
    """
    counts = phrase_counts(docs, least, buckets)
    totals = counts.where(F.col("words") == TOTAL).groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = counts.where("words >= 2").withColumn("w", F.split("phrase", " "))
    part = lambda low, length: F.concat_ws(" ", F.slice("w", low, length))

    # A pair inside a triple that is met at least half as often goes.
    triples = phrases.where("words = 3")
    longer = triples.select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.col("f").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    kept = phrases.where("words = 2").join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("f"))).drop("longest").unionByName(triples)

    # Requests for the counts of the parts of every cut, and the replies by phrase and cut.
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(1).alias("side"), part(F.col("cut") + 1, F.lit(2)).alias("part")))
    requests = cuts.select("lang", "phrase", "a", "cut", F.inline(sides))
    replies = requests.join(counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = replies.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("bottom", big("l") * big("r"))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "cut", "l", "r")).alias("worst"))
    scored = scored.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")

    # The first of every part of a language, then the first of those.
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALS))
    ranked = scored.withColumn("deal", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))).where(F.col("rank") <= first)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
