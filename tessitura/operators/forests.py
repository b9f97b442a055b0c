"""Many random forests at once, grown level by level in one plan.

Features are binned once. A unit is a chunk of the pieces for a block of trees: their
bins, and a byte of bootstrap weight for each tree. A level of all trees of all forests
(of every repeat, outer and inner fold and setting) counts, unit by unit, the weights of
classes by (forest, tree, node, feature, bin) of the features that a node tries; counts
of chunks are added, running sums over at most ``bins`` rows give every cut's gain, and
``max_by`` the best. So vectors aren't copied through shuffles at every level, and a
task holds ``CHUNK`` pieces and ``BLOCK`` trees at most, or those of one forest.
Bootstrap weights and candidate features are hashes, so reruns and other engines draw
alike. Counts are whole numbers, so gains are the same bits in any partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_ordinal, hash_uniform
from ..plans.checkpoints import checkpoint
from .order import values_at

#: Chances of at most 0, 1, ... of a Poisson variable of mean 1.
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(9)))
NODE = ["forest", "tree", "node"]
#: Probabilities are summed as whole numbers of these parts.
PARTS = 1_000_000_000
#: Pieces (about) and trees of a unit.
CHUNK, BLOCK = 65_536, 32


def poisson_weight(*key: Column) -> Column:
    """A draw from the Poisson distribution of mean 1, reproducible from its key."""
    u = hash_uniform(*key)
    return sum((u >= F.lit(p)).cast("int") for p in POISSON)


def bin_edges(vectors: DataFrame, vector: str, bins: int) -> list[list[float]]:
    """By feature, its values at ``bins - 1`` evenly spaced ranks, each once: a
    number of doubles that the features fix, not the rows."""
    long = checkpoint(vectors.select(F.posexplode(vector).alias("idx", "value")))
    sizes = long.groupBy("idx").agg(F.count("value").alias("n"))
    ranks = sizes.select("idx", F.explode(F.array(*[F.floor((F.col("n") - 1) * k / bins) for k in range(1, bins)])).alias("rank")).distinct()
    found: dict[int, set[float]] = {}
    for r in values_at(long, ["idx"], "value", ranks).collect():
        found.setdefault(r.idx, set()).add(r.value)
    return [sorted(found.get(i, ())) for i in range(max(found, default=-1) + 1)]


def binned(vector: Column, edges: list[list[float]]) -> Column:
    """Array of the number of edges below each value."""
    limits = F.array(*[F.array(*map(F.lit, e)) if e else F.array().cast("array<double>") for e in edges])
    return F.zip_with(vector, limits, lambda v, e: F.size(F.filter(e, lambda x: x < v)).cast("tinyint"))


def _gini(total: Column, weights: list[Column]) -> Column:
    return 1 - sum((F.try_divide(w, total) * F.try_divide(w, total) for w in weights[1:]), F.try_divide(weights[0], total) * F.try_divide(weights[0], total))


def start(vectors: DataFrame, members: DataFrame, forests: DataFrame, trees: int, seed: int, key: str) -> DataFrame:
    """(forest, tree, node, key, label, bins, w, is_train, max_features, min_leaf):
    the rows of every tree, with bootstrap weights, at the root."""
    each = members.join(F.broadcast(forests), "forest").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))  # a row a forest
    w = F.when(F.col("is_train"), poisson_weight(F.lit(seed), F.col("forest"), F.col("tree"), F.col(key))).otherwise(0)
    rows = each.join(vectors.select(key, "label", "bins"), key).withColumn("w", w).where("w > 0 OR NOT is_train")
    return rows.select("forest", "tree", F.lit(1).cast("long").alias("node"), key, "label", "bins", "w", "is_train", "max_features", "min_leaf")


def class_weights(members: DataFrame, vectors: DataFrame, key: str, labels: int) -> DataFrame:
    """(forest, cw): by label, training rows over labels present times rows of it."""
    sizes = vectors.groupBy(key, "label").agg(F.count("*").alias("n"))
    counts = members.where("is_train").join(sizes, key).groupBy("forest").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(labels)])
    n = [F.col(f"n{k}") for k in range(labels)]
    whole, present = sum(n[1:], n[0]), sum(((x > 0).cast("int") for x in n[1:]), (n[0] > 0).cast("int"))
    return counts.select("forest", F.array(*[F.coalesce(F.try_divide(whole, present * x), F.lit(0.0)) for x in n]).alias("cw"))


def best_splits(rows: DataFrame, weights: DataFrame, labels: int, features: int, seed: int) -> DataFrame:
    """(forest, tree, node, feature, bin, gain) of the nodes that split."""
    train = rows.where("w > 0")
    counted = lambda df, *by: df.groupBy(*by).agg(*[F.sum(F.when(F.col("label") == k, F.col("w")).otherwise(0)).alias(f"c{k}") for k in range(labels)])
    nodes = counted(train, *NODE, "max_features", "min_leaf")
    open_ = open_nodes(nodes, weights, labels).withColumn("tried", F.array_distinct(tried_features(features, seed)))
    open_ = checkpoint(open_.drop("max_features"))
    tried = train.select(*NODE, "label", "bins", "w").join(open_.select(*NODE, "tried"), NODE)
    tried = tried.select(*NODE, "label", "w", "bins", F.explode("tried").alias("feature")).withColumn("bin", F.col("bins")[F.col("feature")])
    return best_cuts(counted(tried, *NODE, "feature", "bin"), open_.drop("tried"), labels)


def tried_features(features: int, seed: int) -> Column:
    """The features that a node draws, with replacement."""
    return F.transform(F.sequence(F.lit(0), F.col("max_features") - 1), lambda j: hash_ordinal(F.lit(features), F.lit(seed), F.col("forest"), F.col("tree"), F.col("node"), j).cast("int"))


def open_nodes(nodes: DataFrame, weights: DataFrame, labels: int) -> DataFrame:
    """(forest, tree, node, max_features, min_leaf, cw, t0, ...) of the nodes, with their
    counts c0, ..., that may split."""
    size = sum((F.col(f"c{k}") for k in range(1, labels)), F.col("c0"))
    mixed = sum(((F.col(f"c{k}") > 0).cast("int") for k in range(1, labels)), (F.col("c0") > 0).cast("int")) > 1
    open_ = nodes.where((size >= 2 * F.col("min_leaf")) & mixed).join(F.broadcast(weights), "forest")  # a row a forest
    return open_.select(*NODE, "max_features", "min_leaf", "cw", *[F.col(f"c{k}").alias(f"t{k}") for k in range(labels)])


def best_cuts(cells: DataFrame, open_: DataFrame, labels: int) -> DataFrame:
    """(forest, tree, node, feature, bin, gain) from counts c0, ... by (forest, tree,
    node, feature, bin), for the open nodes. Weights, their sums and impurities are
    columns one after another: as one expression they are a method that the JVM never
    compiles."""
    upto = Window.partitionBy(*NODE, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = cells.withColumns({f"l{k}": F.sum(f"c{k}").over(upto) for k in range(labels)})
    cuts = cuts.join(open_, NODE)
    left = [F.col(f"l{k}") for k in range(labels)]
    right = [F.col(f"t{k}") - F.col(f"l{k}") for k in range(labels)]
    fits = (sum(left[1:], left[0]) >= F.col("min_leaf")) & (sum(right[1:], right[0]) >= F.col("min_leaf"))
    sides = {"wl": left, "wr": right, "wt": [F.col(f"t{k}") for k in range(labels)]}
    cuts = cuts.where(fits).withColumns({f"{side}{k}": F.col("cw")[k] * c for side, cs in sides.items() for k, c in enumerate(cs)})
    weights = {side: [F.col(f"{side}{k}") for k in range(labels)] for side in sides}
    cuts = cuts.withColumns({side: sum(w[1:], w[0]) for side, w in weights.items()})
    cuts = cuts.withColumns({f"g{side}": _gini(F.col(side), w) for side, w in weights.items()})
    lost = lambda side: F.col(side) / F.col("wt") * F.coalesce(f"g{side}", F.lit(0.0))
    cuts = cuts.withColumn("gain", F.round(F.col("gwt") - lost("wl") - lost("wr"), 12))
    best = F.max_by(F.struct("feature", F.col("bin").cast("int").alias("bin"), "gain"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return cuts.groupBy(*NODE).agg(best.alias("b")).select(*NODE, "b.*").where("gain > 0")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows, np.uint8)
    ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def units(vectors: DataFrame, members: DataFrame, kinds: DataFrame, names: list[str], size: int, trees: int, seed: int, key: str, unit: str) -> tuple[DataFrame, int]:
    """(u, key, label, bins, roles, w) and the number of chunks: by unit, the pieces with a
    byte for each feature, for their role in each forest of the block (0 none, 1 train,
    2 test) and for their weight in each tree. A block has ``size`` forests."""
    blocks, chunks = -(-len(names) // size), max(1, -(-vectors.count() // CHUNK))
    role = [F.coalesce(F.max(F.when(F.col("slot") == k, F.when(F.col("is_train"), 1).otherwise(2))), F.lit(0)).cast("tinyint") for k in range(size)]
    roles = members.join(F.broadcast(kinds.select("forest", "block", "slot")), "forest").groupBy(unit, "block").agg(F.array(*role).alias("roles"))
    chunk = F.pmod(F.hash(key), F.lit(chunks))
    rows = vectors.join(roles, unit).select((chunk * blocks + F.col("block")).alias("u"), key, "label", "bins", "roles", F.col(key).cast("string").alias("_key"))

    def weighted(table: pa.Table) -> pa.Table:
        n, block = len(table), table["u"][0].as_py() % blocks
        wide = lambda name: pa.concat_arrays(table[name].chunks).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        part, keys = wide("roles"), np.array([k.encode() for k in table["_key"].to_pylist()], object)
        w = np.zeros((n, size * trees), np.uint8)
        for slot, forest in enumerate(names[block * size : (block + 1) * size]):
            at = np.flatnonzero(part[:, slot] == 1)
            for tree in range(trees if len(at) else 0):
                begun, drawn = hashlib.sha256(f"{seed}|{forest}|{tree}|".encode()), []
                for k in keys[at]:
                    h = begun.copy()
                    h.update(k)
                    drawn.append(h.digest()[:8])
                u = np.frombuffer(b"".join(drawn), ">u8").astype(np.float64) / 2.0**64
                w[at, slot * trees + tree] = np.searchsorted(POISSON, u, side="right")
        return pa.table([table["u"], table[key], table["label"], _bytes(wide("bins")), _bytes(part), _bytes(w)], names=["u", key, "label", "bins", "roles", "w"])

    kind = vectors.schema[key].dataType.simpleString()
    found = rows.repartition(blocks * chunks, "u").groupBy("u").applyInArrow(weighted, f"u int, {key} {kind}, label int, bins binary, roles binary, w binary")
    return checkpoint(found.repartition(blocks * chunks, "u")), chunks


class _Trees:
    """The trees of a unit's block: their splits, and values of some of their nodes."""

    def __init__(self, asked: pa.Table, depth: int) -> None:
        self.feature: dict[int, np.ndarray] = defaultdict(lambda: np.full(2 << depth, -1))
        self.bin: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(2 << depth, np.int64))
        self.values: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for j, node, feature, at, values in zip(*(asked[c].to_pylist() for c in ("j", "node", "feature", "bin", "values"))):
            if feature is not None:
                self.feature[j][node], self.bin[j][node] = feature, at
            if values is not None:
                self.values[j][node] = values

    def nodes(self, j: int, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node of tree ``j`` that each of the rows has reached."""
        node = np.ones(len(rows), np.int64)
        if j not in self.feature:
            return node
        feature, limit = self.feature[j], self.bin[j]
        while (live := np.flatnonzero(feature[node] >= 0)).size:
            of = node[live]
            node[live] = 2 * of + (bins[rows[live], feature[of]] > limit[of])
        return node


def _counts(unit: pa.Table, asked: pa.Table, names: list[str], size: int, trees: int, features: int, labels: int, blocks: int, depth: int, leaves: bool) -> pa.Table:
    """Weights of classes c0, ... by (forest, tree, node, feature, bin) of the nodes asked
    for and their features, and of the whole node with feature -1; of every leaf with
    ``leaves``."""
    out: list[list[np.ndarray]] = []
    if len(unit):
        block = unit["u"][0].as_py() % blocks
        bins, label = _matrix(unit["bins"], features), unit["label"].to_numpy().astype(np.int64)
        w, plan = np.asfortranarray(_matrix(unit["w"], size * trees)), _Trees(asked, depth)
        high = int(bins.max(initial=0)) + 1
        for j in range(size * trees) if leaves else sorted(plan.values):
            rows = np.flatnonzero(w[:, j])
            node, weight = plan.nodes(j, bins, rows), w[rows, j].astype(np.float64)
            order = np.argsort(node, kind="stable")
            found, first = np.unique(node[order], return_index=True)
            for of, at in zip(found.tolist(), np.split(order, first[1:])):
                tried = [] if leaves else plan.values[j].get(of)
                if tried is None:
                    continue
                y, v = label[rows[at]], weight[at]
                cells = [(np.array([-1]), np.array([0]), np.bincount(y, v, labels)[None])]
                if tried:
                    of_bin = (np.arange(len(tried)) * high + bins[np.ix_(rows[at], tried)]) * labels + y[:, None]
                    c = np.bincount(of_bin.ravel(), np.repeat(v, len(tried)), len(tried) * high * labels).reshape(-1, labels)
                    full = np.flatnonzero(c.any(1))
                    cells.append((np.array(tried)[full // high], full % high, c[full]))
                for feature, b, c in cells:
                    ones = np.ones(len(b), np.int64)
                    out.append([ones * (block * size + j // trees), ones * (j % trees), ones * of, feature, b, *c.T])
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * (5 + labels)
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * labels]
    forest = pa.array(names, pa.string()).take(pa.array(columns[0].astype(np.int64)))
    whole = [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns[1:], kinds)]
    return pa.table([forest, *whole], names=[*NODE, "feature", "bin", *[f"c{k}" for k in range(labels)]])


def _sums(unit: pa.Table, asked: pa.Table, names: list[str], size: int, trees: int, features: int, labels: int, blocks: int, depth: int, key: str) -> pa.Table:
    """(forest, key, p0, ...) of a unit's test rows: over trees, the sums of their leaves' shares."""
    out = []
    if len(unit):
        block = unit["u"][0].as_py() % blocks
        bins, roles, plan = _matrix(unit["bins"], features), _matrix(unit["roles"], size), _Trees(asked, depth)
        for slot, forest in enumerate(names[block * size : (block + 1) * size]):
            rows = np.flatnonzero(roles[:, slot] == 2)
            total, met = np.zeros((len(rows), labels), np.int64), np.zeros(len(rows), bool)
            for j in range(slot * trees, (slot + 1) * trees):
                if plan.values[j]:
                    of, share = np.array(list(plan.values[j])), np.array(list(plan.values[j].values()), np.int64)
                    order = np.argsort(of)
                    node = plan.nodes(j, bins, rows)
                    place = order[np.minimum(np.searchsorted(of, node, sorter=order), len(of) - 1)]
                    hit = of[place] == node
                    total[hit] += share[place[hit]]
                    met |= hit
            kept = np.flatnonzero(met)
            out.append(pa.table([pa.array([forest] * len(kept), pa.string()), unit[key].take(pa.array(rows[kept])), *[pa.array(total[kept, k]) for k in range(labels)]], names=["forest", key, *[f"p{k}" for k in range(labels)]]))
    none = pa.table({"forest": pa.array([], pa.string()), key: unit[key].slice(0, 0), **{f"p{k}": pa.array([], pa.int64()) for k in range(labels)}})
    return pa.concat_tables(out or [none])


def probabilities(leaves: DataFrame, weights: DataFrame, labels: int) -> DataFrame:
    """(forest, tree, node, values): of leaves with counts c0, ..., the share of each label's weight in parts."""
    leaves = leaves.join(F.broadcast(weights), "forest")  # a row a forest
    by_class = [F.col("cw")[k] * F.col(f"c{k}") for k in range(labels)]
    whole = sum(by_class[1:], by_class[0])
    return leaves.select(*NODE, F.array(*[F.round(x / whole * PARTS).cast("long") for x in by_class]).alias("values"))


def forest_sums(vectors: DataFrame, members: DataFrame, forests: DataFrame, labels: int, features: int, trees: int = 300, depth: int = 12, seed: int = 1729, key: str = "piece_id", unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((forest, key, p0, ...), splits) of all forests: the probability of each label
    of the rows that they did not train on; arguments as in :func:`forest_predictions`."""
    unit = unit or key
    vectors = checkpoint(vectors.select(*{key: 0, unit: 0}, "label", "bins"))
    weights = checkpoint(class_weights(members, vectors, unit, labels))
    names = sorted(r.forest for r in forests.select("forest").distinct().collect())  # a row a forest
    size = max(1, BLOCK // trees)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("forest")).cast("int") - 1
    kinds = checkpoint(forests.select("forest", "max_features", "min_leaf", F.floor(place / size).cast("int").alias("block"), (place % size).alias("slot")))
    blocks = -(-len(names) // size)
    rows, chunks = units(vectors, members, kinds, names, size, trees, seed, key, unit)
    fixed = (names, size, trees, features, labels, blocks, depth)

    def over_units(asked: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        at = asked.join(F.broadcast(kinds.select("forest", "block", "slot")), "forest")
        at = at.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: c * blocks + F.col("block"))).alias("u"), (F.col("slot") * trees + F.col("tree")).alias("j"), "node", "feature", "bin", "values")
        return rows.groupBy("u").cogroup(at.repartition(blocks * chunks, "u").groupBy("u")).applyInArrow(run, schema)

    def counts(asked: DataFrame, leaves: bool) -> DataFrame:
        schema = "forest string, tree int, node long, feature int, bin int, " + ", ".join(f"c{k} long" for k in range(labels))
        found = over_units(asked, lambda unit, asked: _counts(unit, asked, *fixed, leaves), schema)
        return checkpoint(found.repartition(*NODE).groupBy(*NODE, "feature", "bin").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(labels)]))

    none = lambda kind: F.lit(None).cast(kind)
    nodes = kinds.select("forest", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
    splits = checkpoint(nodes.select(*NODE, none("int").alias("feature"), none("int").alias("bin"), none("double").alias("gain")).limit(0))
    for _ in range(depth):
        tried = F.array_distinct(tried_features(features, seed)).cast("array<long>")
        asked = nodes.join(F.broadcast(kinds), "forest").select(*NODE, none("int").alias("feature"), none("int").alias("bin"), tried.alias("values"))
        found = counts(splits.select(*NODE, "feature", "bin", none("array<long>").alias("values")).unionAll(asked), False)
        open_ = open_nodes(found.where("feature = -1").join(F.broadcast(kinds.select("forest", "max_features", "min_leaf")), "forest"), weights, labels)
        level = checkpoint(best_cuts(found.where("feature >= 0"), open_.drop("max_features"), labels))
        splits = splits.unionAll(level)
        nodes = level.select("forest", "tree", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    plan = splits.select(*NODE, "feature", "bin", none("array<long>").alias("values"))
    shares = checkpoint(probabilities(counts(plan, True), weights, labels))
    schema = f"forest string, {key} {vectors.schema[key].dataType.simpleString()}, " + ", ".join(f"p{k} long" for k in range(labels))
    ended = plan.unionAll(shares.select(*NODE, none("int").alias("feature"), none("int").alias("bin"), "values"))
    found = over_units(ended, lambda unit, asked: _sums(unit, asked, *fixed, key), schema)
    return found.select("forest", key, *[(F.col(f"p{k}") / (trees * PARTS)).alias(f"p{k}") for k in range(labels)]), splits


def forest_predictions(vectors: DataFrame, members: DataFrame, forests: DataFrame, labels: int, features: int, trees: int = 300, depth: int = 12, seed: int = 1729, key: str = "piece_id", unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(probabilities, splits) of all forests over the rows they did not train on.

    ``vectors``: (key, label from 0, bins); ``members``: (forest, key, is_train), or
    with ``unit`` (forest, unit, is_train) of a column of ``vectors`` that holds rows
    together; ``forests``: (forest, max_features, min_leaf), a row each.
    """
    sums, splits = forest_sums(vectors, members, forests, labels, features, trees, depth, seed, key, unit)
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"p{k}").alias("p")) for k in range(labels)])
    return sums.select("forest", key, F.inline(each)), splits
