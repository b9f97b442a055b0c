"""Near duplicates among embeddings by a forest of random-projection trees.

Equal vectors are one class. Trees of random splits are fitted on a bounded
sample: a node projects its vectors on a random direction and cuts where few lie
near the cut; those within a margin of it go to both sides, so that a close pair
is seldom parted, and several trees make up for the rest. Every class then falls
through every tree. Vectors are compared within leaves in double precision.

A pair may meet in several leaves; it counts in the first one that holds both,
which the leaves of the two tell, so pairs are counted and united where they
meet and never sent on. Groups of near copies so dense that no cut avoids them
are balls instead: inside one, by the triangle inequality, all are linked, which
needs no comparison; what lies within reach of a ball is compared with it, all
of it, so nothing is lost there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shipped, staged
from .components import components

COSINE = 0.95
TREES = 6
#: Expected vectors of a leaf; what a task compares at once.
LEAF, BLOCK = 1024, 2048
#: Bound of the sample on the driver: rows, and entries of all its vectors.
SAMPLE, SAMPLE_ENTRIES = 1 << 16, 1 << 23
#: A node with fewer sampled vectors is cut by what its sample tells, not resampled.
FEWEST = 64
#: Half width of the margin, in standard deviations of how a pair at the threshold projects.
SPILL = 0.3
#: A node of which the best cut has more in its margin than this stays whole.
DENSE = 0.35
#: A ball holds this share of the sample at least; so there are at most its inverse.
BALL_SHARE = 0.01
#: Codes of the cuts below a fitted leaf take so many bits.
CODE_BITS = 24
#: Rounding leaves pairs this near a bound to a comparison.
SLACK = 1e-9
_GROUP = "node long, links long, root long"


@dataclass
class Tree:
    """Inner nodes as rows; a child below zero is the leaf ``-1 - child``."""

    directions: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    #: By leaf: directions and cuts of the levels below it that the sample is too small to fit one by one.
    below: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def leaves(self, u: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row reaches."""
        rows, found = [], []
        waiting = [(0 if self.cuts else -1, np.arange(len(u)))]
        while waiting:
            at, idx = waiting.pop()
            if not len(idx):
                continue
            if at >= 0:
                p = u[idx] @ self.directions[at]
                waiting.append((self.children[at][0], idx[p < self.cuts[at] + margin]))
                waiting.append((self.children[at][1], idx[p >= self.cuts[at] - margin]))
                continue
            code = np.zeros(len(idx), np.int64)
            for direction, cut in zip(*self.below[-1 - at], strict=True):
                p = u[idx] @ direction
                low, high = p < cut + margin, p >= cut - margin
                idx, code = np.concatenate([idx[low], idx[high]]), np.concatenate([2 * code[low], 2 * code[high] + 1])
            rows.append(idx)
            found.append(((-1 - at) << CODE_BITS) + code)
        return np.concatenate(rows), np.concatenate(found)


def fit_tree(u: np.ndarray, scale: float, margin: float, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    """A tree on sampled unit vectors, each standing for ``scale`` vectors."""
    tree = Tree()

    def direction() -> np.ndarray:
        r = rng.normal(size=u.shape[1])
        return r / np.linalg.norm(r)

    def end(idx: np.ndarray, dense: bool) -> int:
        levels = 0 if dense else min(CODE_BITS, max(0, int(np.ceil(np.log2(max(len(idx) * scale / leaf, 1))))))
        chosen = np.array([direction() for _ in range(levels)]).reshape(levels, u.shape[1])
        tree.below.append((chosen, np.median(u[idx] @ chosen.T, axis=0) if levels and len(idx) else np.zeros(levels)))
        return -len(tree.below)

    def grow(idx: np.ndarray) -> int:
        if len(idx) * scale <= leaf or len(idx) < FEWEST:
            return end(idx, dense=False)
        best = None
        for _ in range(4):
            r = direction()
            p = np.sort(u[idx] @ r)
            for cut in p[(len(p) * np.linspace(0.35, 0.65, 9)).astype(int)]:
                inside = (np.searchsorted(p, cut + margin) - np.searchsorted(p, cut - margin)) / len(p)
                if best is None or inside < best[0]:
                    best = inside, r, cut
        if best[0] > DENSE:
            return end(idx, dense=True)
        at = len(tree.cuts)
        tree.directions.append(best[1])
        tree.cuts.append(float(best[2]))
        tree.children.append([0, 0])
        p = u[idx] @ best[1]
        tree.children[at] = [grow(idx[p < best[2] + margin]), grow(idx[p >= best[2] - margin])]
        return at

    grow(np.arange(len(u)))
    return tree


def fit_balls(u: np.ndarray, cosine: float, rng: np.random.Generator, share: float = BALL_SHARE) -> np.ndarray:
    """Centres of balls that hold ``share`` of the sample each, as rows."""
    near = np.cos(np.arccos(cosine) / 2) + SLACK
    rest, centres = np.arange(len(u)), []
    while len(rest) >= max(share * len(u), 32):
        tried = u[rng.choice(rest, min(256, len(rest)), replace=False)]
        best = tried[(u[rest] @ tried.T >= near).sum(0).argmax()]
        for _ in range(3):  # towards the middle of what it holds
            centre = u[rest][u[rest] @ best >= near].sum(0)
            best = centre / np.linalg.norm(centre)
        inside = u[rest] @ best >= near
        if inside.sum() < max(share * len(u), 32):
            break
        centres.append(best)
        rest = rest[~inside]
    return np.array(centres).reshape(-1, u.shape[1])


@dataclass
class Forest:
    """Trees and balls, for tasks to send vectors through."""

    cosine: float
    trees: list[Tree]
    margin: float
    balls: np.ndarray

    def leaves(self, u: np.ndarray) -> list[list[int]]:
        """Of every vector the leaves that it reaches, by tree, rising."""
        found = [[] for _ in range(len(u))]
        for k, tree in enumerate(self.trees):
            rows, leaf = tree.leaves(u, self.margin)
            leaf = leaf + (k << 48)
            order = np.lexsort((leaf, rows))
            for row, at in zip(rows[order].tolist(), leaf[order].tolist(), strict=True):
                found[row].append(at)
        return found

    def places(self, u: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The ball of every vector, -1 for none, and the others in whose reach
        it lies; of two balls only one has the other's members in its list."""
        if not len(self.balls):
            return np.full(len(u), -1), [[] for _ in range(len(u))]
        angle = np.arccos(self.cosine)
        cosines = u @ self.balls.T
        ball = np.where(cosines.max(1) >= np.cos(angle / 2) + SLACK, cosines.argmax(1), -1)
        reach = cosines >= np.cos(1.5 * angle) - SLACK
        reach &= (np.arange(len(self.balls)) < ball[:, None]) | (ball[:, None] < 0)
        return ball, [np.flatnonzero(r).tolist() for r in reach]


def fit_forest(sample: np.ndarray, count: int, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    """A forest for ``count`` vectors from a sample of them, as rows."""
    rng = np.random.default_rng(seed)
    u = _units(sample)
    margin = SPILL * np.sqrt((2 - 2 * cosine) / u.shape[1])
    forest = Forest(cosine, [], margin, fit_balls(u, cosine, rng))
    free = u[forest.places(u)[0] < 0]
    forest.trees = [fit_tree(free, count / max(len(u), 1), margin, rng, leaf) for _ in range(trees)]
    return forest


def _units(v: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very small or large entries stay finite.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _united(hits: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix of links reaches."""
    root = np.arange(len(hits))
    while True:
        least = np.minimum(root, np.where(hits, root[None, :], len(root)).min(1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _found(nodes: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.Table:
    some = (links > 0) | (roots != nodes)
    return pa.table({"node": nodes[some], "links": links[some], "root": roots[some]})


def _compare_leaf(cosine: float) -> Callable:
    """Links of a leaf, or of two blocks of a large one, that no earlier leaf has."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, low, high = (table[c][0].as_py() for c in ("leaf", "low", "high"))
        u = _units(_rows(table["v"].combine_chunks()))
        block = table["block"].to_numpy()
        a = np.flatnonzero(block == low)
        b = a if low == high else np.flatnonzero(block == high)
        hits = u[a] @ u[b].T >= cosine
        if low == high:
            np.fill_diagonal(hits, False)
        rows, columns = a[hits.any(1)], b[hits.any(0)]  # most vectors have no link
        if not len(rows):
            return _found(*[np.zeros(0, np.int64)] * 3)
        hits = hits[np.ix_(hits.any(1), hits.any(0))]
        leaves = table["leaves"].combine_chunks()
        of, flat = np.repeat(np.arange(len(table)), np.diff(leaves.offsets.to_numpy())), leaves.flatten().to_numpy()
        earlier = flat < leaf
        of, flat = of[earlier], np.unique(flat[earlier], return_inverse=True)[1]
        met = np.zeros((len(table), flat.max(initial=-1) + 1), np.float32)
        met[of, flat] = 1
        counted = hits & (met[rows] @ met[columns].T == 0)
        copies, nodes = table["copies"].to_numpy(), table["node"].to_numpy()
        links = np.zeros(len(table), np.int64)
        links[rows] += counted @ copies[columns]
        if low != high:
            links[columns] += counted.T @ copies[rows]
        every = np.union1d(rows, columns)
        square = np.zeros((len(every), len(every)), bool)
        square[np.ix_(np.searchsorted(every, rows), np.searchsorted(every, columns))] = hits
        return _found(nodes[every], links[every], nodes[every[_united(square | square.T)]])

    return compare


def _compare_ball(cosine: float) -> Callable:
    """Links between some members of a ball and some vectors within its reach."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        u, nodes, copies = _units(_rows(table["v"].combine_chunks())), table["node"].to_numpy(), table["copies"].to_numpy()
        inside = table["inside"].to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(inside), np.flatnonzero(~inside)
        links, roots = np.zeros(len(table), np.int64), nodes.copy()
        if len(a) and len(b):
            hits = u[a] @ u[b].T >= cosine
            links[a], links[b] = hits @ copies[b], hits.T @ copies[a]
            roots[b] = np.where(hits.any(0), nodes[a[hits.argmax(0)]], nodes[b])
        return _found(nodes, links, roots)

    return compare


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """With ``parts``, in how many blocks the rows that agree on ``by`` come,
    and ``block``, in which a row is. Checkpointed counts: the join can be split."""
    many = checkpointed(rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    return rows.join(many, by, "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))


def _of_one_length(classes: DataFrame, dims: int, cosine: float, trees: int, leaf: int, sample: int) -> DataFrame:
    """(node, links, root) of classes (node, v, copies, hash) of one length: links
    to other classes in copies, and another node of the component; several rows
    a node."""
    spark = classes.sparkSession
    count = classes.count()
    most = min(sample, SAMPLE_ENTRIES // dims)
    share = int(min(1.0, most / count) * (1 << 30))
    chosen = classes.where(F.pmod("hash", F.lit(1 << 30)) < share).select("v").toArrow()
    if not len(chosen):
        chosen = classes.select("v").limit(most).toArrow()
    forest = shipped(spark, fit_forest(_rows(chosen["v"].combine_chunks()), count, cosine, trees, leaf))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest_ = forest()
        for batch in batches:
            if not len(batch):
                continue
            u = _units(_rows(batch.column("v")))
            ball, reach = forest_.places(u)
            free = np.flatnonzero(ball < 0)
            leaves = [[] for _ in range(len(u))]
            for i, found in zip(free.tolist(), forest_.leaves(u[free]), strict=True):
                leaves[i] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), batch.column("v"), pa.array(ball.astype(np.int32)), pa.array(reach, pa.list_(pa.int32())), pa.array(leaves, pa.list_(pa.int64()))],
                names=["node", "copies", "v", "ball", "reach", "leaves"],
            )

    kind = classes.schema["v"].dataType.simpleString()
    placed = staged(classes.select("node", "copies", "v").mapInArrow(place, f"node long, copies long, v {kind}, ball int, reach array<int>, leaves array<long>"))

    # Leaves, large ones as pairs of blocks.
    inside = _dealt(placed.where("ball < 0").select("node", "copies", "v", "leaves", F.explode("leaves").alias("leaf")), "leaf")
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    inside = inside.select("node", "copies", "v", "leaves", "leaf", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = inside.groupBy("leaf", "low", "high").applyInArrow(_compare_leaf(cosine), _GROUP)

    # Balls: all members are linked with each other, others by comparison.
    balls = checkpointed(placed.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("size"), F.min("node").alias("first")))
    members = placed.where("ball >= 0").join(F.broadcast(balls), "ball")  # at most 1 / BALL_SHARE rows
    members = members.select("node", (F.col("size") - F.col("copies")).alias("links"), F.col("first").alias("root"))
    shell = placed.select("node", "copies", "v", F.explode("reach").alias("ball"))
    shell = _dealt(shell, "ball").select("ball", "node", "copies", "v", F.col("block").alias("outer"), F.col("parts").alias("outers"))
    core = _dealt(placed.where("ball >= 0").select("node", "copies", "v", "ball"), "ball").select("ball", "node", "copies", "v", F.col("block").alias("inner"), F.col("parts").alias("inners"))
    counts = lambda df, parts: checkpointed(df.groupBy("ball").agg(F.max(parts).alias("facing")))
    core_facing, shell_facing = F.broadcast(counts(shell, "outers")), F.broadcast(counts(core, "inners"))
    core = core.join(core_facing, "ball").select("ball", "node", "copies", "v", F.lit(True).alias("inside"), "inner", F.explode(F.sequence(F.lit(0), F.col("facing") - 1)).alias("outer"))
    shell = shell.join(shell_facing, "ball").select("ball", "node", "copies", "v", F.lit(False).alias("inside"), F.explode(F.sequence(F.lit(0), F.col("facing") - 1)).alias("inner"), "outer")
    around = core.unionByName(shell).groupBy("ball", "inner", "outer").applyInArrow(_compare_ball(cosine), _GROUP)
    return met.unionAll(members).unionAll(around)


def vector_near_duplicates(rows: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Component of every row of ``rows`` (vec_id, embedding) under links of
    cosine ``cosine`` or more, in double precision, whatever other columns say.

    Vectors that are null, empty or zero, or hold a null or non-finite entry,
    link with nothing, not even their copies; nor do vectors of different
    length with each other. Rows with null or repeated ids are each a row of the
    result; a null id never names a component with another id in it. An empty
    table gives no rows. Pairs inside or within reach of a ball are all found;
    of the others, those that meet in a leaf of any tree (``tests`` and README
    give the share). No pair below the threshold is linked.

    Returns vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable), kept (vec_id = component_id).
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v = F.col("embedding")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda c: c != 0)
    both = [F.xxhash64(F.lit(salt), v) for salt in (1, 2)]
    read = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v, F.coalesce(whole, F.lit(False)).alias("whole"))
    valid = read.where("whole").select("vec_id", F.col("embedding").alias("v"), both[0].alias("hash"), both[1].alias("hash2"))
    classes = valid.groupBy("v", "hash", "hash2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("v")))
    found = None
    for (dims,) in classes.select("dims").distinct().sort("dims").collect():
        one = _of_one_length(classes.where(F.col("dims") == dims).drop("dims"), dims, cosine, trees, leaf, sample)
        found = one if found is None else found.unionAll(one)
    alone = read.where("NOT whole").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    found = checkpointed(found)
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.drop("v", "dims").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    named = checkpointed(named)
    names = checkpointed(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = checkpointed(named.join(names, "root").select("hash", "hash2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = valid.select("vec_id", "hash", "hash2").join(named, ["hash", "hash2"])
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionAll(alone)
