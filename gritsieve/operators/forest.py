"""Isolation forest (Liu, Ting and Zhou 2008) as Spark jobs.

Each tree grows in a group of its own from at most 256 rows; the whole forest is
a small table of nodes, and rows are scored in Arrow batches against it.  All
draws are digits of MD5 over (seed, row), (seed, round, row) and (seed, tree, node), so the result
does not depend on partitioning, and SQL can draw the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gritsieve.functions import stats as S
from gritsieve.functions.cut import checkpointed
from gritsieve.functions.ranks import percentiles

SAMPLE = 256
NODES = "tree int, node int, feature int, split double, low int, high int, depth double"


def c_factor(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def uniform(*of: object) -> float:
    """A number in [0, 1) told by what it is for."""
    return int(hashlib.md5(":".join(map(str, of)).encode()).hexdigest()[:12], 16) / float(1 << 48)


def grow(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes (node, feature, split, low, high, depth) of one tree; leaves have feature -1 and their corrected depth.

    The children of node n are 2n + 1 (at most the split) and 2n + 2. A node draws one of its features that vary, and a
    place between the feature's ends.
    """
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        spread = np.flatnonzero(high > low)
        if depth >= limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + c_factor(len(rows))))
            continue
        f = int(spread[int(uniform(seed, tree, node, "feature") * len(spread))])
        split = float(low[f] + uniform(seed, tree, node, "split") * (high[f] - low[f]))
        split = float(low[f]) if split >= high[f] else split  # the right side keeps a row
        left = x[rows, f] <= split
        nodes.append((node, f, split, 2 * node + 1, 2 * node + 2, 0.0))
        todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return nodes


@dataclass
class Forest:
    """Node arrays of all trees (trees x nodes), bounded by 100 x 511 entries, and the normalising sample size."""

    feature: np.ndarray
    split: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    sample: int
    contamination: float = 0.1
    offset: float | None = None
    ends: tuple[float, float] | None = None  # least and greatest training score

    @classmethod
    def of(cls, nodes: list[tuple], sample: int, contamination: float = 0.1) -> Forest:
        """From rows (tree, node, feature, split, low, high, depth)."""
        shape = (max(n[0] for n in nodes) + 1, max(n[1] for n in nodes) + 1)
        out = [np.full(shape, fill, kind) for fill, kind in ((-1, np.int32), (0.0, float), (0, np.int32), (0, np.int32), (0.0, float))]
        for tree, node, *values in nodes:
            for array, v in zip(out, values, strict=True):
                array[tree, node] = v
        return cls(*out, sample, contamination)

    def rows(self) -> list[tuple]:
        """(tree, node, feature, split, low, high, depth) of all nodes that a walk can reach."""
        out = []
        for tree in range(len(self.feature)):
            todo = [0]
            while todo:
                n = todo.pop()
                out.append((tree, n, int(self.feature[tree, n]), float(self.split[tree, n]), int(self.low[tree, n]), int(self.high[tree, n]), float(self.depth[tree, n])))
                if self.feature[tree, n] >= 0:
                    todo += [int(self.low[tree, n]), int(self.high[tree, n])]
        return out

    def raw(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """-2^(-E[h]/c), to nine decimals: the lower the more anomalous.

        All trees are walked at once, one level a step; a leaf leads to itself.
        """
        n_trees, n_nodes = self.feature.shape
        base = np.arange(n_trees) * n_nodes
        leaf = self.feature < 0
        feature = np.where(leaf, 0, self.feature).ravel()
        split = np.where(leaf, np.inf, self.split).ravel()
        own = np.arange(n_nodes)[None, :]
        children = (np.stack([np.where(leaf, own, self.low), np.where(leaf, own, self.high)], -1) + base[:, None, None]).reshape(-1)
        depth, levels = self.depth.ravel(), max(1, math.ceil(math.log2(max(self.sample, 2))))
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            part = x[a : a + block]
            flat, row = np.ascontiguousarray(part).ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
            at = np.broadcast_to(base, (len(part), n_trees))
            for _ in range(levels):
                right = flat.take(feature.take(at) + row) > split.take(at)
                at = children.take(2 * at + right)
            out[a : a + block] = np.round(-(2.0 ** (-depth.take(at).mean(axis=1) / max(c_factor(self.sample), 1e-12))), 9)
        return out


class Tables:
    """A forest of narrow samples as tables, which give the depths of `Forest.raw` in two steps a tree instead of one a level.

    A tree is cut into its upper levels and the subtrees below them. How many of a part's splits lie below a value, feature
    by feature, tells the way through it; a value's place among all splits of its feature tells these numbers for all trees.
    """

    MOST_CELLS, MOST_FEATURES = 1 << 22, 8

    @classmethod
    def of(cls, forest: Forest) -> Tables | None:
        """None where the tables would be large: samples of many features."""
        used = np.unique(forest.feature[forest.feature >= 0])
        return cls._built(forest, used.tolist()) if 0 < len(used) <= cls.MOST_FEATURES else None

    @classmethod
    def _built(cls, forest: Forest, used: list[int]) -> Tables | None:
        self = cls()
        levels, n_trees = max(1, math.ceil(math.log2(max(forest.sample, 2)))), len(forest.feature)
        upper, self.used, self.forest = (levels + 1) // 2, used, forest
        feature, split, low, high = (x.tolist() for x in (forest.feature, forest.split, forest.low, forest.high))

        def part(tree: int, root: int, height: int) -> tuple[list, list, list]:
            """(splits by feature, the steps of the numbers of a cell, exit node of each cell) of a part of a tree."""
            inner, layer = [], [root]
            for _ in range(height):
                layer = [n for n in layer if feature[tree][n] >= 0]
                inner += layer
                layer = [c for n in layer for c in (low[tree][n], high[tree][n])]
            splits = [sorted({split[tree][n] for n in inner if feature[tree][n] == f}) for f in used]
            sizes = [len(t) + 1 for t in splits]
            steps = [math.prod(sizes[k + 1 :]) for k in range(len(used))]
            if math.prod(sizes) > cls.MOST_CELLS:
                return splits, steps, None
            cells = np.arange(math.prod(sizes))
            at = np.full(len(cells), root)
            for n in inner:  # parents come before their children
                k = used.index(feature[tree][n])
                right = cells // steps[k] % sizes[k] > splits[k].index(split[tree][n])
                at = np.where(at == n, np.where(right, high[tree][n], low[tree][n]), at)
            return splits, steps, at

        every = [np.unique(forest.split[forest.feature == f]) for f in used]
        self.every = every
        shape = [(len(e) + 1, n_trees) for e in every]
        below = lambda splits, places: np.r_[0, np.searchsorted(splits, places, side="right")]
        self.top, self.own = [np.zeros(x, np.int32) for x in shape], [np.zeros(x, np.int32) for x in shape]
        ways, self.down, depths, n_ways, n_depths, n_down = [], [[] for _ in used], [], 0, 0, [0] * len(used)
        subs = 1 << upper
        for tree in range(n_trees):
            splits, steps, at = part(tree, 0, upper)
            if at is None:
                return None
            exits, way = np.unique(at, return_inverse=True)
            ways.append(way.astype(np.int32))
            mine = [np.unique(forest.split[tree][forest.feature[tree] == f]) for f in used]
            for k in range(len(used)):
                self.top[k][:, tree] = below(splits[k], every[k]) * steps[k] + (n_ways if k == 0 else 0)
                self.own[k][:, tree] = below(mine[k], every[k]) * subs + n_down[k]
                n_down[k] += (len(mine[k]) + 1) * subs
            n_ways += len(way)
            down = [np.zeros((len(m) + 1, subs), np.int32) for m in mine]
            for j, root in enumerate(exits.tolist()):
                splits, steps, at = part(tree, root, levels - upper)
                if at is None or n_depths + len(at) > cls.MOST_CELLS:
                    return None
                for k in range(len(used)):
                    down[k][:, j] = below(splits[k], mine[k]) * steps[k] + (n_depths if k == 0 else 0)
                depths.append(forest.depth[tree][at])
                n_depths += len(at)
            for k, d in enumerate(down):
                self.down[k].append(d.ravel())
        self.ways, self.depths, self.down = np.concatenate(ways), np.concatenate(depths), [np.concatenate(d) for d in self.down]
        return self

    def raw(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Forest.raw of the samples."""
        if np.isnan(x).any():
            return self.forest.raw(x)
        out, norm = np.empty(len(x)), max(c_factor(self.forest.sample), 1e-12)
        places = [np.searchsorted(e, x[:, f]) for f, e in zip(self.used, self.every, strict=True)]
        for a in range(0, len(x), block):
            here = [p[a : a + block] for p in places]
            cell = self.top[0].take(here[0], axis=0)
            for top, p in zip(self.top[1:], here[1:], strict=True):
                cell += top.take(p, axis=0)
            way = self.ways.take(cell)
            cell = self.down[0].take(self.own[0].take(here[0], axis=0) + way)
            for down, own, p in zip(self.down[1:], self.own[1:], here[1:], strict=True):
                cell += down.take(own.take(p, axis=0) + way)
            out[a : a + block] = np.round(-(2.0 ** (-self.depths.take(cell).mean(axis=1) / norm)), 9)
        return out


def _pool(matrix: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """(id, features) of the `most` rows with the least hashes, written.

    A bound on the hash that lets through a few more than are wanted comes first, so that no partition sends more
    than its share to the sort.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = matrix.select("id", "features", h.alias("h"))
    rate = (most + 20 * math.sqrt(most)) / max(n, 1)
    first = keyed if rate >= 1 else keyed.filter(F.conv(F.substr("h", F.lit(1), F.lit(12)), 16, 10).cast("double") < rate * float(1 << 48))
    pool = checkpointed(first.orderBy("h", "features").limit(most).drop("h"))
    if rate < 1 and pool.count() < min(n, most):  # hashes that repeat very often
        pool = checkpointed(keyed.orderBy("h", "features").limit(most).drop("h"))
    return pool


def nodes(matrix: DataFrame, n_trees: int = 100, seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """The forest as a table.

    Trees draw their rows from a pool of n_trees * 256 rows: its rows in a hash order of their own for each round are dealt
    to as many trees as they suffice for. With fewer rows than a tree wants, every tree has all of them.
    """
    pool = _pool(matrix, matrix.count() if n_rows is None else n_rows, n_trees * SAMPLE, seed)
    m = pool.count()
    size = min(m, SAMPLE)
    a_round = max(1, m // SAMPLE)
    key = F.md5(F.concat_ws(":", F.lit(seed), "round", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    dealt = pool.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(-(-n_trees // a_round) - 1))).alias("round"))
    place = F.row_number().over(Window.partitionBy("round").orderBy(key, "features")) - 1  # the pool, once a round
    dealt = dealt.withColumn("place", place).withColumn("slot", F.floor(F.col("place") / max(size, 1)))
    drawn = dealt.withColumn("tree", (F.col("round") * a_round + F.col("slot")).cast("int")).filter((F.col("slot") < a_round) & (F.col("tree") < n_trees)).select("tree", "features")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = grow(np.stack(pdf["features"].to_numpy()), seed, tree)
        return pd.DataFrame([(tree, *n) for n in rows], columns=["tree", "node", "feature", "split", "low", "high", "depth"])

    return drawn.groupBy("tree").applyInPandas(one, NODES)


def fit_and_score(matrix: DataFrame, contamination: float = 0.1, seed: int = 42, n_trees: int = 100) -> tuple[Forest, DataFrame]:
    """A forest with the offset from all rows' scores, and `matrix` with iso_raw, walked through the trees once and written.

    The trees' nodes come to the driver, at most 51100 rows; the percentile is found between two of a sketch.
    """
    n = matrix.count()
    forest = Forest.of([tuple(r) for r in nodes(matrix, n_trees, seed, n).collect()], min(n, SAMPLE), contamination)
    raw = checkpointed(raw_scores(matrix, forest))
    one = S.feature_quantiles(raw.select(F.array("iso_raw").alias("features")), (contamination,), "bracket")
    ends = raw.agg(F.min("iso_raw"), F.max("iso_raw")).first()
    forest.offset, forest.ends = round(one.first()["q"][0], 9), (ends[0], ends[1])
    return forest, raw


def fit(matrix: DataFrame, contamination: float = 0.1, seed: int = 42, n_trees: int = 100) -> Forest:
    """A forest with its offset."""
    return fit_and_score(matrix.select("id", "features"), contamination, seed, n_trees)[0]


def fit_by_class(matrix: DataFrame, contamination: float = 0.05, seed: int = 42, n_trees: int = 100) -> dict:
    """A forest for each class of (id, label, features), with its offset; classes number few, and are of any size. Rows without a label are left out.

    Trees of all classes grow side by side from each class's rows with the least hashes; what reaches the driver is 51,100
    nodes a class at most.
    """
    matrix, most = matrix.filter("label is not null"), n_trees * SAMPLE
    sizes = {r["label"]: r["count"] for r in matrix.groupBy("label").count().collect()}  # a row for each class
    rate = F.least(F.lit(1.0), (most + 20 * math.sqrt(most)) / F.col("_n"))
    known = matrix.sparkSession.createDataFrame(list(sizes.items()), T.StructType([matrix.schema["label"], T.StructField("_n", T.LongType())]))
    text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    keyed = matrix.select("label", "id", "features", F.md5(F.concat(F.lit(f"{seed}:"), text)).alias("h")).join(F.broadcast(known), "label")
    keyed = keyed.filter(F.conv(F.substr("h", F.lit(1), F.lit(12)), 16, 10).cast("double") < rate * float(1 << 48))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "features"))  # some `most` rows of a class
    pool = keyed.withColumn("_k", nth).filter(F.col("_k") <= most).withColumn("_m", F.least("_n", F.lit(most)))
    a_round = F.greatest(F.lit(1), F.floor(F.col("_m") / SAMPLE)).cast("int")
    dealt = pool.withColumn("_a", a_round).select("label", "id", "features", "_a", F.least("_m", F.lit(SAMPLE)).alias("_s"), F.explode(F.sequence(F.lit(0), F.ceil(n_trees / F.col("_a")).cast("int") - 1)).alias("round"))
    place = F.row_number().over(Window.partitionBy("label", "round").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "round", text)), "features")) - 1
    drawn = dealt.withColumn("slot", F.floor(place / F.col("_s"))).withColumn("tree", (F.col("round") * F.col("_a") + F.col("slot")).cast("int")).filter((F.col("slot") < F.col("_a")) & (F.col("tree") < n_trees))
    kind = matrix.schema["label"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = grow(np.stack(pdf["features"].to_numpy()), seed, tree)
        return pd.DataFrame([(pdf["label"].iloc[0], tree, *n) for n in rows], columns=["label", "tree", "node", "feature", "split", "low", "high", "depth"])

    grown: dict = {label: [] for label in sizes}
    for label, *node in drawn.select("label", "tree", "features").groupBy("label", "tree").applyInPandas(one, f"label {kind}, {NODES}").collect():
        grown[label].append(tuple(node))
    forests = {label: Forest.of(rows, min(sizes[label], SAMPLE), contamination) for label, rows in grown.items()}
    raw = checkpointed(raw_by_class(matrix, forests).select("label", F.col("iso_raw").alias("x")))
    for label, _, q in percentiles(raw, ["label"], (contamination,)).collect():
        forests[label].offset = round(q[0], 9)
    return forests


def raw_by_class(matrix: DataFrame, forests: dict) -> DataFrame:
    """`matrix` with iso_raw by the forest of each row's class."""
    shared = matrix.sparkSession.sparkContext.broadcast(forests)
    at, of = matrix.columns.index("features"), matrix.columns.index("label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, labels = np.zeros(batch.num_rows), np.array(batch.column(of).to_pylist(), object)
            for label in set(labels):
                rows = np.flatnonzero([x == label for x in labels])
                x = batch.column(at).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float)
                raw[rows] = shared.value[label].raw(x.reshape(len(rows), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw)], names=[*batch.schema.names, "iso_raw"])

    return matrix.mapInArrow(run, T.StructType([*matrix.schema.fields, T.StructField("iso_raw", T.DoubleType())]))


def raw_scores(matrix: DataFrame, forest: Forest) -> DataFrame:
    """`matrix` with iso_raw."""
    context = matrix.sparkSession.sparkContext
    shared = context.broadcast(Tables.of(forest) or forest)  # 100 trees of at most 511 nodes
    if len(matrix.inputFiles()) < context.defaultParallelism:
        matrix = matrix.repartition(context.defaultParallelism)  # moving the rows of a few files costs less than walking trees on idle cores
    at = matrix.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float)
            raw = shared.value.raw(x.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw)], names=[*batch.schema.names, "iso_raw"])

    return matrix.mapInArrow(run, T.StructType([*matrix.schema.fields, T.StructField("iso_raw", T.DoubleType())]))


def score(matrix: DataFrame, forest: Forest) -> DataFrame:
    """`matrix` with iso_score in 0..1 (1: most anomalous; 0.5 if all are equal) and iso_vote (raw below the offset)."""
    raw = checkpointed(raw_scores(matrix, forest))
    lo, hi = raw.agg(F.min("iso_raw"), F.max("iso_raw")).first()
    return judged(raw, forest.offset, (lo, hi))


def judged(raw: DataFrame, offset: float, ends: tuple[float, float]) -> DataFrame:
    """Rows with iso_raw with iso_score and iso_vote."""
    low, high = ends if ends[0] is not None else (0.0, 0.0)
    score_ = (F.lit(high) - F.col("iso_raw")) / F.lit(high - low) if high > low else F.lit(0.5)
    return raw.withColumns({"iso_score": score_, "iso_vote": F.col("iso_raw") < F.lit(offset)})


def trained(matrix: DataFrame, contamination: float = 0.1, seed: int = 42, n_trees: int = 100) -> DataFrame:
    """`matrix` scored by a forest grown from itself."""
    forest, raw = fit_and_score(matrix, contamination, seed, n_trees)
    return judged(raw, forest.offset, forest.ends)
