"""MinHash near-duplicates by a multi-index Hamming join (operator 10).

A document's set is its distinct word shingles (A-Z lower-cased; with fewer
words than a shingle: all of them as one).  Its signature has 44 symbols, 16
bits of the minimum of each of 44 hash functions, in 11 chunks of 4.  Two
signatures that differ in at most 21 symbols agree, by the pigeonhole principle,
in some chunk up to one symbol; listing each chunk under its four forms with one
symbol left out therefore meets every pair within that distance.  At similarity
0.85 a pair differs in 6.6 symbols on average: 22 or more have a chance of 1e-7.

Documents with equal sets are one node.  Nodes that share a key are compared on
their full sets.  As near copies share many keys, every node has a home, the fullest of
its keys or of those of nodes it meets; homes of many shingles are cut into blocks by the node's hash, and a
pair of blocks with a key in common is compared once, whatever the number of
keys it shares, with all its nodes in one task of bounded size.  Inside a task
pairs that are already joined are passed over, and only links that join two
groups are given out, never more than one a node, so that a group of thousands of
copies makes thousands of rows and not their square.  A pair of nodes that shares
a key is compared in some task, so no link between different components is missed.

Null and empty texts are linked with nothing, and so are rows without an id
(component null, kept).  Rows that share an id and a text are one; of rows that
share an id alone, each has the component of its own text.  Sets are compared
whole, however long the text.  Ties do not arise: the least id stands for a
component.  An empty table gives an empty result.  Only id and text are read;
`dedup` passes other columns through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .storage import checkpointed, release
from .text import hashed_words, mix, shingles, text_slices

CHUNKS, PER_CHUNK = 11, 4
SYMBOLS = CHUNKS * PER_CHUNK
RADIUS = 2 * CHUNKS - 1
#: Blocks that a home is cut into, about, and the least and most shingles of a block.
BLOCKS, BLOCK_SHINGLES = 16, (1 << 14, 1 << 22)
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def sets_of(column: pa.Array, words: int):
    """(row, sorted distinct shingles) of each text with words."""
    for a, _, data, offsets in text_slices(column):
        h, number = shingles(*hashed_words(data, offsets), words)
        ends = np.cumsum(number)
        for k in np.flatnonzero(number).tolist():
            yield a + k, np.unique(h[ends[k] - number[k] : ends[k]])


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, set_a, set_b, sig): size, 128-bit hash and signature of each row's set; none for empty sets."""

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            hashes = np.zeros((batch.num_rows, 2), np.int64)
            sigs: list = [None] * batch.num_rows
            for a, _, data, offsets in text_slices(batch.column(1)):
                h, number = shingles(*hashed_words(data, offsets), words)
                there = np.flatnonzero(number)
                if not len(there):
                    continue
                starts = (np.cumsum(number) - number)[there]
                symbols = np.empty((len(there), SYMBOLS), np.uint16)
                for k, factor in enumerate(_FACTORS):
                    symbols[:, k] = mix(np.minimum.reduceat(h * factor, starts)).astype(np.uint16)
                ends = np.cumsum(number)
                for i, k in enumerate(there.tolist()):
                    own = np.unique(h[ends[k] - number[k] : ends[k]])
                    n[a + k] = len(own)
                    hashes[a + k] = np.array([own.sum(), np.bitwise_xor.reduce(mix(own))], np.uint64).view(np.int64)
                    sigs[a + k] = symbols[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(sigs, pa.binary())], names=["doc_id", "n", "set_a", "set_b", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, n bigint, set_a bigint, set_b bigint, sig binary")


def keys(nodes: DataFrame) -> DataFrame:
    """(key, node): the 44 chunk forms of each signature."""

    def run(batches):
        for batch in batches:
            joined = b"".join(batch.column(1).cast(pa.large_binary()).to_pylist())
            s = np.frombuffer(joined, np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            node = batch.column(0)
            for c in range(CHUNKS):
                part = s[:, c * PER_CHUNK : (c + 1) * PER_CHUNK]
                for m in range(PER_CHUNK):
                    rest = [part[:, j] for j in range(PER_CHUNK) if j != m]
                    key = mix((rest[0] << np.uint64(32)) | (rest[1] << np.uint64(16)) | rest[2] | (np.uint64(c * PER_CHUNK + m + 1) << np.uint64(48)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def _tasks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tasks array<struct<u,v,left>>): the pairs of blocks in which each node is compared, and in which of the two it lies."""
    # the fullest key, as one number: its size first (what orders large ones does not matter), then its own bits
    own = members.groupBy("node").agg(F.max(F.shiftleft(F.least("c", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.col("key").bitwiseAND((1 << 43) - 1))).alias("own"))
    # one cloud of near copies has several full keys: a key passes the fullest of its nodes' on, unless that is of another size altogether
    passed = members.join(own, "node").groupBy("key").agg(F.max(F.when(F.shiftright("own", 43) <= 4 * F.col("c"), F.col("own"))).alias("home"))
    homes = members.join(checkpointed(passed), "key").groupBy("node").agg(F.max("home").alias("home")).join(own, "node")
    homes = homes.select("node", F.coalesce("home", "own").alias("home")).join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    homes = checkpointed(homes)
    size = F.greatest(F.lit(BLOCK_SHINGLES[0]), F.least(F.lit(BLOCK_SHINGLES[1]), F.sum("n") / BLOCKS))
    large = checkpointed(homes.groupBy("home").agg(F.ceil(F.sum("n") / size).alias("blocks")).filter("blocks > 1"))
    units = homes.join(large, "home", "left").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))).alias("unit"))
    units = checkpointed(units)
    held = checkpointed(members.select("key", "node").join(units, "node").groupBy("key", "unit").agg(F.count("*").alias("k")))
    pairs = held.join(held.select("key", F.col("unit").alias("other")), "key").filter((F.col("unit") < F.col("other")) | ((F.col("unit") == F.col("other")) & (F.col("k") > 1)))
    pairs = checkpointed(pairs.select(F.col("unit").alias("u"), F.col("other").alias("v")).distinct())
    sides = pairs.select(F.col("u").alias("unit"), "u", "v", F.lit(True).alias("left")).unionByName(pairs.filter("u < v").select(F.col("v").alias("unit"), "u", "v", F.lit(False).alias("left")))
    tasks = checkpointed(sides.groupBy("unit").agg(F.collect_list(F.struct("u", "v", "left")).alias("tasks")))
    return units.join(tasks, "unit").select("node", "tasks")


def forest(nodes: np.ndarray, left: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of a task's nodes: all pairs are compared (left with right ones if there are both) but those already joined."""
    order = np.argsort(sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    nodes, left, sizes = nodes[order], left[order], sizes[order]
    across = not left.all()
    label = np.unique(nodes, return_inverse=True)[1]
    values, flat = np.unique(flat, return_inverse=True)
    there = np.zeros(len(values), np.int32)
    links = []
    for x in range(1, len(nodes)):
        n = int(sizes[x])
        low = int(np.searchsorted(sizes, -(-percent * n // 100)))  # smaller sets cannot reach the similarity
        other = label[low:x] != label[x]
        if across:
            other &= left[low:x] != left[x]
        other = low + np.flatnonzero(other)
        if not len(other):
            continue
        own = flat[first[x] : first[x] + n]
        there[own] = 1
        size = sizes[other]
        begin = np.cumsum(size) - size
        at = np.repeat(first[other] - begin, size) + np.arange(size.sum())
        common = np.add.reduceat(there[flat[at]], begin)
        there[own] = 0
        for y in other[100 * common >= percent * (n + size - common)].tolist():
            if label[y] != label[x]:
                links.append((int(nodes[x]), int(nodes[y])))
                label[label == label[y]] = label[x]
    return links


def _links(docs: DataFrame, tasks: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the links of each task that join groups; texts are moved once, their sets to each of their tasks."""

    def spread(batches):
        for batch in batches:
            lists = batch.column(2)
            rows, taken, values, size = [], [], [], 0
            for row, own in sets_of(batch.column(1), words):
                data = own.tobytes()
                for task in lists[row].as_py():
                    rows.append(row)
                    taken.append((task["u"], task["v"], task["left"]))
                    values.append(data)
                    size += len(data)
                    if size >= 1 << 22:
                        yield out(batch, rows, taken, values)
                        rows, taken, values, size = [], [], [], 0
            if rows:
                yield out(batch, rows, taken, values)

    def out(batch, rows, taken, values):
        u, v, left = zip(*taken, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(left, pa.bool_()), batch.column(0).take(pa.array(rows)), pa.array(values, pa.binary())], names=["u", "v", "left", "node", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), text_col).join(tasks, "node")
    dealt = texts.mapInArrow(spread, "u bigint, v bigint, left boolean, node bigint, set binary").repartition("u", "v").sortWithinPartitions("u", "v")

    def compare(table: pa.Table):
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        return forest(table.column("node").to_numpy(), table.column("left").to_numpy(), np.concatenate(sets), sizes, percent)

    def run(batches):
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
            if not len(u):
                continue
            found = []
            bounds = [0, *(np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1).tolist(), len(u)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if held and last != (u[a], v[a]):
                    found += compare(pa.concat_tables(held))
                    held = []
                held.append(table.slice(a, b - a))
                last = (u[a], v[a])
            yield rows(found)
        if held:
            yield rows(compare(pa.concat_tables(held)))

    def rows(found):
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def link(docs: DataFrame, words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sigs = checkpointed(signatures(docs, words, id_col, text_col))
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    full = sigs.filter(linkable)
    firsts = checkpointed(full.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("node")))
    # joined by the id too, which no group of copies shares
    nodes = full.withColumnRenamed("doc_id", "node").join(firsts, ["node", "set_a", "set_b", "n"]).dropDuplicates(["node", "set_a", "set_b"]).select("node", "n", "sig")
    nodes = checkpointed(nodes)
    all_keys = keys(nodes)
    shared = all_keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("key", "c")
    members = checkpointed(all_keys.join(shared, "key"))
    release(docs.sparkSession)
    links = checkpointed(_links(docs, _tasks(members, nodes), words, percent, id_col, text_col))
    own = firsts.join(components(links), "node", "left").select("set_a", "set_b", "n", F.coalesce("root", "node").alias("component_id"))
    found = full.join(own, ["set_a", "set_b", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sigs.filter(~linkable).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that a smaller id stands for."""
    gone = link(docs, words, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
