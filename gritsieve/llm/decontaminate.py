"""Benchmark decontamination (operator 2).

Benchmark items are fingerprinted by SimHash over their weighted word shingles,
and so is every window of a document that has an item's number of words and, by
running sums, a share of items' shingles without which it can be similar to no
item at all.  Windows are looked up among the items of their size in a
multi-index: 64 bits in 8 blocks of 8 bits; two fingerprints within a radius of
23 agree in some block up to 2 bits, so listing each item under all values within
2 bits of its blocks finds every pair within the radius.  The pairs found are then
checked exactly by weighted Jaccard similarity of their shingle multisets.

At the threshold of 0.8 the fingerprints of a pair differ by 10 bits on average
(deviation 3): the radius is over 4 deviations beyond.

A shingle's weight falls with the number of items of the whole benchmark that hold
it, whatever part an item is in; shingles that several items hold are counted by
Spark and go to every part (16 bytes each), all others weigh 1.  Words are runs
of bytes other than white space, with A-Z lower-cased; items of fewer than five
words are one shingle each.

Nulls and empty texts of documents match nothing; null or empty items are left
out; repeated rows and items are reported as often as they occur; of windows with
tied similarities the first counts; long texts are scanned whole, some thousand
windows at a time; empty tables give empty results.  Only the named columns are
read, whatever others are called, and `remove` passes all others through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import hashed_words, mix, shingles, text_slices

WORDS, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
#: Bytes of items, about, whose index one broadcast holds (its size is ten times that at most); more items are handled in several passes.
PART_BYTES = 8 << 20
#: Windows that are fingerprinted at once.
WINDOWS = 4096


def bit_sums(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums before each place (one row more than shingles) of +weight or -weight for each of 64 bits."""
    sums = np.zeros((len(h) + 1, 64), np.int64)
    signs = ((mix(h)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
    np.cumsum(signs * weight[:, None], axis=0, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles from each start on."""
    return ((sums[starts + size] > sums[starts]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray, weight_of) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    w = weight_of(values)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    most = float((w * np.maximum(x, y)).sum())
    return float((w * np.minimum(x, y)).sum()) / most if most else 0.0


@dataclass
class Blocks:
    """The items of one size, their fingerprints, and for each block the items listed under each value within BLOCK_ERRORS of theirs."""

    items: np.ndarray
    prints: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # bounds of 256 lists, places in `items`

    @classmethod
    def build(cls, items: np.ndarray, prints: np.ndarray) -> Blocks:
        near = np.array([[v ^ m for m in range(256) if m.bit_count() <= BLOCK_ERRORS] for v in range(256)])
        tables = []
        for b in range(BLOCKS):
            listed = near[((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(255)).astype(int)].ravel()
            owner = np.repeat(np.arange(len(items)), near.shape[1])
            by = np.argsort(listed, kind="stable")
            tables.append((np.searchsorted(listed[by], np.arange(257)), owner[by].astype(np.int32)))
        return cls(items, prints, tables)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `prints`, item) of all pairs within the radius: those within it agree in some block up to BLOCK_ERRORS bits."""
        pairs = []
        for b, (bounds, owner) in enumerate(self.tables):
            value = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(255)).astype(int)
            n = bounds[value + 1] - bounds[value]
            at = np.repeat(bounds[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.repeat(np.arange(len(prints)), n) * len(self.items) + owner[at])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
        near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[near], self.items[item[near]]


@dataclass
class Index:
    """Items of one part with the same shingle size k."""

    k: int
    item_ids: list
    words: np.ndarray  # words of each item
    hashes: list[np.ndarray]  # shingles of each item, in order
    keys: np.ndarray  # sorted distinct shingles
    common: np.ndarray  # sorted shingles that several items of the whole benchmark hold
    weights: np.ndarray  # of the common ones
    filter: np.ndarray  # bitmap over the top bits of the keys
    sizes: dict[int, Blocks]  # by the number of words

    @classmethod
    def build(cls, k: int, ids: list, words: list[int], hashes: list[np.ndarray], common: tuple[np.ndarray, np.ndarray] | None = None) -> Index:
        keys, df = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
        if common is None:  # these items are all there are
            common = keys[df > 1], df[df > 1]
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(keys >> np.uint64(44)).astype(np.int64)] = True
        self = cls(k, ids, np.array(words), hashes, keys, common[0], 1.0 / (1.0 + np.log(common[1])), bitmap, {})
        prints = np.array([fingerprints(bit_sums(h, self.steps_of(h)), np.zeros(1, int), len(h))[0] for h in hashes], np.uint64)
        for size in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == size)
            self.sizes[size] = Blocks.build(own, prints[own])
        return self

    def weight_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.ones(len(h))
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[at] == h, self.weights[at], 1.0)

    def steps_of(self, h: np.ndarray) -> np.ndarray:
        """Weights as whole numbers, so that sums over windows are exact."""
        return np.rint(256 * self.weight_of(h)).astype(np.int64)

    def held(self, h: np.ndarray) -> np.ndarray:
        """Which shingles are some item's."""
        out = self.filter[(h >> np.uint64(44)).astype(np.int64)]
        hit = np.flatnonzero(out)
        out[hit] = self.keys[np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)] == h[hit]
        return out

    def scan(self, h: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best (similarity, first word) of each item found in a document with these shingles.

        A window can be similar only if items' shingles have that share of its weight: all others are passed over
        by two running sums. What is left is fingerprinted and looked up, whatever items its shingles are from.
        """
        best: dict[int, tuple[float, int]] = {}
        held = self.held(h)
        if not held.any():
            return best
        weight = self.weight_of(h)
        given, every = (np.r_[0.0, np.cumsum(w)] for w in (weight * held, weight))
        least = self.weights.min(initial=1.0)
        for words, blocks in self.sizes.items():
            size = min(words - self.k + 1, len(h))  # a shorter document is one window
            if given[-1] < THRESHOLD * least * size:
                continue
            starts = np.flatnonzero(given[size:] - given[:-size] >= (THRESHOLD - 1e-9) * (every[size:] - every[:-size]))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                for part in np.array_split(run, -(-len(run) // WINDOWS)) if len(run) else ():
                    own = h[part[0] : part[-1] + size]
                    window, item = blocks.within(fingerprints(bit_sums(own, self.steps_of(own)), part - part[0], size))
                    for at, i in zip(part[window].tolist(), item.tolist(), strict=True):
                        if (s := similarity(h[at : at + size], self.hashes[i], self.weight_of)) >= THRESHOLD and s > best.get(i, (0.0, 0))[0]:
                            best[i] = (s, at)
        return best


def _item_shingles(column: pa.Array):
    """(row, words, shingle size, shingles) of each item with a word."""
    row = 0
    for _, _, data, offsets in text_slices(column):
        words, counts = hashed_words(data, offsets)
        at = 0
        for n in counts.tolist():
            if n:
                k = min(WORDS, n)
                yield row, n, k, shingles(words[at : at + n], np.array([n]), k)[0]
            at, row = at + n, row + 1


def build(items: list[tuple], common: tuple[np.ndarray, np.ndarray] | None = None) -> list[Index]:
    """Indexes of (item id, text) rows, one for each shingle size; `common` as of `common_shingles`, else counted among these."""
    by_size: dict[int, tuple[list, list, list]] = {}
    for row, n, k, h in _item_shingles(pa.array([t or "" for _, t in items], pa.large_string())):
        for part, value in zip(by_size.setdefault(k, ([], [], [])), (items[row][0], n, h), strict=True):
            part.append(value)
    return [Index.build(k, *parts, common) for k, parts in sorted(by_size.items())]


def common_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that more than one row of (item_id, text) holds, and how many do."""

    def run(batches):
        for batch in batches:
            for _, _, _, h in _item_shingles(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["h"])

    counts = items.select("text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    h, n = (counts.column(c).to_numpy() for c in ("h", "n"))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def scan_column(column: pa.Array, indexes: list[Index]):
    """(row, item id, similarity, first word, words) of each item found in each text."""
    for a, _, data, offsets in text_slices(column):
        words, counts = hashed_words(data, offsets)
        for index in indexes:
            h, number = shingles(words, counts, index.k)
            near = index.filter[(h >> np.uint64(44)).astype(np.int64)]
            ends = np.cumsum(number)
            for row in np.unique(np.searchsorted(ends, np.flatnonzero(near), side="right")).tolist():
                if counts[row] < index.k:
                    continue
                for item, (s, start) in index.scan(h[ends[row] - number[row] : ends[row]]).items():
                    yield a + row, index.item_ids[item], s, start, int(index.words[item])


def _parts(items: DataFrame, item_col: str, text_col: str):
    """(items of bounded size, shingles common in the whole benchmark); several only where the benchmark is large."""
    items = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PART_BYTES)
    common = common_shingles(items) if n else None
    for part in range(n):
        chosen = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part)
        yield [tuple(r) for r in chosen.collect()], common


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each document with each item that it holds."""
    from .storage import checkpointed

    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word bigint, n_words bigint"
    found = []
    item_type = to_arrow_type(items.schema[item_col].dataType)
    for rows, common in _parts(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(build(rows, common))

        def run(batches, shared=shared):
            for batch in batches:
                hits = list(zip(*scan_column(batch.column(1), shared.value), strict=True)) or [()] * 5
                ids = batch.column(0).take(pa.array(hits[0], pa.int64()))
                columns = [pa.array(list(x), kind) for x, kind in zip(hits[1:], (item_type, pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        found.append(checkpointed(one))  # a few rows; the part's index is not needed any more
        shared.destroy()
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item: each part of the benchmark is one more filter in the same pass."""
    for rows, common in _parts(items, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(build(rows, common))
        at = docs.columns.index(text_col)

        def run(batches, shared=shared, at=at):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in scan_column(batch.column(at), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
