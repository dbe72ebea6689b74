"""Quality classifier (operator 3): a factorisation machine.

Features of a text are its hashed words (log counts, normalised), and numbers
about its structure: length, word lengths, shares of kinds of characters,
repetition of words and lines.  All pairs interact through low-rank factors; a
score takes linear time, as sum_i<j <v_i,v_j> x_i x_j is half the difference of
the squared sum and the sum of squares.

The model is trained in numpy on at most MOST_EACH labelled rows of each class
(a documented bound; features are taken on the executors) and then scores every
whole text.  Ids, languages, sources and labels are never inputs of a score.

Nulls and empty texts score by their structure alone; without labels every
score is 0.5; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import hashed_words, lowered, span_hashes, text_slices, word_spans
from .training import fold, sampled_labels, with_texts

#: Labelled rows of each class that training takes at most.
MOST_EACH = 6000
BITS, RANK = 15, 8
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.02, 1e-4
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "bang": b"!?", "stop": b".,;:", "line": b"\n", "mark": b"()[]{}=_\"'/\\@~^+-"}
STATS = (*_CLASSES, "beyond_ascii", "log_bytes", "log_words", "word_bytes", "word_spread", "distinct_words", "repeated_lines", "lines_per_word")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of hashed words and a matrix of structure numbers for the texts of a slice."""
    n = len(offsets) - 1
    low = lowered(data)
    starts, ends, counts = word_spans(low, offsets)
    h = span_hashes(low, starts, ends)
    row_of = np.repeat(np.arange(n), counts)
    key, seen = np.unique((row_of << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row, bucket, value = key >> BITS, key & ((1 << BITS) - 1), np.log1p(seen)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / np.maximum(norm[row], 1e-12)
    size = np.diff(offsets)
    per_byte = 1.0 / np.maximum(size, 1)
    columns = []
    for chars in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        total = np.r_[0, np.cumsum(table[data])]
        columns.append((total[offsets[1:]] - total[offsets[:-1]]) * per_byte)
    total = np.r_[0, np.cumsum(data >= 128)]
    columns.append((total[offsets[1:]] - total[offsets[:-1]]) * per_byte)
    per_word = 1.0 / np.maximum(counts, 1)
    width = ends - starts
    mean = np.bincount(row_of, width, minlength=n) * per_word
    spread = np.sqrt(np.maximum(np.bincount(row_of, width * width, minlength=n) * per_word - mean**2, 0))
    newline = np.zeros(256, bool)
    newline[10] = True
    lines, line_ends, n_lines = word_spans(data, offsets, newline)
    line_key = span_hashes(data, lines, line_ends) ^ np.repeat(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), n_lines)
    distinct = np.bincount(np.repeat(np.arange(n), n_lines)[np.unique(line_key, return_index=True)[1]], minlength=n)
    columns += [np.log1p(size), np.log1p(counts), mean, spread, np.bincount(row, minlength=n) * per_word, 1.0 - distinct / np.maximum(n_lines, 1), n_lines * per_word]
    return row, bucket, value.astype(np.float32), np.stack(columns, 1)


@dataclass
class Machine:
    """Bias, weights and factors of hashed words and of standardised structure numbers."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    stat_weight: np.ndarray
    stat_factor: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def blank(cls) -> Machine:
        rng, s = np.random.default_rng(17), len(STATS)
        return cls(0.0, np.zeros(1 << BITS, np.float32), rng.normal(0, 0.01, (1 << BITS, RANK)).astype(np.float32), np.zeros(s), rng.normal(0, 0.01, (s, RANK)), np.zeros(s), np.ones(s))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.std, -5, 5)

    def forward(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the factor sums of each row."""
        n = len(z)
        vx = self.factor[bucket] * value[:, None]
        sums = _by_row(row, vx, n) + z @ self.stat_factor
        squares = np.bincount(row, (vx * vx).sum(1), minlength=n) + (z * z) @ (self.stat_factor**2).sum(1)
        linear = self.bias + np.bincount(row, self.weight[bucket] * value, minlength=n) + z @ self.stat_weight
        return linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket, value, stats = features(data, offsets)
        return 1.0 / (1.0 + np.exp(-np.clip(self.forward(row, bucket, value, self.scaled(stats))[0], -30, 30)))


def _by_row(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the entries of each row; rows are sorted."""
    out = np.zeros((n, x.shape[1]))
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(x, first, axis=0)
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], weights: dict[int, float]) -> Machine:
    """Adam on the weighted log loss over (bucket, value, stats, label) rows."""
    m = Machine.blank()
    if not rows or len({r[3] for r in rows}) < 2:
        m.factor[:], m.stat_factor[:] = 0, 0
        return m
    stats = np.stack([r[2] for r in rows])
    m.mean, m.std = stats.mean(0), np.maximum(stats.std(0), 1e-9)
    z_all, y_all = m.scaled(stats), np.array([r[3] for r in rows], float)
    w_all = np.array([weights[r[3]] for r in rows])
    m.bias = float(np.log(max((w_all * y_all).sum(), 1e-9) / max((w_all * (1 - y_all)).sum(), 1e-9)))
    names = ("weight", "factor", "stat_weight", "stat_factor")
    first, second = ({k: np.zeros_like(getattr(m, k), dtype=np.float64) for k in names} for _ in range(2))
    rng, t = np.random.default_rng(23), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            n = len(part)
            row = np.repeat(np.arange(n), [len(rows[i][0]) for i in part])
            bucket = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            z = z_all[part]
            raw, sums = m.forward(row, bucket, value, z)
            g = w_all[part] * (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - y_all[part]) / n
            gx = g[row] * value
            each = gx[:, None] * (sums[row] - m.factor[bucket] * value[:, None])
            grads = {
                "weight": np.bincount(bucket, gx, minlength=1 << BITS),
                "factor": np.stack([np.bincount(bucket, each[:, f], minlength=1 << BITS) for f in range(RANK)], 1),
                "stat_weight": z.T @ g,
                "stat_factor": z.T @ (g[:, None] * sums) - ((z * z).T @ g)[:, None] * m.stat_factor,
            }
            t += 1
            m.bias -= RATE * float(g.sum())
            for k in names:
                now = getattr(m, k)
                d = grads[k] + DECAY * now / n
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                setattr(m, k, (now - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(now.dtype))
    return m


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", most_each: int = MOST_EACH) -> Machine:
    """Train on labelled rows outside the held-out fold."""
    chosen, counts = sampled_labels(labels, label_col, folds, held_out, most_each, id_col)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            labels_ = batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in text_slices(batch.column(1)):
                row, bucket, value, stats = features(data, offsets)
                at = np.searchsorted(row, np.arange(b - a + 1))
                out += [(str(ids[a + i]), bucket[at[i] : at[i + 1]].astype(np.int32).tobytes(), value[at[i] : at[i + 1]].tobytes(), stats[i].tobytes(), labels_[a + i]) for i in range(b - a)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["id", "bucket", "value", "stats", "label"])

    texts = with_texts(docs, chosen, id_col, text_col).withColumn("label", F.col("label").cast("int"))
    got = sorted(map(tuple, texts.mapInArrow(run, "id string, bucket binary, value binary, stats binary, label int").collect()))
    rows = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32), np.frombuffer(s, float), y) for _, b, v, s, y in got]
    drawn = {y: max(sum(r[3] == y for r in rows), 1) for y in counts}
    total = sum(counts.values())
    return train(rows, {y: (n / total) / (drawn[y] / max(len(rows), 1)) for y, n in counts.items()})


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(data, offsets) for _, _, data, offsets in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels, "quality", folds, held_out))
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
