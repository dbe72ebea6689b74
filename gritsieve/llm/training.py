"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sampled_labels(labels: DataFrame, label_col: str, folds: int, held_out: int, most_each: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(labels of at most `most_each` rows of each class outside the held-out fold, their full counts).

    Null labels and ids are left out; of several labels of one id the largest counts.
    Rows are chosen by the hash of the id.
    """
    kept = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
    kept = kept.groupBy(id_col).agg(F.max(label_col).alias("label"))
    counts = {int(r["label"]): r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [kept.filter(F.col("label") == c).orderBy(F.xxhash64(id_col), id_col).limit(most_each) for c in sorted(counts)]
    out = parts[0] if parts else kept
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, counts


def with_texts(docs: DataFrame, chosen: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """The chosen documents' columns and labels; the chosen rows are few by construction, so documents are not shuffled."""
    side = chosen.select(F.col(id_col).alias("_id"), "label")
    return docs.select(id_col, *columns).join(F.broadcast(side), F.col(id_col) == F.col("_id")).drop("_id")
