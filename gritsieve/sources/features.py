"""Feature matrices: reading, checking and inferring them.

A matrix is a DataFrame (id, features array<double>[, label]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

LABEL_NAMES = ("label", "labels", "target", "class")


def pack(df: DataFrame, id_col: str | Column, columns: list[str], label: str | None = None) -> DataFrame:
    """Wide numeric columns as one array; only these columns reach the scan."""
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    more = [F.col(label).alias("label")] if label else []
    return df.select(id_.alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"), *more)


def from_array(df: DataFrame, id_col: str, array_col: str, label: str | None = None) -> DataFrame:
    """A matrix from a column that is an array already."""
    more = [F.col(label).alias("label")] if label else []
    return df.select(F.col(id_col).alias("id"), F.col(array_col).cast("array<double>").alias("features"), *more)


def read_features(spark: SparkSession, path: str, id_col: str, columns: list[str] | None = None, array_col: str | None = None, label: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A matrix from Parquet, CSV or JSON files."""
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    return from_array(df, id_col, array_col, label) if array_col else pack(df, id_col, columns or [], label)


def _bad_value(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def violations(matrix: DataFrame) -> DataFrame:
    """(id, feature_idx, reason) of everything a detector cannot take.

    The expected width is the most frequent one (the smaller of equally frequent
    ones).  feature_idx is null where a whole row is at fault.
    """
    width = F.coalesce(F.size("features"), F.lit(0))
    mode = matrix.select(width.alias("w")).groupBy("w").agg(F.count("*").alias("n")).agg(F.max_by("w", F.struct("n", -F.col("w"))).alias("expected"))
    rows = matrix.crossJoin(F.broadcast(mode))  # one row
    whole = F.when(width <= 0, F.lit("zero_width")).when(width != F.col("expected"), F.lit("ragged"))
    per_row = rows.select("id", F.lit(None).cast("int").alias("feature_idx"), whole.alias("reason")).filter("reason is not null")
    bad = F.filter(F.transform("features", lambda x, j: F.struct(j.alias("j"), _bad_value(x).alias("bad"))), lambda s: s["bad"])
    per_value = rows.filter(F.exists("features", _bad_value)).select("id", F.explode(bad).alias("b")).select("id", F.col("b.j").alias("feature_idx"), F.lit("not_finite").alias("reason"))
    return per_row.unionByName(per_value)


def validate(matrix: DataFrame, least_rows: int = 1, labelled: bool = False) -> DataFrame:
    """The matrix itself, or ValueError: too few rows, violations, or labels missing."""
    bad = violations(matrix).limit(5).collect()
    if bad:
        raise ValueError(f"invalid matrix: {[tuple(r) for r in bad]}")
    if matrix.limit(least_rows).count() < least_rows:
        raise ValueError(f"{least_rows} rows are needed at least")
    if labelled and ("label" not in matrix.columns or matrix.filter("label is null").limit(1).count()):
        raise ValueError("every row needs a label")
    return matrix


def baseline_gate(matrix: DataFrame, least_rows: int = 50) -> DataFrame:
    """One row (n_rows, n_violations, ready) about a known-clean baseline."""
    n = matrix.agg(F.count("*").alias("n_rows"))
    v = violations(matrix).agg(F.count("*").alias("n_violations"))
    return n.crossJoin(v).withColumn("ready", (F.col("n_rows") >= least_rows) & (F.col("n_violations") == 0))


def require_baseline(matrix: DataFrame, least_rows: int = 50) -> DataFrame:
    """The baseline, or ValueError before any scoring starts."""
    if not baseline_gate(matrix, least_rows).first()["ready"]:
        raise ValueError("the baseline is too small or has invalid rows")
    return matrix


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type that hold no null; one aggregate decides."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return []
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
    return [c for c in numeric if not nulls[c]]


def label_column(df: DataFrame) -> str | None:
    """The first of the usual label names that the table has."""
    return next((c for c in LABEL_NAMES if c in df.columns), None)


def encode_labels(df: DataFrame, label_col: str) -> DataFrame:
    """`df` with label_code: 0.. by the order of the distinct labels as strings."""
    distinct = df.select(F.col(label_col).cast("string").alias("_label")).distinct()
    # codes of the few distinct labels; the table itself is not sorted
    codes = distinct.agg(F.array_sort(F.collect_set("_label")).alias("_all")).select(F.posexplode("_all").alias("label_code", "_label"))
    return df.withColumn("_label", F.col(label_col).cast("string")).join(codes, "_label", "left").drop("_label")


def infer_features(df: DataFrame, id_col: str, label_col: str | None = None) -> DataFrame:
    """(id, features, label) from a wide table: all null-free numeric columns, the label found by name and encoded."""
    label_col = label_col or label_column(df)
    if label_col is None:
        raise ValueError("no label column")
    columns = [c for c in numeric_columns(df) if c not in (label_col, id_col)]
    if not columns:
        raise ValueError("no numeric column")
    return pack(encode_labels(df, label_col), id_col, columns, "label_code")
