"""Quality rules with adaptive thresholds (operator 8), DataFrame functions only.

Each document gets a few integer measures: its rates of symbols, duplicate lines
and repeated windows, less two deviations of their counts, and its capitals and
word lengths.  Their distributions are summarised
per language and source by mergeable quantile sketches: log-linear histograms,
whose bucket of a value keeps its six leading bits, so counts of equal buckets
of any parts of the data just add up (relative error 1/32, independent of
order and partitioning).  Upper fences follow from the quartiles of a group
alone: the only floor of their distance is the width of the upper quartile's
bucket, below which the sketch tells no values apart (1 permille up to 63);
groups with few documents take the merged sketch of their language, or of all.
The fences are then joined to the documents as the last filter.

A document is kept unless it fails the base rules or a measure passes its fence.

Nulls: a null text has no words and fails the base rule; null languages and
sources form groups of their own.  Repeated rows count as often as they occur,
ties share a bucket, empty tables give empty results; long texts are measured
whole; other columns pass through; `apply_rules` replaces columns named like one
of its results, `keep` changes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import checkpointed, stored

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Measures in permille, each with an upper fence.
MEASURES = ("m_symbols", "m_dup_lines", "m_repeats", "m_capitals", "m_word_chars")
#: Documents that a language and source, or a language, needs for fences of its own, if not told otherwise.
LEAST_ROWS = 200
#: A fence lies so many quartile distances above the upper quartile, and one bucket of the sketch there at least.
FENCE = 3
WINDOW = 8
#: Distinct languages and sources up to which fences are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 20_000
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with the base counts and the permille measures of each whole text.

    Repeated windows are found inside the row: words and then windows are hashed to 64 bits, and only a
    text whose windows are not all distinct has them sorted with their places. All steps take time in
    proportion to a text's length, but for that sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.drop(*[c for c in RESULTS if c in df.columns], *[c for c in MEASURES if c in df.columns])
    df = df.withColumn("_words", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        "_lines": lines,
        "_windows": F.coalesce(windows, F.array().cast("array<bigint>")),
    }).drop("_words")
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "_again": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop("_lines", "_windows")
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_again")), F.lit(0)).cast("long")).drop("_again").withColumns({
        "m_symbols": _permille(_sure(F.col("n_symbols")), "n_words"),
        "m_dup_lines": _permille(_sure(F.col("n_dup_lines")), "_n_lines"),
        "m_repeats": _permille(WINDOW * _sure(F.col("n_repeat_words") / WINDOW), "n_words"),
        "m_capitals": _permille(F.col("_capitals"), "word_chars"),
        "m_word_chars": _permille(F.col("word_chars"), "n_words"),
    }).drop("_capitals", "_n_lines")


def _permille(part: Column, whole: str) -> Column:
    return F.coalesce(F.floor(part * 1000 / F.when(F.col(whole) > 0, F.col(whole))), F.lit(0)).cast("long")


def _sure(count: Column) -> Column:
    """What a count of chance events exceeds but for two deviations: one line that occurs twice says nothing yet of a text."""
    return F.greatest(F.lit(0.0), count - 2 * F.sqrt(count))


def _covered(pairs: Column) -> Column:
    """Words covered by the windows whose hash occurs twice; pairs: (hash, place), sorted."""
    at = lambda k: F.get(pairs, k)
    again = lambda k: (at(k)["h"] == at(k - 1)["h"]) | (at(k)["h"] == at(k + 1)["h"])
    places = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: F.when(again(k), at(k)["i"]))
    places = F.sort_array(F.filter(F.when(F.size(pairs) > 0, places), lambda i: i.isNotNull()))
    total = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, total, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def base_failed(df: DataFrame) -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _width(value: Column) -> Column:
    """Values that share the six leading bits."""
    return F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 6, F.lit(0))).cast("long")


def _bucket(value: Column) -> Column:
    """The least value that shares the six leading bits."""
    step = _width(value)
    return F.floor(value / step).cast("long") * step


def sketches(df: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(keys, measure, bucket, n): one mergeable sketch for each group and measure, of documents that pass the base rules."""
    df = df.withColumn("_row", F.monotonically_increasing_id())  # keeps the filter above measures that are not written yet, whose expressions it would repeat
    rows = df.filter(~base_failed(df) & (F.col("_row") >= 0)).select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("x"))
    return rows.groupBy(*keys, "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each group with all its upper fences, and its document count."""
    sketch = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure").orderBy("bucket")
    all_of = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(all_of)})
    fence = ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
        F.max("total").alias("rows"),
    ).withColumn("fence", F.col("q3") + F.greatest(FENCE * (F.col("q3") - F.col("q1")), _width(F.col("q3"))))
    return fence.groupBy(*keys).agg(F.max("rows").alias(f"{name}_rows"), *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{name}_{m}") for m in MEASURES])


def thresholds(sketch: DataFrame, keys: tuple[str, ...] = ("lang", "source"), least_rows: int = LEAST_ROWS) -> DataFrame:
    """Fences of every group; groups under `least_rows` documents take those of their first key, or of everything."""
    own, wide = _fences(sketch, list(keys), "own"), _fences(sketch, [keys[0]], "wide")
    every = _fences(sketch.withColumn("_all", F.lit(1)), ["_all"], "all").drop("_all")
    first = F.col(f"wide.{keys[0]}")
    joined = own.alias("own").join(wide.alias("wide"), F.col(f"own.{keys[0]}").eqNullSafe(first), "left").drop(first).join(F.broadcast(every), F.lit(True), "left")
    pick = lambda m: F.when(F.col("own_rows") >= least_rows, F.col(f"own_{m}")).when(F.col("wide_rows") >= least_rows, F.col(f"wide_{m}")).otherwise(F.col(f"all_{m}"))
    return joined.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[pick(m).alias(f"fence_{m}") for m in MEASURES])


def judge(df: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("lang", "source"), n_groups: int | None = None) -> DataFrame:
    """Join the fences to measured documents: adds base_failed and kept. `limits` is broadcast only if it has few enough groups."""
    side = F.broadcast(limits) if n_groups is not None and n_groups <= BROADCAST_GROUPS else limits
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        on = same if on is None else on & same
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"fence_{m}"), F.lit(False))
    out = df.join(side, on, "left").withColumn("base_failed", base_failed(df))
    return out.withColumn("kept", ~F.col("base_failed") & ~beyond).drop(*[f"_t_{k}" for k in keys], *[f"fence_{m}" for m in MEASURES])


def settled(limits: DataFrame) -> tuple[DataFrame, int]:
    """The fences, cut from their lineage, and the number of groups."""
    limits = checkpointed(limits)
    return limits, limits.count()


def _judged(df: DataFrame, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    """Every row whole as `_doc`, with its counts, measures and verdict: measured once, written to the shared folder, judged as it is read again."""
    packed = df.select(F.struct(*df.columns).alias("_doc"))
    named = {f"_key{k}": F.col(f"_doc.{key}") for k, key in enumerate(keys)}
    measured = stored(measures(packed.withColumns(named | {"_text": F.col(f"_doc.{text_col}")}), "_text").drop("_text"))
    limits, n = settled(thresholds(sketches(measured, tuple(named)), tuple(named)))
    return judge(measured, limits, tuple(named), n).drop(*named)


def apply_rules(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Measure, sketch, derive fences, judge: `df` with the counts, base_failed and kept; texts are never shuffled."""
    return _judged(df, text_col, keys).select(*[F.col(f"_doc.{c}") for c in df.columns if c not in RESULTS], *RESULTS)


def keep(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of `df` that the rules keep, with all their columns as they were."""
    return _judged(df, text_col, keys).filter("kept").select("_doc.*")


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, counts, base_failed, kept) of each row; the measures are taken once and written, without texts."""
    measured = checkpointed(measures(df.select(id_col, *keys, text_col), text_col).drop(text_col))
    limits, n = settled(thresholds(sketches(measured, keys), keys))
    return judge(measured, limits, keys, n).select(id_col, *RESULTS, *MEASURES)
