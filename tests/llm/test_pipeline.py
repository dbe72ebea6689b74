"""Every stage of the pipeline against brute force, each on its predecessor's output."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gritsieve.llm import decontaminate, quality_rules

from .test_operators import SF, brute_components, edited, near_lines, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in quality_rules.verdicts(stages[0]).filter("kept").collect()}
    assert ids(stages[1]) == kept and len(kept) < stages[0].count()


def test_line_stage_only_removes_lines(stages):
    before = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    for r in stages[2].collect():
        lines = iter(before[r["doc_id"]].split("\n"))
        assert all(any(x == y for y in lines) for x in r["text"].split("\n"))


def brute_without_repeats(rows):
    """Every line of a class but the first goes: line by line in the order of ids, classes by all pairs' distances."""
    trimmed = lambda x: x.strip(" \t\x0b\x0c\r")
    used = sorted({trimmed(x).encode() for _, t in rows for x in t.split("\n") if trimmed(x)})
    root = {x: x for x in used}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(used):
        for y in used[:i]:
            if near_lines(x, y):
                root[find(x)] = find(y)
    seen, out = set(), {}
    for i, t in sorted(rows):
        left = []
        for line in t.split("\n"):
            if trimmed(line):
                c = find(trimmed(line).encode())
                if c in seen:
                    continue
                seen.add(c)
            left.append(line)
        if "".join(left).strip():
            out[i] = "\n".join(left)
    return out


def test_line_stage_equals_brute_force(spark):
    rng = random.Random(15)
    base = [words(rng, rng.randrange(8, 13)) for _ in range(16)]
    pool = base + [edited(rng, x.encode(), rng.choice((1, 1, 6))).decode() for x in base for _ in range(2)] + ["short line", "short  line", "q 1", "a line of thirty bytes or so", "a line of thirty bytez or so"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 6)) + rng.choice([[], [""], [words(rng, 9)]]))) for i in range(40)]
    rows += [(50, pool[0]), (51, "only here\n  only here \nonly here"), (52, words(rng, 12))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: r["text"] for r in P.repeated_lines(spark, docs, SF).collect()}
    assert out == brute_without_repeats(rows) and 50 not in out and out[51] == "only here"


def test_near_duplicate_stage(stages):
    want = brute_components([(r["doc_id"], r["text"]) for r in stages[2].collect()], 5, 80)
    assert ids(stages[3]) == {i for i, v in want.items() if v[2]}


def test_decontamination_stage(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) + " "
    held = {r["doc_id"] for r in stages[3].collect() if any(flat(i) in flat(r["text"]) for i in items)}
    assert not held & ids(stages[4])
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(stages[3]) - ids(stages[4]) == leaks and held <= leaks


def test_codec_stage(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == ids(stages[4]) and all(r["same_text"] and len(r["ids"]) == r["n_tokens"] for r in rows)


def test_run_returns_the_last_stage(spark, stages):
    assert sorted(r["doc_id"] for r in P.run(spark, SF).collect()) == sorted(ids(stages[5]))


def test_stages_on_odd_tables(spark):
    """Null ids, null and empty texts, repeated rows, a long text, columns named like results and internals; empty tables."""
    rng = random.Random(41)
    base = words(rng, 60)
    rows = [(1, base), (1, base), (2, base + " more"), (None, words(rng, 40)), (3, None), (4, ""), (5, words(rng, 20_000)), (6, words(rng, 50)), (None, words(rng, 30))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("kept", "line", "node", "set_a", "n_words", "_drop_", "ids", "decoded", "key", "tasks", "h"):
        df = df.withColumn(c, F.lit(1))
    columns, left = df.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, df, SF)
        assert stage(spark, df.limit(0), SF).count() == 0
        if name != "sentencepiece":
            assert out.columns == columns and {r["kept"] for r in out.collect()} <= {1}
        left[name] = sorted((r["doc_id"] or 0) for r in out.collect())
    assert left["quality_rules"] == [0, 0, 1, 1, 2, 5, 6]
    assert left["line_dedup"] == [0, 0, 1, 1, 2, 3, 4, 5, 6]
    assert left["minhash_dedup"] == [0, 0, 1, 1, 3, 4, 5, 6]
    assert left["decontamination"] == left["sentencepiece"] == [0, 0, 1, 1, 2, 3, 4, 5, 6]
