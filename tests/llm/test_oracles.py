"""The registered queries against their SQL, and all of them on whole tables of the smallest size."""

import functools

import duckdb
import pytest

from gritsieve.llm import queries

from .test_operators import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in con.description]
    want = sorted((dict(zip(names, r, strict=True)) for r in con.fetchall()), key=repr)
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted(({c: r[c] for c in names} for r in df.collect()), key=repr)
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op3_quality_classifier", "op4_toxicity", "op13_token_alignment"])
def test_query_has_a_row_for_each_document(spark, name):
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in queries.queries()[name](spark, SF).select("doc_id").collect()) == sorted(ids)


def test_codec_equals_the_library_on_all_documents(spark):
    import hashlib

    import sentencepiece

    from gritsieve.llm import sentencepiece_codec

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.queries()["op1_sentencepiece"](spark, SF).collect():
        ids = lib.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_quality_rules_by_small_groups_equal_sql(spark, monkeypatch):
    """With few documents asked of a group, its own fences are used, and equal those of the SQL."""
    from gritsieve.llm import oracles, quality_rules

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    kept, thresholds = {}, quality_rules.thresholds
    for least in (8, 200):
        monkeypatch.setattr(quality_rules, "thresholds", functools.partial(thresholds, least_rows=least))
        con.execute(f"SELECT doc_id, kept FROM ({oracles.QUALITY_RULES.replace('>= 200', f'>= {least}')})")
        kept[least] = dict(con.fetchall())
        assert {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()} == kept[least]
    assert kept[8] != kept[200]
