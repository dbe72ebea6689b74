"""Merkle manifest, WARC archives and token alignment against plain versions, and on odd tables."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.llm import merkle_manifest as M, token_alignment as T, warc as W

from .test_operators import SCHEMA, clashing, docs, empty, rows  # noqa: F401

# -- 11 ---------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    """Root of some nodes, and the path of each."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            b = i // arity * arity
            run = nodes[b : b + arity]
            paths[k].append(("".join(run[: i - b]), "".join(run[i - b + 1 :])))
            at[k] = i // arity
        nodes = [h(*nodes[b : b + arity]) for b in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(values, tree_at, arity):
    """[(row, leaf, path, subroot)], root; rows ascend by their first value, then by leaf."""
    trees = {}
    for v in values:
        trees.setdefault(v[tree_at], []).append((v, plain_leaf(v)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = [], []
    for s in names:
        trees[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        tops.append(climb([leaf for _, leaf in trees[s]], arity))
    root, upper = climb([t[0] for t in tops], arity)
    for s, (subroot, paths), above in zip(names, tops, upper, strict=True):
        out += [(v, leaf, path + above, subroot) for (v, leaf), path in zip(trees[s], paths, strict=True)]
    return out, root


def manifest_rows(n):
    rng = random.Random(n)
    out = [(i, rng.choice(["hot", "hot", "hot", "é", "z", "", None]), "en", None, rng.choice([None, "", "a\nb", "text " * 9])) for i in range(n)]
    return out + [(None, "hot", None, 1, "no id"), (3, "hot", "en", None, "again"), (3, "hot", "en", None, "again"), (n + 5, "alone", None, None, None)]


@pytest.mark.parametrize("n,arity", [(0, 3), (40, 3), (40, 2), (300, 5)])
def test_manifest_equals_plain(spark, n, arity):
    values = manifest_rows(n)
    df = spark.createDataFrame(values, "doc_id int, source string, lang string, n_chars int, text string")
    want, root = plain_manifest(values, 1, arity)
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    out = M.manifest(df, names, "doc_id", "source", arity).withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r["root"] == root == r["folded"] for r in out)
    got = Counter((r["doc_id"], r["tree"], r["leaf"], tuple(map(tuple, r["path"])), r["subroot"]) for r in out)
    assert got == Counter((v[0], v[1], leaf, tuple(path), subroot) for v, leaf, path, subroot in want)


def test_tampering_shows(spark):
    values = [(i, f"s{i % 4}", "en", 3, "one\ntwo" if i % 3 else None) for i in range(60)]
    out = M.proofs(spark.createDataFrame(values, "doc_id int, source string, lang string, n_chars int, text string")).collect()
    for r in out:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1 or r["doc_id"] % 3 == 0) == (r["folded_root"] == r["root"])


def test_manifest_on_odd_tables(docs, rows, clashing, empty):  # noqa: F811
    assert M.proofs(docs).count() == len(rows) and M.proofs(clashing).count() == len(rows) + 3 and M.proofs(empty).count() == 0
    assert all(r["root"] is not None for r in M.proofs(clashing).select("root").collect())


# -- 12 ---------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(4)
    long = "".join(rng.choice("abcdé\n<>") for _ in range(3000))
    found = [(i, f"http://x/{i}", "".join(rng.choice("abcé日\r\n") for _ in range(rng.randrange(0, 4000)))) for i in range(60)]
    return found + [(100, "http://x/ a\r\nb", long), (101, None, long), (102, "u", long), (103, "u", "short"), (104, "u", "short"), (105, "u", None), (106, "u", ""), (None, "u", long), (107, "u", "x" * 2_000_000)]


def plain_records(rows):
    out = []
    for i, _, html in rows:
        x = (html or "").encode()
        latest = max((j for j, _, y in rows if j is not None and (y or "") == (html or "")), default=None) if len(x) >= 1000 else None
        refers = None if latest is None or latest == i else latest
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


@pytest.mark.parametrize("range_bytes", [777, 5000, 1 << 24])
def test_archives_hold_every_page(spark, range_bytes):
    values = pages()
    df = spark.createDataFrame(values, PAGES).repartition(2)
    assert Counter(map(tuple, W.round_trip(df, range_bytes).collect())) == plain_records(values)


def test_archives_are_plain_gzip(spark):
    values = pages()
    files = W.write(spark.createDataFrame(values, PAGES), file_bytes=10_000).collect()
    assert len(files) > 1 and sum(f["n_records"] for f in files) == len(values)
    texts = [gzip.open(f["path"].removeprefix("file:")).read() for f in files]
    assert sum(t.count(b"WARC/1.1\r\n") for t in texts) == len(values)
    out = W.read(spark.createDataFrame(files)).collect()
    assert {r["target_uri"] for r in out if r["record_id"] == "urn:page:100"} == {"http://x/%20a%0D%0Ab"}
    html = {i: t for i, _, t in values}
    assert all(bytes(r["payload"]).decode() == (html[int(r["record_id"][9:])] or "") for r in out if r["record_type"] == "response" and r["record_id"] != "urn:page:")
    assert all(len(r["payload"]) == 0 and r["headers"]["warc-profile"] for r in out if r["record_type"] == "revisit")


def nested_file(folder):
    """An archive whose second record holds another archive, uncompressed within its member, and damaged bytes between records."""
    inner = b"".join(W.page_record(1000 + k, "in", bytes(random.Random(k).randbytes(700)), None) for k in range(40))
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length: {len(inner)}\r\n\r\n".encode()
    raw, packer = head + inner + b"\r\n\r\n", zlib.compressobj(0, zlib.DEFLATED, 31)
    members = [W.page_record(1, "out", b"first" * 100, None), packer.compress(raw) + packer.flush(), b"\x1f\x8b\x08damaged", W.page_record(3, "out", b"third" * 100, None), W.page_record(4, "out", b"", None)]
    path = folder / "nested.warc.gz"
    path.write_bytes(b"".join(members))
    return str(path), len(b"".join(members))


@pytest.mark.parametrize("range_bytes", [100, 1000, 4096, 1 << 20])
def test_a_nested_archive_is_one_record(spark, tmp_path, range_bytes):
    files = spark.createDataFrame([nested_file(tmp_path)], "path string, n_bytes bigint")
    out = sorted(W.read(files, range_bytes).select("record_id", "offset", "end").collect())
    assert [r["record_id"] for r in out] == ["urn:page:1", "urn:page:2", "urn:page:3", "urn:page:4"]
    assert all(a["end"] <= b["offset"] for a, b in zip(out, out[1:], strict=False))


def test_archives_of_odd_tables(spark):
    df = spark.createDataFrame(pages(), PAGES)
    for c in ("path", "payload", "refers_to", "_n", "headers"):
        df = df.withColumn(c, F.lit(1))
    twice = df.unionByName(df)
    assert W.round_trip(twice).count() == 2 * len(pages()) and W.round_trip(df.limit(0)).count() == 0


# -- 13 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), T.vocabularies(*T.paths())


def plain_alignment(tokenizers, texts):
    """Rows of `digests` without ids, by sets of ends."""
    a_lib, b_lib, v = tokenizers
    found, counts = [], Counter()
    for x in texts:
        a, b = (a_lib.encode(" " + x, add_special_tokens=False).ids, b_lib.encode(x)) if x else ([], [])
        joined = [b"".join(table[i] for i in ids) for table, ids in ((v.a_bytes, a), (v.b_bytes, b))]
        if not x or joined != [(" " + x).encode()] * 2:
            found.append(None)
            continue
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((v.a_bytes, a), (v.b_bytes, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        links, groups, p, q = [], [], 0, 0
        for e in both:
            i, j = ends[0].index(e, p) + 1, ends[1].index(e, q) + 1
            links.append((a[i - 1], b[j - 1]))
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        counts.update(links)
        found.append((len(a), len(b), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[2]), sum(counts[x] == best[x[1]] for x in f[2]), sum(counts[x] for x in f[2]), hashlib.sha256(f[3].encode()).hexdigest()) for f in found], counts


RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_plain(spark, tokenizers, rows):  # noqa: F811
    texts = [t for _, t, *_ in rows] + ["a▁b", " lead", "tail ", "\n\n\n", "<|endoftext|> </s> <s>", "naïve 日本語 😀🏽", " " * 5000 + "x", "\t" * 2500, "é", "\x00\x01", "don't WON'T 1234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: tuple(r[c] for c in RESULT) for r in T.digests(df).collect()}
    want, counts = plain_alignment(tokenizers, texts)
    assert [out[i] for i in range(len(texts))] == want and sum(w[0] == 0 for w in want) >= 3
    aligned = T.align(df, want=("pairs",))
    assert {(r["a"], r["b"]): r["n_links"] for r in T.pair_table(T.count_pairs(aligned)).collect()} == counts


def test_alignment_columns_agree(spark, tokenizers):
    v = tokenizers[2]
    text = "Ein Satz, der überall gleich steht. " * 40
    r = T.align(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), want=tuple(T.COLUMNS)).first()
    groups = [g.split("|") for g in r["groups"].split(";")]
    assert [i for a, _ in groups for i in map(int, a.split(","))] == r["a_ids"] and [i for _, b in groups for i in map(int, b.split(","))] == r["b_ids"]
    ends = np.cumsum([sum(len(v.a_bytes[int(i)]) for i in a.split(",")) for a, _ in groups])
    assert ends.tolist() == r["cuts"] and r["cuts"][-1] == len((" " + text).encode()) and len(r["pairs"]) == r["n_links"] == r["n_groups"] == len(groups)


def test_lanes_do_not_change_links():
    rng = np.random.default_rng(1)
    for _ in range(60):
        total = int(rng.integers(1, 400))
        a, b = (np.union1d(rng.choice(total, rng.integers(0, total), replace=False) + 1, [total]) for _ in range(2))
        cut = np.intersect1d(a, b)
        stops = np.searchsorted(a, rng.choice(cut, min(3, len(cut)), replace=False), side="right")
        last = np.unique(np.r_[stops, len(a)])
        for lane in (1, 3, 64):
            at, bt = T.merge(a, b, np.r_[0, last[:-1]], last, lane)
            assert a[at].tolist() == b[bt].tolist() == cut.tolist()


def test_alignment_on_odd_tables(clashing, rows, empty):  # noqa: F811
    out = T.digests(clashing).collect()
    assert len(out) == len(rows) + 3 and T.digests(empty).count() == 0
    assert len({tuple(r[c] for c in RESULT) for r in out if r["doc_id"] == 4}) == 1
