"""Alignment of two tokenizers' tokens (operator 13): which tokens end together, and where both cut a text.

A text is encoded by a byte-level BPE (A, with a space in front) and by a SentencePiece BPE
(B, which adds the space); their tokens are runs of the same bytes then.  A vector of
pointers goes over both in lockstep: it has a lane for every document of a slice, or for every
run of some tokens of a long one, and each step compares where all lanes' A and B tokens
end, emits a link and a cut where they end together, moves the pointers that are behind, and
drops the lanes that are done.

Of two tokens that end together one is the end of the other, so the pairs that can ever be
linked are told by the two vocabularies alone: some 324,000 for the public ones.  Pairs are numbered
among these; the counts of a corpus, however large, are as many numbers at most, and are
broadcast.

Nulls and empty texts have no tokens; nor have texts whose tokens do not give the text
with its space back, byte by byte (one that holds the mark U+2581, say).  Strings of special
tokens are plain text.  Very long texts are encoded whole, a megabyte of texts or one text at a
time.  Repeated rows are aligned, and counted, each for itself; an empty table gives an empty
result.  Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import stored
from .text import give_back

#: A tokens of a lane.
LANE = 64
#: White space longer than this goes to the other library, as the faster one's pattern matcher would overflow its stack.
LONG_BLANK = 2000
SLICE_BYTES = 1 << 20


class Vocabularies:
    """Encoders of both sides, the bytes of their tokens, and the pairs of tokens that can end together."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in model["model"]["vocab"].items() if token not in special}
        # merges in the order of their ids: the ids are ranks
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.pairs = self._pairs()
        self._blank = re.compile(rf"\s{{{LONG_BLANK}}}")
        self._slow = None
        # `decimal,` and `decimal|` of each A token, then `decimal,` and `decimal;` of each B token, as eight bytes
        marks = [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for end in (",", last)]
        if max(map(len, marks)) > 8:
            raise ValueError("ids of more than seven digits")
        self.marks = np.array(marks, "S8").view(np.uint64)
        self.mark_sizes = np.array(list(map(len, marks)), np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """Codes (A id times B's size plus B id) of all pairs of which one is the end of the other, ascending."""
        of_a, of_b = ({} for _ in range(2))
        for tokens, ids in ((self.a_bytes, of_a), (self.b_bytes, of_b)):
            for i, token in enumerate(tokens):
                if token:
                    ids.setdefault(token, []).append(i)
        n = len(self.b_bytes)
        codes = {a * n + b for token, these in of_a.items() for k in range(len(token)) for b in of_b.get(token[k:], ()) for a in these}
        codes |= {a * n + b for token, those in of_b.items() for k in range(1, len(token)) for a in of_a.get(token[k:], ()) for b in those}
        return np.array(sorted(codes), np.int64)

    def encode_a(self, text: str) -> np.ndarray:
        if self._blank.search(text) is None:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.a_path)
            self._slow.encode_special_tokens = True
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One a worker and pair of files."""
    return Vocabularies(a_path, b_path)


def paths() -> tuple[str, str]:
    """The public vocabularies' places on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def merge(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, a_last: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """The links (A place, B place), ascending, of tokens that end together.

    Ends count through all documents; `a_first` and `a_last` bound each document's A tokens.
    """
    # lanes: runs of A tokens that cross no document, and the B tokens that end within them
    n = -(-(a_last - a_first) // lane)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = np.repeat(a_first, n) + nth * lane
    i_stop = np.minimum(i + lane, np.repeat(a_last, n))
    before = np.where(i > 0, a_ends[np.maximum(i - 1, 0)], 0)
    j = np.searchsorted(b_ends, before, side="right")
    j_stop = np.searchsorted(b_ends, a_ends[i_stop - 1], side="right")
    at, bt = [], []
    while True:
        live = (i < i_stop) & (j < j_stop)
        if not live.all():
            i, j, i_stop, j_stop = i[live], j[live], i_stop[live], j_stop[live]
        if not len(i):
            break
        x, y = a_ends[i], b_ends[j]
        both = x == y
        at.append(i[both]), bt.append(j[both])
        i, j = i + (x <= y), j + (y <= x)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(at)), np.sort(np.concatenate(bt))  # both ascend along a document


class Aligned:
    """The alignment of a slice of texts."""

    def __init__(self, v: Vocabularies, texts: list[str | None]):
        self.n = len(texts)
        a_ids = [np.zeros(0, np.int64)] * self.n
        b_ids = list(a_ids)
        here = [k for k, t in enumerate(texts) if t]
        for k, b in zip(here, v.encode_b([texts[k] for k in here]), strict=True):
            a, whole = v.encode_a(" " + texts[k]), (" " + texts[k]).encode()
            if b"".join(map(v.a_bytes.__getitem__, a.tolist())) == whole == b"".join(map(v.b_bytes.__getitem__, b.tolist())):
                a_ids[k], b_ids[k] = a, b
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (a_ids, b_ids))
        none = np.zeros(0, np.int64)
        self.a, self.b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
        self.a_ends, self.b_ends = np.cumsum(v.a_sizes[self.a]), np.cumsum(v.b_sizes[self.b])
        a_last = np.cumsum(self.n_a)
        self.at, self.bt = merge(self.a_ends, self.b_ends, a_last - self.n_a, a_last)
        self.n_links = np.diff(np.searchsorted(self.at, np.r_[0, a_last]))
        self.v = v

    def pairs(self) -> np.ndarray:
        """The number of each link's pair among all possible ones."""
        return np.searchsorted(self.v.pairs, self.a[self.at] * len(self.v.b_bytes) + self.b[self.bt])

    def cuts(self) -> np.ndarray:
        """Byte offsets, in their own texts, where both tokens end."""
        ends = np.r_[0, self.a_ends][np.cumsum(self.n_a) - self.n_a]
        return self.a_ends[self.at] - np.repeat(ends, self.n_links)

    def groups(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2` of each text."""
        n_a, n_b = len(self.a), len(self.b)
        if not n_a:
            return [b""] * self.n
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.at], last_b[self.bt] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        b_before, a_until = np.r_[0, self.bt + 1], np.r_[self.at + 1, n_a]
        order = np.empty(n_a + n_b, np.int64)
        order[np.arange(n_a) + b_before[group_a]] = 2 * self.a + last_a
        order[np.arange(n_b) + a_until[group_b]] = 2 * (self.b + len(self.v.a_bytes)) + last_b
        letters = self.v.marks[order].view(np.uint8)
        letters = letters[letters != 0].tobytes()
        stops = np.r_[0, np.cumsum(self.v.mark_sizes[order])][np.cumsum(self.n_a + self.n_b)]
        return [letters[a : b - 1] if b > a else b"" for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def column(self, name: str) -> pa.Array:
        if name in ("n_a", "n_b"):
            return pa.array(getattr(self, name))
        if name in ("n_groups", "n_links"):  # a cut ends a group and is a link
            return pa.array(self.n_links)
        if name in ("groups", "groups_sha256"):
            texts = self.groups()
            return pa.array([t.decode() for t in texts] if name == "groups" else [hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
        values, n = {"a_ids": (self.a, self.n_a), "b_ids": (self.b, self.n_b), "pairs": (self.pairs, self.n_links), "cuts": (self.cuts, self.n_links)}[name]
        values = values() if callable(values) else values
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(values, pa.int64() if name == "cuts" else pa.int32()))


COLUMNS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string", "groups_sha256": "string", "a_ids": "array<int>", "b_ids": "array<int>", "pairs": "array<int>", "cuts": "array<bigint>"}


def _slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) with about `most` characters together."""
    first, part, size = 0, [], 0
    for k, text in enumerate(column):
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", want: tuple[str, ...] = ("n_a", "n_b", "a_ids", "b_ids", "cuts", "pairs"), files: tuple[str, str] | None = None) -> DataFrame:
    """(id, what is wanted of COLUMNS) of each text.

    `pairs` numbers each link's pair of ids as `pair_table` does; `cuts` are byte offsets in the text with its space;
    `groups` is `a1,a2|b1;...`, A ids and B ids of each group.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*(files or paths()))
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                found = Aligned(v, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *map(found.column, want)], names=[id_col, *want])
        give_back()

    return df.select(id_col, text_col).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{c} {COLUMNS[c]}" for c in want)]))


def pair_table(df: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """(a, b, n_links) of the counted pairs `df` (pair, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*(files or paths()))
        for batch in batches:
            code = v.pairs[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(code // len(v.b_bytes)), pa.array(code % len(v.b_bytes)), batch.column(1)], names=["a", "b", "n_links"])

    return df.select("pair", "n").mapInArrow(run, "a bigint, b bigint, n_links bigint")


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair, over the rows' `pairs`; a task sends each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
            n[: len(total)] += total
            total = n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def score(aligned: DataFrame, counts: DataFrame, id_col: str = "doc_id", files: tuple[str, str] | None = None) -> DataFrame:
    """`aligned` with n_best and count_sum in place of `pairs`: links whose pair is the most counted of its B id, and the sum of all links' counts."""
    rows = counts.toArrow()  # a row for each pair that can be linked, at most
    shared = aligned.sparkSession.sparkContext.broadcast((rows.column("pair").to_numpy(), rows.column("n").to_numpy()))
    keep = [c for c in aligned.columns if c != "pairs"]
    at = aligned.columns.index("pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(*(files or paths()))
        pair, n = shared.value
        count = np.zeros(len(v.pairs), np.int64)
        count[pair] = n
        b = v.pairs % len(v.b_bytes)
        most = np.zeros(len(v.b_bytes), np.int64)
        np.maximum.at(most, b, count)
        best = (count == most[b]).astype(np.int64)
        for batch in batches:
            lists = batch.column(at)
            links, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            total = lambda x: np.diff(np.r_[0, np.r_[0, np.cumsum(x[links])][ends]])
            columns = [batch.column(k) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total(best), pa.int64()), pa.array(total(count), pa.int64())], names=[*keep, "n_best", "count_sum"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs"]
    return aligned.mapInArrow(run, ", ".join([*kinds, "n_best bigint, count_sum bigint"]))


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of `documents`; alignments are written once, then counted, then scored."""
    aligned = stored(align(df, want=("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")))
    return score(aligned, count_pairs(aligned))
