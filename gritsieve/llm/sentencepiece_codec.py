"""SentencePiece BPE encoding and decoding (operator 1).

A text becomes units that no merge can cross: a piece never holds a space mark
after another character, and a character that no piece holds ends every merge.
Units met before come from a bounded cache; the others are merged together in
vectorised rounds over flat numpy arrays: look up the rank of every adjacent
pair, take each unit's minimum, merge leftmost first in all units at once,
compact, and go on until no pair is left.

A round merges every occurrence of a unit's best pair, from the left up to the
first that would make, with its neighbour on either side, a pair that ranks as
well or better: that is the order of single merges.  Units are first cut between
characters that stand together in no piece, so that long ones without spaces
(unspaced scripts, encoded data) merge in short parts too.

Nulls and empty texts encode to the end id alone (or nothing) and decode to the
empty text; very long texts are coded whole, about 2 MB of texts or one text at a
time; repeated rows are coded alike; an empty table gives an empty result.  Other
columns are passed through, and those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MARK = "▁"
#: Units kept by each Python worker; the cache is emptied when it is full.
CACHE_UNITS = 100_000
_NONE = np.int32(2**31 - 1)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Codec:
    """Encoder and decoder for one BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not kinds <= {1, 2, 3, 6}:
            raise ValueError("only BPE models with identity normalisation and plain pieces are read")
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.end_id = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        self.byte_ids = [next(i for i, p in enumerate(self.pieces) if p == f"<0x{b:02X}>") for b in range(256)]
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a space mark after another character")
        self._build_pairs(normal)
        unknown = f" {model.trainer_spec.unk_surface.strip()} "
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t == _CONTROL else unknown.encode() if t == _UNKNOWN else p.replace(MARK, " ").encode()
            for p, t in zip(self.pieces, self.types, strict=True)
        ]
        self.control = frozenset(i for i, t in enumerate(self.types) if t == _CONTROL)
        self.decimal = [str(i).encode() for i in range(len(self.pieces))]
        self._cache: dict[str, tuple[int, ...]] = {}
        self._raw_cache: dict[str, tuple[int, ...]] = {}

    def _build_pairs(self, normal: dict[str, tuple[int, float]]) -> None:
        """Symbols are piece ids, then characters that occur in pieces only; any other character is -1."""
        more = sorted({c for p in normal for c in p} - set(normal))
        self.symbol = {p: i for p, (i, _) in normal.items()} | {c: len(self.pieces) + k for k, c in enumerate(more)}
        self.lone = {len(self.pieces) + k: c for k, c in enumerate(more)}
        rank_of = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        n = self.n_symbols = len(self.pieces) + len(more)
        best: dict[str, int] = {}
        keys, ranks, made = [], [], []
        for p, (i, score) in normal.items():
            rank = rank_of[score]
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                for part in (a, b):
                    best[part] = min(best.get(part, rank), rank)
                if a in self.symbol and b in self.symbol:
                    keys.append(self.symbol[a] * n + self.symbol[b])
                    ranks.append(rank)
                    made.append(i)
        self.pair_keys = np.array(keys, np.int64)
        self.pair_ranks = np.array(ranks, np.int32)
        self.pair_made = np.array(made, np.int32)
        # slots of an open hash table with room for eight times the pairs: the index of a pair, or -1
        self.slot_bits = int(np.ceil(np.log2(8 * len(keys))))
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        for k, at in enumerate(self._slot(self.pair_keys).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << self.slot_bits) - 1)
            self.slots[at] = k
        self.safe = np.zeros(n, bool)
        for p, (i, score) in normal.items():
            self.safe[i] = best.get(p, 2**31) > rank_of[score]
        self.char_symbols = {c: s for c, s in self.symbol.items() if len(c) == 1}
        self.char_pairs = np.array(sorted({self.char_symbols[a] * n + self.char_symbols[b] for p in normal for a, b in pairwise(p)}), np.int64)

    # -- encoding ---------------------------------------------------------

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; pairs that make no piece have the rank _NONE."""
        key = left.astype(np.int64) * self.n_symbols + right
        key[(left < 0) | (right < 0)] = -1
        rank, made = np.full(len(key), _NONE, np.int32), np.full(len(key), -1, np.int32)
        at = self._slot(key)
        there = np.arange(len(key))
        while len(there):
            pair = self.slots[at]
            hit = self.pair_keys[pair] == key[there]
            hit &= pair >= 0
            rank[there[hit]], made[there[hit]] = self.pair_ranks[pair[hit]], self.pair_made[pair[hit]]
            on = (pair >= 0) & ~hit
            there, at = there[on], (at[on] + 1) & ((1 << self.slot_bits) - 1)
        return rank, made

    def _merge(self, symbols: np.ndarray, unit: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of all units; returns what is left, in order."""
        done_symbols, done_units = [], []
        while len(symbols):
            if len(symbols) == 1:
                done_symbols.append(symbols), done_units.append(unit)
                break
            rank, made = self._look_up(symbols[:-1], symbols[1:])
            rank[unit[:-1] != unit[1:]] = _NONE
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[first, len(unit)])
            best = np.minimum.reduceat(np.r_[rank, _NONE], first)
            live = np.repeat(best != _NONE, sizes)
            if not live.any():
                done_symbols.append(symbols), done_units.append(unit)
                break
            is_best = np.r_[(rank == np.repeat(best, sizes)[:-1]) & (rank != _NONE), False]
            at = np.flatnonzero(is_best)
            head = np.r_[True, unit[at[1:]] != unit[at[:-1]]]  # each unit's leftmost
            # leftmost first among overlapping ones: every second of a run of neighbours
            run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | head[1:]])
            inside = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            take = self._in_order(symbols, unit, at[inside % 2 == 0], made, rank)
            symbols = symbols.copy()
            symbols[take] = made[take]
            keep = live.copy()
            keep[take + 1] = False
            finished = ~live
            if finished.any():
                done_symbols.append(symbols[finished]), done_units.append(unit[finished])
            symbols, unit = symbols[keep], unit[keep]
        symbols, unit = np.concatenate(done_symbols), np.concatenate(done_units)
        order = np.argsort(unit, kind="stable")
        return symbols[order], np.bincount(unit, minlength=n_units)

    def _in_order(self, symbols: np.ndarray, unit: np.ndarray, take: np.ndarray, made: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The merges of a round that come before any other: each unit's up to the first that makes, with a neighbour, a pair as good as itself."""
        doubtful = np.flatnonzero(~self.safe[made[take]])
        if not len(doubtful):
            return take
        last = len(symbols) - 1
        i = take[doubtful]
        after_merge = np.r_[False, take[1:] == take[:-1] + 2][doubtful]  # the neighbour on the left has just been merged
        before = np.where(after_merge, made[np.maximum(i - 2, 0)], symbols[np.maximum(i - 1, 0)])
        left, _ = self._look_up(before, made[i])
        right, _ = self._look_up(made[i], symbols[np.minimum(i + 2, last)])
        again = (left <= rank[i]) & (i > 0) & (unit[np.maximum(i - 1, 0)] == unit[i])
        again |= (right <= rank[i]) & (i + 2 <= last) & (unit[np.minimum(i + 2, last)] == unit[i])
        stop = np.zeros(len(take), np.int64)
        stop[doubtful] = again
        earlier = np.cumsum(stop) - stop
        own = unit[take]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return take[earlier == np.repeat(earlier[first], np.diff(np.r_[first, len(take)]))]

    def encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of units with their space marks, by merge rounds."""
        if not units:
            return []
        lengths = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        values, where = np.unique(points, return_inverse=True)
        table = np.array([self.char_symbols.get(chr(v), -1) for v in values], np.int64)
        symbols = table[where]
        # no merge crosses two characters that stand together in no piece: what lies between such places is merged apart
        owner = np.repeat(np.arange(len(units)), lengths)
        code = symbols[:-1] * self.n_symbols + symbols[1:]
        place = np.minimum(np.searchsorted(self.char_pairs, code), len(self.char_pairs) - 1)
        joined = (self.char_pairs[place] == code) & (symbols[:-1] >= 0) & (symbols[1:] >= 0) & (owner[1:] == owner[:-1])
        part = np.r_[0, np.cumsum(~joined)]
        owner = owner[np.r_[True, ~joined]]
        # a character that no piece holds is kept as -2 - code point
        symbols = np.where(symbols < 0, -2 - points.astype(np.int64), symbols)
        symbols, counts = self._merge(symbols, part, len(owner))
        counts = np.bincount(owner, counts, minlength=len(units)).astype(np.int64)
        top, ends = len(self.pieces), np.cumsum(counts)
        flat, bounds = tuple(symbols.tolist()), [0, *ends.tolist()]
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero((symbols < 0) | (symbols >= top)), side="right")).tolist():
            out[k] = tuple(chain.from_iterable([s] if 0 <= s < top else self._bytes(chr(-2 - s) if s < 0 else self.lone[s]) for s in out[k]))
        return out

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def encode_batch(self, texts: list[str | None], end: bool = True) -> list[list[int]]:
        """Ids of whole texts, with the end id if asked."""
        plain, raw, fresh, fresh_raw = {}, {}, set(), set()
        if len(self._cache) + len(self._raw_cache) > CACHE_UNITS:
            self._cache, self._raw_cache = {}, {}
        cache, raw_cache = self._cache, self._raw_cache
        for k, text in enumerate(texts):
            if not text:
                continue
            if "  " in text or "\n" in text[:1] or text[0] == " " or " \n" in text or text[-1] == " " or MARK in text:
                units = raw[k] = re.findall(f"{MARK}+[^{MARK}\n]*|\n?[^{MARK}\n]+|\n", MARK + text.replace(" ", MARK))
                fresh_raw.update(set(units).difference(raw_cache))
            else:
                # in this form a unit has no mark of its own, or begins with a line break
                units = plain[k] = text.replace("\n", " \n").split(" ")
                fresh.update(set(units).difference(cache))
        for todo, store, mark in ((list(fresh), cache, True), (list(fresh_raw), raw_cache, False)):
            for a in range(0, len(todo), 20_000):
                part = todo[a : a + 20_000]
                store.update(zip(part, self.encode_units([MARK + u if mark and u[:1] != "\n" else u for u in part]), strict=True))
        tail = [self.end_id] if end else []
        out = []
        for k in range(len(texts)):
            units, store = (plain[k], cache) if k in plain else (raw.get(k, ()), raw_cache)
            out.append([*chain.from_iterable(map(store.__getitem__, units)), *tail])
        return out

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, byte pieces join to characters, the first space mark is dropped."""
        if not self.control.isdisjoint(ids[:-1]):  # byte pieces on either side of a control piece do not join
            cut = [k for k, i in enumerate(ids) if i in self.control]
            parts = [ids[a + 1 : b] for a, b in zip([-1, *cut], [*cut, len(ids)], strict=True)]
            at = next((k for k, part in enumerate(parts) if part), 0)
            return "".join(self.decode(part) if k <= at else self._joined(b"".join(map(self.surface.__getitem__, part))) for k, part in enumerate(parts))
        whole = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.types[i] != _CONTROL), None)
        if first is not None and self.types[first] == _NORMAL and self.pieces[first].startswith(MARK):
            whole = whole[1:]
        return self._joined(whole)

    @staticmethod
    def _joined(whole: bytes) -> str:
        try:
            return whole.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", whole.decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and model."""
    return Codec(path)


def model_path() -> str:
    """The public 32k model's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _groups(column: pa.Array, most: int = 1 << 21):
    """Lists of texts with about `most` bytes together."""
    part, size = [], 0
    for text in column:
        value = text.as_py()
        part.append(value)
        size += len(value or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _parts(batch: pa.RecordBatch, column: int, most: int = 1 << 21):
    """Slices of a batch with about `most` characters of text together, so that the ids of one slice alone are held."""
    at = 0
    for texts in _groups(batch.column(column), most):
        yield batch.slice(at, len(texts))
        at += len(texts)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: str | None = None, end: bool = True) -> DataFrame:
    """`df` with the ids of each whole text in `out_col` (array<int>), replacing a column of that name."""
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text_col)

    def run(batches):
        c = codec(model or model_path())
        for batch in batches:
            for part in _parts(batch, at):
                ids = c.encode_batch(part.column(at).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """`df` with the text of each id list in `out_col`, replacing a column of that name; null lists give empty texts."""
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    at = df.columns.index(ids_col)

    def run(batches):
        c = codec(model or model_path())
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [c.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """`df` with ids (array<int>, the end id included) and the text that they decode to, in one pass; columns of these names are replaced."""
    df = df.drop("ids", "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    at = df.columns.index(text_col)

    def run(batches):
        c = codec(model or model_path())
        for batch in batches:
            for part in _parts(batch, at):
                ids = c.encode_batch(part.column(at).to_pylist())
                texts = [c.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=[*part.schema.names, "ids", "decoded"])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encode, then decode: (id, n_tokens, ids_sha256, decoded_sha256, same_text) of each row, in one pass.

    `same_text` tells whether the decoded text is the text itself (null: empty).
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, same_text boolean"

    def run(batches):
        c = codec(model or model_path())
        for batch in batches:
            rows = []
            for part in _groups(batch.column(1)):
                for text, ids in zip(part, c.encode_batch(part), strict=True):
                    back = c.decode(ids)
                    joined = b" ".join(map(c.decimal.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            n, a, b, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "same_text"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
