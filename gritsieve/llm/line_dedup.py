"""Near-duplicate lines by a segment-partition edit join (operator 9).

Two lines are linked if their edit distance, of UTF-8 bytes, is at most one for
every SHARE bytes of the shorter line, and EDITS at most; below SHARE bytes equal
lines alone are the same.  The shorter line is split into as many segments as it
allows edits, and one more, of which some one must occur unchanged in the longer,
at a place that its number and the lengths bound.  So segments are listed under
(length, number, content), and every line probes, for each length it can match,
the substrings at the places that the bounds leave; what would be the line's own
segment is not probed, as lines of one length meet where they are listed.  Keys
are joined a part of them at a time, and the shuffles of a part are deleted before
the next, so that disk holds one part's rows.  Every row carries a sketch of its line's byte counts, which EDITS edits change by no
more than 2 * EDITS; pairs that meet with nearer sketches are verified on their
bytes by a banded bit-parallel edit distance.

Lines are split at line feeds and trimmed; lines without a word are nobody's.
Equal lines are one: a line is told by a hash of 128 bits.  The links' components
are classes; a class's first document (least id) owns it, at its first line there.

Nulls and empty texts have no lines; rows without an id take part by equality
alone and own nothing; rows that share an id are one document, which keeps at all
its places the line it owns; long texts and lines are handled whole, a slice of
about 1 MB or one text at a time; ties do not arise; empty tables give empty
results.  Only the id and the text are read; `remove_repeats` passes all columns
but the text through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import components
from .storage import checkpointed, stored
from .text import Prefixes, mix, span_hashes, text_slices, word_spans

#: Most edits between linked lines, and bytes of the shorter line that allow one.
EDITS, SHARE = 2, 20
#: Parts of the keys, each dealt and joined by itself.
PARTS = 2
#: Lines to verify whose hashes are broadcast; more are joined.
MOST_BROADCAST = 500_000
#: Repeated lines that are broadcast (25 bytes each) for their removal; for more, texts are dealt by document.
MOST_REPEATED = 1 << 20
_FEED = np.zeros(256, bool)
_FEED[10] = True


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, 128-bit hashes as two columns) of the trimmed lines with a word, in order."""
    starts, ends, counts = word_spans(data, offsets, _FEED)
    row = np.repeat(np.arange(len(counts)), counts)
    words, word_ends, _ = word_spans(data, offsets)
    a, b = np.searchsorted(words, starts), np.searchsorted(words, ends)
    keep = a < b
    starts, ends, row = words[a[keep]], np.minimum(word_ends[b[keep] - 1], ends[keep]), row[keep]
    return starts, ends, row, np.stack([span_hashes(data, starts, ends, seed) for seed in (0, 1)], 1)


def allowed(length: np.ndarray) -> np.ndarray:
    """Edits that a line of this length allows, as the shorter of two."""
    return np.minimum(length // SHARE, EDITS)


def _binary(h: np.ndarray) -> pa.Array:
    """Rows of two words as 16 bytes each."""
    return pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer((16 * np.arange(len(h) + 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(h))])


def _lists(listed: tuple[list[np.ndarray], list[np.ndarray]], probes: tuple[list[np.ndarray], list[np.ndarray]], n: int) -> list[pa.Array]:
    """For each part of the keys, lists of them by owner; owners without any have an empty list. The last bit marks listed segments."""
    value, owner = np.concatenate([np.zeros(0, np.uint64), *listed[0], *probes[0]]), np.concatenate([np.zeros(0, np.int64), *listed[1], *probes[1]])
    value |= np.uint64(1)
    value[sum(map(len, listed[0])) :] ^= np.uint64(1)
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    part, out = (value >> np.uint64(1)) % np.uint64(PARTS), []
    for k in range(PARTS):
        bounds = np.searchsorted(owner[part == k], np.arange(n + 1)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[part == k].view(np.int64))))
    return out


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, half, line, sketch, keys0, ...): each document's distinct lines, the first of equal ones.

    half is the first half of the line's hash, as a number; keys are those of its listed segments, with a last bit of 1, and of its
    probes, a column for each part. Sketch and keys are null but for the first of equal lines of a slice, with an id and edits to allow.
    """
    names = ["doc_id", "line_no", "half", "line", "sketch", *(f"keys{k}" for k in range(PARTS))]

    def run(batches):
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            for a, _, data, offsets in text_slices(batch.column(1)):
                starts, ends, row, h = line_spans(data, offsets)
                if not len(starts):
                    continue
                number = np.arange(len(row)) - np.searchsorted(row, row)
                order = np.lexsort((number, h[:, 1], h[:, 0], row))
                same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1]).all(axis=1)
                first = np.sort(order[np.r_[True, ~same]])
                starts, sizes, row, number, h = starts[first], (ends - starts)[first], row[first], number[first], np.ascontiguousarray(h[first])
                order = np.lexsort((~known[row + a], h[:, 1], h[:, 0]))
                fresh = np.zeros(len(first), bool)
                fresh[order[np.r_[True, (h[order][1:] != h[order][:-1]).any(axis=1)]]] = True
                fresh &= known[row + a] & (sizes >= SHARE)
                at = np.flatnonzero(fresh)
                sums = Prefixes(data)
                keys = _lists(*(segments(sums, starts[at], sizes[at], probe) for probe in (False, True)), len(at))
                place = np.full(len(first), -1)
                place[at] = np.arange(len(at))
                take = pa.array(place, mask=~fresh)
                columns = [batch.column(0).take(pa.array(row + a)), pa.array(number), pa.array(h[:, 0].view(np.int64)), _binary(h), pa.array(sketches(data, starts[at], sizes[at])).take(take), *(k.take(take) for k in keys)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    types = ["bigint", "bigint", "bigint", "binary", "int", *["array<bigint>"] * PARTS]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, ", ".join(map(" ".join, zip(names, types, strict=True))))


def sketches(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """8 counts of byte values (by their low bits), each modulo 16, in one word for each range of bytes."""
    own = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    counts = np.bincount((own << 3) | (data[at] & 7), minlength=len(start) << 3).reshape(-1, 8) & 15
    return (counts.astype(np.uint32) << np.arange(0, 32, 4, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).view(np.int32)


def _close(a: str, b: str) -> Column:
    """Whether two sketches differ by at most what EDITS edits can change."""
    total = F.lit(0)
    for k in range(0, 32, 4):
        d = F.pmod(F.shiftrightunsigned(a, k).bitwiseAND(15) - F.shiftrightunsigned(b, k).bitwiseAND(15), F.lit(16))
        total = total + F.least(d, 16 - d)
    return total <= 2 * EDITS


def segments(sums: Prefixes, start: np.ndarray, size: np.ndarray, probe: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(keys, owners): the listed segments of each line, or the substrings by which it probes, none of them listed."""
    keys, owners = [], []
    for edits in range(1, EDITS + 1):
        for less in range(edits + 1 if probe else 1):
            length = size - less  # of the shorter line
            own = np.flatnonzero(allowed(length) == edits)
            base, extra = np.divmod(length[own], edits + 1)
            for i in range(edits + 1):
                before = np.maximum(i - (edits + 1 - extra), 0)  # the last segments are one longer
                at, n = base * i + before, base + (i >= edits + 1 - extra)
                low = np.maximum.reduce([at - i, at + less - (edits - i), np.zeros_like(at)]) if probe else at
                high = np.minimum.reduce([at + i, at + less + (edits - i), size[own] - n]) if probe else at
                for step in range(int((high - low).max(initial=-1)) + 1):
                    ok = low + step <= high
                    if probe and less == 0:
                        ok &= low + step != at
                    s = (start[own] + low + step)[ok]
                    keys.append(mix(sums.keys(s, s + n[ok]) + (length[own][ok] * (EDITS + 1) + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                    owners.append(own[ok])
    return keys, owners


def within(a: list[bytes], b: list[bytes], most: int = EDITS) -> np.ndarray:
    """Which pairs have an edit distance of at most `most`: all pairs at once, one bit-parallel step a byte.

    A 64-bit word for each pair follows the diagonal; matches count only inside the
    band of 2 * most + 1 cells, which every path of at most `most` edits stays in.
    """
    swap = [len(p) < len(q) for p, q in zip(a, b, strict=True)]
    x = [q if s else p for p, q, s in zip(a, b, swap, strict=True)]
    y = [p if s else q for p, q, s in zip(a, b, swap, strict=True)]
    nx, ny = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
    out = np.zeros(len(a), bool)
    close = np.flatnonzero(nx - ny <= most)
    close = close[np.argsort(-ny[close], kind="stable")]
    for part in np.array_split(close, max(1, len(close) // 4096)):
        if len(part):
            out[part] = _distances([x[k] for k in part], [y[k] for k in part], nx[part], ny[part], most) <= most
    return out


def _distances(x: list[bytes], y: list[bytes], nx: np.ndarray, ny: np.ndarray, most: int) -> np.ndarray:
    """Distances, right where they are at most `most`; the longer lines x, the shorter y by falling length."""
    width, full = 2 * most + 1, int(ny.max())
    px = np.full((len(x), full + 2 * width), -1, np.int16)
    py = np.full((len(x), full), -2, np.int16)
    for k in range(len(x)):
        px[k, most : most + nx[k]] = np.frombuffer(x[k], np.uint8)[: full + 2 * width - most]
        py[k, : ny[k]] = np.frombuffer(y[k], np.uint8)
    px, py = np.ascontiguousarray(px.T), np.ascontiguousarray(py.T)
    one = np.uint64(1)
    vp = np.full(len(x), np.uint64(((1 << (most + 1)) - 1) << (63 - most)))
    vn = np.zeros(len(x), np.uint64)
    score = np.minimum(nx, most)
    for i in range(full):
        live = int(np.searchsorted(-ny, -i, side="left"))
        p, n = vp[:live], vn[:live]
        eq = np.zeros(live, np.uint64)
        for d in range(width):
            eq |= (px[i + d, :live] == py[i, :live]).astype(np.uint64) << np.uint64(63 - (width - 1 - d))
        d0 = (((eq & p) + p) ^ p) | eq | n
        hp, hn = n | ~(d0 | p), p & d0
        row = np.minimum(62 - (i - (nx[:live] - most)), 63)  # the bit of x's last byte, once the word has passed it
        at = np.maximum(row, 0).astype(np.uint64)
        level = ((hp >> at) & one).astype(np.int64) - ((hn >> at) & one).astype(np.int64)
        score[:live] += np.where(row > 62, (d0 >> np.uint64(63)) == 0, level)
        down = d0 >> one
        vp[:live], vn[:live] = hn | ~(down | hp), down & hp
    return score


def _met(every: DataFrame, keys: str) -> DataFrame:
    """(a, b): first halves of the hashes of lines that meet at a key of this part with near sketches."""
    # both sides of the joins are parts of this, so that Spark deals the distinct lines once
    one = F.row_number().over(Window.partitionBy("line").orderBy("half"))
    each = every.filter(F.col(keys).isNotNull()).select("line", "half", "sketch", keys, one.alias("_one")).filter("_one = 1").select("half", "sketch", F.explode(keys).alias("key"))
    side = lambda last, half, sketch: each.filter(F.col("key").bitwiseAND(1) == last).select(F.shiftrightunsigned("key", 1).alias("key"), F.col("half").alias(half), F.col("sketch").alias(sketch))
    listed = side(1, "b", "_t")
    # a probe meets listed segments of shorter lines and, at other places, of lines as long; equal places are met among the listed
    met = side(0, "a", "_s").join(listed, "key").filter((F.col("a") != F.col("b")) & _close("_s", "_t"))
    met = met.unionByName(side(1, "a", "_s").join(listed, "key").filter((F.col("a") < F.col("b")) & _close("_s", "_t")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): lines, of the pairs of first halves of their hashes, that are within the edits they allow; texts come from the first document that holds each."""
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("half")).distinct())
    held = places.join(wanted, "half", "left_semi").groupBy("line").agg(F.min("doc_id").alias("_id"))
    held = checkpointed(held.groupBy("_id").agg(F.collect_list("line").alias("_lines")))
    if (held.agg(F.sum(F.size("_lines"))).first()[0] or 0) <= MOST_BROADCAST:
        held = F.broadcast(held)  # some 24 bytes a line; beyond that bound documents are dealt by id
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_col).join(held, "_id").select(text_col, "_lines")

    def cut(batches):
        for batch in batches:
            lists = batch.column(1)
            for a, b, data, offsets in text_slices(batch.column(0)):
                starts, ends, row, h = line_spans(data, offsets)
                for k in range(a, b):
                    named = set(lists[k].as_py())
                    found = {v: i for i in range(*np.searchsorted(row, [k - a, k - a + 1]).tolist()) if (v := h[i].tobytes()) in named}
                    if found:
                        at = list(found.values())
                        yield pa.RecordBatch.from_arrays([pa.array(h[at, 0].view(np.int64)), pa.array(list(found), pa.binary()), pa.array([data[starts[i] : ends[i]].tobytes() for i in at], pa.binary())], names=["half", "line", "bytes"])

    texts = checkpointed(texts.mapInArrow(cut, "half bigint, line binary, bytes binary").dropDuplicates(["line"]))
    side = lambda x: texts.select(F.col("half").alias(x), F.col("line").alias(f"l{x}"), F.col("bytes").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("la", "lb", "ta", "tb")

    def run(batches):
        for batch in batches:
            a, b = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            most = allowed(np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64))
            keep = np.zeros(len(a), bool)
            for edits in range(1, EDITS + 1):
                own = np.flatnonzero(most == edits)
                keep[own] = within([a[k] for k in own], [b[k] for k in own], edits)
            yield pa.RecordBatch.from_arrays([batch.column("la"), batch.column("lb")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Places (doc_id, line_no, line) and, for each distinct line, (line, n_links, n_places, first_doc, class_id, own).

    first_doc and n_places (documents' distinct lines that belong to it) are the class's; class_id is null for a
    line without links, which is a class of its own; own marks the line that the class's first document keeps.
    """
    every = stored(lines(docs, id_col, text_col))
    places = every.select("doc_id", "line_no", "half", "line")
    met = [stored(_met(every, f"keys{k}"), clean=True) for k in range(PARTS)]
    pairs = checkpointed(functools.reduce(DataFrame.unionByName, met).distinct())
    links = checkpointed(_verified(pairs, docs, places, id_col, text_col))
    ends = links.select(F.explode(F.array("a", "b")).alias("line"))
    named = checkpointed(checkpointed(ends.groupBy("line").agg(F.count("*").alias("n_links"))).withColumn("node", F.monotonically_increasing_id()))
    number = lambda x: named.select(F.col("line").alias(x), F.col("node").alias(f"n{x}"))
    edges = links.join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    counts = stored(places.groupBy("line").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), clean=True)
    # the linked lines alone have classes to look up
    linked = named.join(components(edges), "node").join(counts, "line").select("line", "n_links", F.col("root").alias("class_id"), "first", "n")
    linked = checkpointed(linked)
    whole = checkpointed(linked.groupBy("class_id").agg(F.min("first").alias("first_doc"), F.sum("n").alias("n_places")))
    linked = checkpointed(linked.join(whole, "class_id"))
    at_first = linked.filter(F.col("first") == F.col("first_doc")).select("line", "class_id", "first_doc")
    own = places.join(at_first, "line").filter(F.col("doc_id") == F.col("first_doc")).groupBy("class_id").agg(F.min(F.struct("line_no", "line"))["line"].alias("line"))
    linked = linked.join(own.select("line", F.lit(True).alias("own")), "line", "left")
    per_line = counts.join(linked.drop("first", "n"), "line", "left").select(
        "line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_places", "n").alias("n_places"), F.coalesce("first_doc", "first").alias("first_doc"), "class_id", F.coalesce("own", F.col("class_id").isNull()).alias("own")
    )
    return places, stored(per_line, clean=True)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, n_links, n_places, first_doc, class_id, kept): one row for each distinct line of each document.

    `kept` marks the one line of a class that its first document keeps, there; lines of rows without an id are kept.
    """
    places, per_line = classes(docs, id_col, text_col)
    kept = F.when(F.col("doc_id").isNull(), True).otherwise(F.col("own") & (F.col("doc_id") == F.col("first_doc")))
    return places.join(per_line, "line").select("doc_id", "line_no", "line", "n_links", "n_places", "first_doc", "class_id", kept.alias("kept"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that `find` does not keep, and without second occurrences of a line in a document.

    A document that loses all its lines goes; other texts keep their remaining lines as they were. Rows without an
    id lose only what they repeat themselves.
    """
    places, per_line = classes(docs, id_col, text_col)
    # a line that stands in one place and is linked to none has no other to be a repeat of
    repeated = per_line.filter("n_places > 1").select("line", "first_doc", "own")
    names = docs.columns
    if repeated.count() <= MOST_REPEATED:
        table = _Repeated(repeated.toArrow())
        shared = docs.sparkSession.sparkContext.broadcast(table)
        ids = F.col(id_col).cast("long").alias("_id")
        joined, bad = docs.select("*", ids), lambda row, h, doc: shared.value.dropped(row, h, doc)
    else:
        rows = places.filter("doc_id is not null").join(repeated, "line")
        gone = rows.filter(~(F.col("own") & (F.col("doc_id") == F.col("first_doc")))).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_drop"))
        joined, bad = docs.join(gone, F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id"), _among
    at, drops = joined.columns.index(text_col), len(names)

    def run(batches):
        for batch in batches:
            text, lists = batch.column(at), batch.column(drops)
            changed: dict[int, str] = {}
            for a, b, data, offsets in text_slices(text):
                starts, _, row, h = line_spans(data, offsets)
                gone_here = np.flatnonzero(_again(row, h) | bad(row, h, lists.slice(a, b - a)))
                for k in np.unique(row[gone_here]).tolist():
                    own = data[offsets[k] : offsets[k + 1]]
                    gone = set(np.searchsorted(np.flatnonzero(own == 10), starts[gone_here[slice(*np.searchsorted(row[gone_here], [k, k + 1]))]] - offsets[k]).tolist())
                    changed[a + k] = b"\n".join(part for i, part in enumerate(own.tobytes().split(b"\n")) if i not in gone).decode()
            if changed:
                rows = np.fromiter(changed, np.int64, len(changed))
                places = np.arange(batch.num_rows)
                places[rows] = batch.num_rows + np.arange(len(rows))
                text = pa.concat_arrays([text, pa.array(list(changed.values()), text.type)]).take(pa.array(places))
            keep = np.ones(batch.num_rows, bool)
            keep[[k for k, t in changed.items() if not t.strip()]] = False
            columns = [text if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)


class _Repeated:
    """Repeated lines by their hashes, and the document that keeps each, if one does."""

    def __init__(self, rows: pa.Table):
        h = np.frombuffer(b"".join(rows.column("line").to_pylist()), np.uint64).reshape(-1, 2)
        owner = np.where(rows.column("own").to_numpy(), pc.fill_null(rows.column("first_doc"), 0).to_numpy(), 0)
        kept = rows.column("own").to_numpy() & ~pc.is_null(rows.column("first_doc")).to_numpy()
        order = np.lexsort((h[:, 1], h[:, 0]))
        self.h, self.owner, self.kept = h[order], owner[order], kept[order]

    def dropped(self, row: np.ndarray, h: np.ndarray, docs: pa.Array) -> np.ndarray:
        """Which lines are repeated ones that their document does not keep; a row without an id drops none."""
        out = np.zeros(len(row), bool)
        if not len(self.h) or not len(row):
            return out
        docs, known = pc.fill_null(docs, 0).to_numpy(zero_copy_only=False)[row], ~pc.is_null(docs).to_numpy(zero_copy_only=False)[row]
        at, stop = (np.searchsorted(self.h[:, 0], h[:, 0], side) for side in ("left", "right"))
        live = np.flatnonzero(at < stop)
        while len(live):  # several lines hardly ever share the first half
            here = at[live]
            same = self.h[here, 1] == h[live, 1]
            hit = live[same]
            out[hit] = known[hit] & ~(self.kept[at[hit]] & (self.owner[at[hit]] == docs[hit]))
            live = live[~same]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


def _again(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which lines stand in their text before."""
    out = np.zeros(len(row), bool)
    order = np.lexsort((h[:, 1], h[:, 0], row))  # stable, so the first of equal lines comes first
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1]).all(axis=1)
    out[order[1:][same]] = True
    return out


def _among(row: np.ndarray, h: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which lines are in the list of their row, by both halves of their hashes."""
    values = lists.flatten()
    if not len(values):
        return np.zeros(len(row), bool)
    listed = np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    salt = lambda r: mix(r.astype(np.uint64) + np.uint64(1))
    return np.isin(h[:, 0] ^ salt(row), listed[:, 0] ^ salt(owner)) & np.isin(h[:, 1] ^ salt(row), listed[:, 1] ^ salt(owner))
