"""Repeated substrings across documents (operator 6), by suffix sorting with difference covers.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller id; strings are compared as in the input and never cross documents.

Sorting the suffixes of a whole corpus moves many times its size, so positions
are thinned out first, without loss.  Every LENGTH-byte window has an anchor: the
least-hashed GRAM-byte string in it.  Equal windows have equal anchors, so only
windows whose anchor occurs in two documents can repeat.  Runs of such windows
with one anchor are cut out as short strings; equal strings are merged with
their least document, and the distinct strings with the same anchor meet in one
task, packed and compressed on the way.

There their suffixes are sorted by the difference-cover algorithm in numpy: the
triples at two of three positions are sorted and named, names that are not
unique are sorted by recursion, the suffixes at the third positions follow from
their first byte and the next one's rank, and the two orders are merged by
counting.  Neighbours in the order whose first LENGTH bytes are equal form the
classes of equal windows; a class's least document keeps it, and every other
occurrence is removed.

The strings of one anchor meet in one part, so a 20-byte string in very many
different surroundings makes a large one: 80 bytes for each different surrounding
of 30 bytes on either side, however many copies there are.

Nulls and empty texts have no bytes and keep none; long texts are handled whole;
columns but the id and the text are not read; of tied holders none goes; rows without an id neither
give nor lose anything; rows that share an id take nothing from each
other, each loses what smaller ids hold; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import stored
from .text import eights, mix, step, text_slices

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Bytes of strings whose suffixes are sorted at once (more only where one anchor has more distinct strings).
CHUNK_BYTES = 1 << 20
#: Runs of windows for each part of the strings, about (some 100 bytes each, fewer where strings repeat).
PART_RUNS = 300_000


# -- the difference-cover algorithm ------------------------------------------


def _order(keys: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows by several keys below `top`, and dense names in that order."""
    bits, n = max(int(top - 1).bit_length(), 1), len(keys[0])
    own = max(n - 1, 1).bit_length()
    if max(bits, own) + bits + own > 63:  # more rows than a word has room for
        order = np.lexsort(keys[::-1])
        new = np.zeros(max(n - 1, 0), bool)
        for k in keys:
            s = k[order]
            new |= s[1:] != s[:-1]
        return order, np.r_[0, np.cumsum(new)] if n else np.zeros(0, np.int64)
    # values and places share a word, so that plain numbers are sorted; the names of the first keys stand for them beside the next
    packed, used = keys[0], bits
    for k in keys[1:]:
        if used + bits + own > 63:
            order, names = _placed(packed, own)
            packed, used = np.empty(n, np.int64), own
            packed[order] = names
        packed, used = (packed << bits) | k, used + bits
    return _placed(packed, own)


def _placed(values: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of values that leave `own` bits for their places, and dense names in that order."""
    both = np.sort((values.astype(np.int64) << own) | np.arange(len(values)))
    ordered = both >> own
    names = np.zeros(len(both), np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=names[1:])
    return both & ((1 << own) - 1), names


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank of each suffix of an array of positive integers; a suffix's end sorts before everything."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    padded = np.r_[s, 0, 0, 0].astype(np.int64)
    top = int(s.max()) + 1
    # the cover {1, 2} of 3; an empty position closes the first half of the names when n mod 3 is 1
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    order, names = _order([padded[sample], padded[sample + 1], padded[sample + 2]], top)
    name = np.empty(len(sample), np.int64)
    name[order] = names
    ranks = name if names[-1] == len(sample) - 1 else suffix_ranks(name + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranks + 1
    rank[n:] = 0
    width = len(sample) + 2
    first = np.empty(len(sample), np.int64)
    first[ranks] = sample  # sample suffixes in order
    first = first[first < n]
    zeros = zero[_order([padded[zero], rank[zero + 1]], max(top, width))[0]]
    # how many suffixes at third positions stand before each sample suffix
    before = np.empty(n, np.int64)
    for mod in (1, 2):
        own = first[first % 3 == mod]
        both = np.concatenate([zeros, own])
        keys = [padded[both], *([padded[both + 1]] if mod == 2 else []), rank[both + mod]]
        at = np.empty(len(both), np.int64)
        at[_order(keys, max(top, width))[0]] = np.arange(len(both))
        before[own] = at[len(zeros) :] - np.arange(len(own))
    out = np.empty(n, np.int64)
    out[first] = np.arange(len(first)) + before[first]
    taken = np.zeros(n, bool)
    taken[out[first]] = True
    out[zeros] = np.flatnonzero(~taken)
    return out


def window_classes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all LENGTH-byte windows of strings that end at `ends`, class of each): equal classes, equal bytes."""
    lengths = np.diff(np.r_[0, ends])
    # every string gets an end mark of its own, so no comparison runs on into the next
    shift = np.repeat(np.arange(len(ends)), lengths)
    symbols = np.zeros(len(data) + len(ends), np.int64)
    at = np.arange(len(data)) + shift
    symbols[at] = data.astype(np.int64) + len(ends) + 1
    symbols[ends + np.arange(len(ends))] = np.arange(len(ends)) + 1
    ranks = suffix_ranks(symbols)
    left = np.repeat(ends, lengths) - np.arange(len(data))
    starts = np.flatnonzero(left >= LENGTH)
    by_rank = starts[np.argsort(ranks[at[starts]], kind="stable")]
    views = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    new = np.ones(len(by_rank), bool)
    for a in range(0, len(by_rank), 1 << 16):
        b = min(len(by_rank) - 1, a + (1 << 16))
        new[a + 1 : b + 1] = (views[by_rank[a + 1 : b + 1]] != views[by_rank[a:b]]).any(axis=1)
    return by_rank, np.cumsum(new) - 1


# -- anchors -------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor hash) of the runs of windows that share an anchor."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    grams = _grams(data)
    # least hash first, then the leftmost place: both in one word
    low = np.uint64(0xFFFFFFFF)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < WINDOW:
        best = np.minimum(best[: -(WINDOW - size)], best[WINDOW - size :])
    place = (best & low).astype(np.int64)
    valid = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        valid[max(0, end - LENGTH + 1) : end] = False
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(offsets, a, side="right") - 1, a, b, grams[place[a]]


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(part, doc, h) of every document's anchors, h null where it is the part.

    Of an anchor that a slice holds in more than two documents all but two are known to occur twice:
    these are dealt by anchor and document, so that no anchor, however common, gathers in one task.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, _, data, offsets in text_slices(batch.column(1)):
                row, _, _, h = anchors(data, offsets)
                doc = ids[row + a]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
                h, doc = h[fresh], doc[fresh]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
                nth = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
                known = nth > 1
                part = np.where(known, mix(h ^ mix(doc.astype(np.uint64))), h)
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(doc), pa.array(h.view(np.int64), mask=~known)], names=["part", "doc", "h"])

    return texts.mapInArrow(run, "part bigint, doc bigint, h bigint")


def _in_two(rows: DataFrame) -> DataFrame:
    """The (doc, h) rows whose anchor occurs in two documents: one pass over each sorted partition, a row held at most.

    The low 32 bits of h are enough: within a document another anchor that has them brings strings that no one shares.
    """

    def run(batches):
        held_h, held_doc, known = None, None, False
        for batch in batches:
            given = np.asarray(batch.column(2).is_valid())
            if given.any():
                sure = batch.filter(pa.array(given))
                yield pa.RecordBatch.from_arrays([sure.column(1), pa.array(sure.column(2).to_numpy().astype(np.int32))], names=["doc", "h"])
            h, doc = batch.column(0).to_numpy()[~given], batch.column(1).to_numpy()[~given]
            if not len(h):
                continue
            fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            fresh[0] = (held_h, held_doc) != (int(h[0]), int(doc[0]))
            h, doc = h[fresh], doc[fresh]
            if held_h is not None and not known:
                h, doc = np.r_[held_h, h], np.r_[held_doc, doc]
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            several = np.r_[False, same] | np.r_[same, False]
            if known:
                several |= h == held_h
            end = int(h[-1])
            hold = not several[-1]
            out = several
            held_h, held_doc, known = end, int(doc[-1]), not hold
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(h[out].astype(np.int32))], names=["doc", "h"])

    return rows.repartition("part").sortWithinPartitions("part", "doc").mapInArrow(run, "doc bigint, h int")


def _sids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Identities of strings of LENGTH bytes or more: 128-bit hashes, two words each, mixed after every eight bytes."""
    n, words = ends - starts, eights(data)
    out = np.stack([mix(n.astype(np.uint64) + np.uint64(salt)) for salt in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B)])
    for at in range(0, LENGTH - 7, 8):
        out = step(out, words[starts + at])
    live, at = np.arange(len(n)), -(-(LENGTH - 7) // 8) * 8
    while len(live := live[n[live] > at]):
        out[:, live] = step(out[:, live], words[starts[live] + np.minimum(at, n[live] - 8)])
        at += 8
    return np.ascontiguousarray(mix(out).T).view(np.int64)


def _distinct(sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct identity, the number of its identity for each row)."""
    order = np.lexsort((sid[:, 1], sid[:, 0]))
    new = np.r_[True, (sid[order][1:] != sid[order][:-1]).any(axis=1)][: len(sid)]
    same = np.empty(len(sid), np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


def _marked_runs(batch: pa.RecordBatch):
    """(row, data, offsets, first, last, string identity, anchor hash) of the runs, in each slice of a batch (doc, text, hs, th), whose anchor is in hs."""
    hashes = batch.column(2)
    for a, b, data, offsets in text_slices(batch.column(1)):
        part = hashes.slice(a, b - a)
        if part.null_count == len(part):
            continue
        row, first, last, h = anchors(data, offsets)
        wanted = part.flatten().to_numpy().view(np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
        wanted = np.sort((owner << 32) | wanted)
        if not len(wanted):
            continue
        own = (row << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keep = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
        row, first, last, h = row[keep], first[keep], last[keep], h[keep]
        if len(row):
            yield row + a, data, offsets[row], first, last, _sids(data, first, last + LENGTH), h


def _occurrences(marked: DataFrame) -> DataFrame:
    """(sid, sid2, doc, th, start) of every string of windows with an anchor that occurs in two documents."""

    def run(batches):
        for batch in batches:
            ids, th = batch.column(0).fill_null(0).to_numpy(), batch.column(3).to_numpy()
            for row, _, base, first, _, sid, _ in _marked_runs(batch):
                yield pa.RecordBatch.from_arrays([pa.array(sid[:, 0]), pa.array(sid[:, 1]), pa.array(ids[row]), pa.array(th[row]), pa.array(first - base)], names=["sid", "sid2", "doc", "th", "start"])

    return marked.mapInArrow(run, "sid bigint, sid2 bigint, doc bigint, th int, start bigint")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _dictionary(marked: DataFrame, parts: int) -> DataFrame:
    """(part, n, size, payload): the distinct strings of each batch with their least and greatest document.

    Strings with one anchor go to one part; a payload is their lengths, documents and bytes, compressed together.
    """

    def pack(part, length, least, most, data, begin):
        order = np.argsort(part, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(order)]
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            raw = length[own].tobytes() + least[own].tobytes() + most[own].tobytes() + data[_ranges(begin[own], length[own].astype(np.int64))].tobytes()
            rows.append((int(part[own[0]]), len(own), len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "n", "size", "payload"])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            sids, docs, sizes, texts, hs = [], [], [], [], []
            for row, data, _, first, last, sid, h in _marked_runs(batch):
                # one of the equal strings of a slice, with all documents
                one, same = _distinct(sid)
                size = last[one] - first[one] + LENGTH
                least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
                np.minimum.at(least, same, ids[row])
                np.maximum.at(most, same, ids[row])
                sids.append(sid[one])
                hs.append(h[one])
                docs.append((least, most))
                sizes.append(size)
                texts.append(data[_ranges(first[one], size)])
            if not sids:
                continue
            sid, size, data = np.concatenate(sids), np.concatenate(sizes), np.concatenate(texts)
            least, most = (np.concatenate(x) for x in zip(*docs, strict=True))
            begin = np.cumsum(size) - size
            one, same = _distinct(sid)
            low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
            np.minimum.at(low, same, least)
            np.maximum.at(high, same, most)
            part = (np.concatenate(hs)[one] % np.uint64(parts)).astype(np.int32)
            yield pack(part, size[one].astype(np.uint8), low, high, data, begin[one])

    return marked.mapInArrow(run, "part int, n int, size bigint, payload binary")


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    words = eights(data)
    h = np.full(n, np.uint64(GRAM))
    for at in [*range(0, GRAM - 7, 8), *([GRAM - 8] if GRAM % 8 else [])]:
        h = step(h, words[at : at + n])
    return mix(h)


def _string_hashes(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each of the strings that follow one another, and of its anchor, that of its first window."""
    ends = np.cumsum(length)
    sids, anchors_, at = [], [], 0
    while at < len(length):  # a megabyte or so at a time
        start = int(ends[at] - length[at])
        stop = max(at + 1, int(np.searchsorted(ends, start + CHUNK_BYTES, side="right")))
        part = data[start : ends[stop - 1]]
        begin = ends[at:stop] - length[at:stop] - start
        sids.append(_sids(part, begin, begin + length[at:stop]))
        grams = _grams(part)
        least = np.argmin(grams[begin[:, None] + np.arange(WINDOW)] >> np.uint64(32), axis=1)
        anchors_.append(grams[begin + least])
        at = stop
    return np.concatenate(sids), np.concatenate(anchors_)


def _least_documents(dictionary: DataFrame) -> DataFrame:
    """(sid, sid2, n, least array): for each distinct string the least document that holds each of its n windows.

    One value stands for all windows where they agree.  Strings of a single document that shares no window are left out.
    """

    def solve(length, least, most, data):
        begin = np.cumsum(length) - length
        sid, anchor = _string_hashes(data, length)
        one, same = _distinct(sid)
        low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(low, same, least)
        np.maximum.at(high, same, most)
        h = anchor[one]
        order = np.argsort(h, kind="stable")
        one, h, least, most = one[order], h[order], low[order], high[order]
        sid, length, begin = sid[one], length[one], begin[one]
        windows = length - LENGTH + 1
        values = np.repeat(least, windows)
        first = np.cumsum(windows) - windows
        several = np.flatnonzero(np.r_[False, h[1:] == h[:-1]] | np.r_[h[1:] == h[:-1], False])
        at = 0
        while at < len(several):
            ends = np.cumsum(length[several[at:]])
            stop = at + max(1, int(np.searchsorted(ends, CHUNK_BYTES, side="right")))
            while stop < len(several) and h[several[stop]] == h[several[stop - 1]]:
                stop += 1  # an anchor's strings stay together
            part = several[at:stop]
            ends = np.cumsum(length[part])
            starts, cls = window_classes(data[_ranges(begin[part], length[part])], ends)
            own = np.searchsorted(ends, starts, side="right")
            slot = first[part][own] + starts - (ends - length[part])[own]
            values[slot] = np.minimum.reduceat(values[slot], np.searchsorted(cls, np.arange(cls[-1] + 1)))[cls]
            at = stop
        bottom, top = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
        useful = bottom < most
        flat = useful & (bottom == top)
        size = np.where(flat, 1, windows)[useful]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values[_ranges(first[useful], size)]))
        return pa.RecordBatch.from_arrays([pa.array(sid[useful, 0]), pa.array(sid[useful, 1]), pa.array(windows[useful].astype(np.int32)), lists], names=["sid", "sid2", "n", "least"])

    def unpack(rows):
        lengths, leasts, mosts, datas = [], [], [], []
        for n, size, payload in rows:
            raw = pa.decompress(payload, decompressed_size=size, codec="zstd", asbytes=True)
            lengths.append(np.frombuffer(raw, np.uint8, n))
            leasts.append(np.frombuffer(raw, np.int64, n, n))
            mosts.append(np.frombuffer(raw, np.int64, n, 9 * n))
            datas.append(np.frombuffer(raw, np.uint8, offset=17 * n))
        return solve(np.concatenate(lengths).astype(np.int64), np.concatenate(leasts), np.concatenate(mosts), np.concatenate(datas))

    def run(batches):
        held, part = [], None
        for batch in batches:
            for p, n, size, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and held:
                    yield unpack(held)
                    held = []
                part = p
                held.append((n, size, payload))
        if held:
            yield unpack(held)

    return dictionary.repartition("part").sortWithinPartitions("part").mapInArrow(run, "sid bigint, sid2 bigint, n int, least array<bigint>")


def _runs(found: DataFrame) -> DataFrame:
    """(doc, th, a, b): byte ranges to remove, one or more for each occurrence with a smaller holder."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, start, n = (batch.column(c).to_numpy() for c in ("doc", "start", "n"))
            lists = batch.column("least")
            given = pc.list_value_length(lists).to_numpy()
            least = np.repeat(lists.flatten().to_numpy(), np.repeat(np.where(given == 1, n, 1), given))
            bounds = np.cumsum(n) - n
            row = np.repeat(np.arange(len(doc)), n)
            gone = least < doc[row]
            edge = np.r_[True, row[1:] != row[:-1]]
            begin = gone & (edge | np.r_[True, ~gone[:-1]])
            close = gone & (np.r_[edge[1:], True] | np.r_[~gone[1:], True])
            p, q = np.flatnonzero(begin), np.flatnonzero(close)
            base = start[row[p]] - bounds[row[p]]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[p]]), batch.column("th").take(pa.array(row[p])), pa.array(base + p), pa.array(base + q + LENGTH)], names=["doc", "th", "a", "b"])

    return found.mapInArrow(run, "doc bigint, th int, a bigint, b bigint")


def _by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) dealt by document. Every join of texts below starts from this very plan, left joins all, so that Spark moves the texts once."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).repartition("doc")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans array<struct<th,a,b>>): byte ranges of each text, of those with the id the one with the hash th, that smaller ids hold; they may overlap."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_col).filter((F.octet_length(text_col) >= LENGTH) & F.col("doc").isNotNull())
    several = stored(_in_two(_anchor_rows(texts)).groupBy("doc").agg(F.collect_list("h").alias("hs")), clean=True)
    runs = several.agg(F.sum(F.size("hs"))).first()[0] or 0
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs // PART_RUNS))
    marked = _by_document(docs, id_col, text_col).join(several.hint("shuffle_hash"), "doc", "left").select("doc", "text", "hs", F.hash("text").alias("th"))
    least = _least_documents(_dictionary(marked, parts))
    found = _occurrences(marked).join(least, ["sid", "sid2"]).filter(F.array_min("least") < F.col("doc"))
    ranges = _runs(found.select("doc", "th", "start", "n", "least"))
    return ranges.groupBy("doc").agg(F.collect_list(F.struct("th", "a", "b")).alias("spans"))


def _kept(size: int, offsets: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask of the remaining bytes of texts that follow one another, removed bytes and maximal removed runs of each): ranges a to b of the texts `row` go."""
    depth = np.bincount(offsets[row] + a, minlength=size + 1) - np.bincount(offsets[row] + b, minlength=size + 1)
    gone = np.cumsum(depth)[:size] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edges = offsets[:-1][offsets[:-1] < size]
    begins[edges] = gone[edges]
    counts = (np.r_[0, np.cumsum(x)] for x in (gone, begins))
    return ~gone, *(np.diff(x[offsets]) for x in counts)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary without digest]) of each row."""
    found = spans(docs, id_col, text_col)
    joined = _by_document(docs, id_col, text_col).join(found.hint("shuffle_hash"), "doc", "left")
    joined = joined.select("doc", "text", F.filter("spans", lambda x: x["th"] == F.hash("text")).alias("spans"))

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                ranges = batch.column(2).slice(first, end - first)
                row = np.repeat(np.arange(end - first), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy())
                a, b = (ranges.flatten().field(c).to_numpy() for c in "ab")
                mask, removed, n_spans = _kept(len(data), offsets, row, a, b)
                rest, sizes = data[mask].tobytes(), np.diff(offsets)
                close = np.cumsum(sizes - removed).tolist()
                kept = [rest[p:q] for p, q in zip([0, *close], close)]
                columns = [batch.column(0).slice(first, end - first), pa.array(sizes), pa.array(removed), pa.array(n_spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([None] * len(kept) if digest else kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.drop("kept") if digest else out
