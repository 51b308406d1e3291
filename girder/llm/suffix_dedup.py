"""Exact removal of repeated byte strings by a distributed merge sort of front-coded suffix runs.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id. Sorting the
suffixes at all positions would move each text ``length`` times, so suffixes are sorted at anchors only: every
window of ``length`` bytes has as its anchor the leftmost least ``GRAM``-byte gram by hash, which depends on
the window's bytes alone, so equal windows have equal anchors at equal offsets.

1. Exact copies of a text with a smaller id are set aside before anything is sorted: they go whole.
2. Every anchor gram's hash is exchanged by bucket; those that occur in two documents or more are named to their
   documents, as only their suffixes can be equal. Grams that a task sees in two documents itself are sent once, so a common
   passage does not flood a bucket. A sample of the grams gives the bounds of the suffix ranges.
3. The named anchors' suffixes (``length`` bytes on, with the bytes before that windows may need) are sorted by
   each task, front-coded as (common prefix, rest) runs and exchanged by range, so the ranges in turn hold all suffixes
   in order. A suffix that follows an equal one with equal bytes before it stays where it is: one
   record stands for all documents of a batch that have the same bytes.
4. A task combines the runs of its range with a loser tree that compares common-prefix lengths first and bytes only behind
   them. From the merged order and its common prefixes follow, for every offset, the classes of equal bytes ahead; sorting the
   bytes before the anchors backwards gives the classes behind. Windows of equal classes are equal; those whose class
   has a smaller doc_id are named to their documents, which cut the covered bytes.

The number of buckets and ranges grows with the input. What a bucket or a range tells documents leaves it as one row for each
of the few parts that documents are dealt over by hash, not one row for each document. Texts move by (doc_id, hash) only, which is even; copies of one text
are met under salts.

Defined cases: null text is empty; texts shorter than ``length`` keep everything; repeats inside one document and
rows with the same doc_id do not count; a null doc_id keeps its text and removes nothing; an empty table gives
an empty result. Whole copies are compared by SHA-256 and length; grams are chosen by 64-bit hashes; windows by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.textkernel import U64, mix, powers, text_bytes, tidy, tidy_group
from girder.scratch import Scratch

GRAM = 20
PIECE = 1 << 19
BUCKET_BYTES = 4 << 20
MOST_GRAMS = 1 << 20
MOST_SUFFIXES = 150_000
SAMPLE = 1 << 18  # grams that the driver gets, about
SALTS = 8
PART_BUCKETS = 16  # buckets of text to a part of the documents
NAMED = "bucket int, batch long, docs binary, counts binary, low binary, high binary, pos binary, doc_id long, mark long, named binary"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power, out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverse[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, first window, last window, gram hash) of every anchor; positions count from the chunk's start."""
    hashes = gram_hashes(data, gram)
    windows = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none, np.zeros(0, U64)
    best = np.arange(len(hashes), dtype=np.int32)
    reach, width = 1, length - gram + 1

    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[right] < hashes[left], right, left)

    while 2 * reach <= width:
        best = join(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = join(best[: windows], best[width - reach : width - reach + windows])
    best = best[:windows].astype(np.int64)
    at = np.arange(windows)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    whole = at + length <= offsets[1:][row]
    at, best, row = at[whole], best[whole], row[whole]
    if not len(at):
        return none, none, none, none, np.zeros(0, U64)
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[first], best[first], at[first], at[last], hashes[best[first]]


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, start in the row) of chunks; a long text comes in pieces that overlap by length - 1 bytes."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[end])
        if b - a <= 2 * PIECE:
            yield row, data[a:b], offsets[row : end + 1] - a, 0
        else:
            for start in range(a, b - length + 1, PIECE):
                stop = min(b, start + PIECE + length - 1)
                yield row, data[start:stop], np.array([0, stop - start]), start - a
        row = end


def name_grams(length: int, gram: int, buckets: int, rate: float):
    """A function for mapInArrow: (doc_id, mark, text) to NAMED rows: grams for the buckets, or positions that are known already.

    Rows without a document hold the bytes of sampled grams. Of those that the batch has in two documents or more, whose suffixes
    will be sorted, each occurrence is taken with chance ``rate``, of the others with an eighth of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            whole, starts = text_bytes(batch.column("text"))
            waiting: list[tuple[np.ndarray, ...]] = []
            size = 0

            def sent(whole=whole, starts=starts, ids=ids, marks=marks) -> pa.RecordBatch:
                row, pos, h = (np.concatenate(x) for x in zip(*waiting, strict=True))
                order = np.argsort(h, kind="stable")
                row, pos, h = row[order], pos[order], h[order]
                many, _ = in_two(h, row)
                chance = (mix(h ^ mix(marks[row].view(U64) + pos.astype(U64))) >> U64(11)) * 2.0**-53
                drawn = chance < np.where(many, rate, rate / 8)
                taken = whole[(starts[row[drawn]] + pos[drawn])[:, None] + np.arange(gram)]
                return _grams(row, pos, h, many, ids, marks, buckets, taken.tobytes())

            for first, data, offsets, start in pieces(batch.column("text"), length):
                row, pos, _, _, h = anchors(data, offsets, length, gram)
                waiting.append((row + first, pos - offsets[row] + start, h))
                size += len(row)
                if size >= MOST_GRAMS:
                    yield sent()
                    waiting.clear()
                    size = 0
            if size:
                yield sent()

    return run


_NAMED = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("docs", "counts", "low", "high", "pos")], ("doc_id", pa.int64()), ("mark", pa.int64()), ("named", pa.binary())])


def _grams(row: np.ndarray, pos: np.ndarray, h: np.ndarray, many: np.ndarray, ids: np.ndarray, marks: np.ndarray, buckets: int, drawn: bytes) -> pa.RecordBatch:
    heads = np.ones(len(h), bool)
    heads[1:] = h[1:] != h[:-1]
    send = ~many | heads  # of a gram in two documents one entry goes on, for other tasks to meet
    out = [*named_rows(row[many], pos[many], ids, marks, buckets), *gram_rows(row[send], pos[send], h[send], many[send], ids, marks, buckets)]
    return pa.RecordBatch.from_pylist([*out, {"bucket": -1, "named": drawn}], _NAMED)


def in_two(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: whether each key has two owners or more, and the number of its group."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts))[group], group


def named_rows(row: np.ndarray, pos: np.ndarray, ids: np.ndarray, marks: np.ndarray, buckets: int) -> Iterator[dict]:
    """One row (doc_id, mark, named positions) per document."""
    order = np.argsort(row, kind="stable")
    row, pos = row[order], pos[order]
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
        if len(part):
            k = row[part[0]]
            yield {"bucket": int(marks[k] % buckets), "doc_id": int(ids[k]), "mark": int(marks[k]), "named": pos[part].astype(np.int64).tobytes()}


def gram_rows(row: np.ndarray, pos: np.ndarray, h: np.ndarray, many: np.ndarray, ids: np.ndarray, marks: np.ndarray, buckets: int) -> list[dict]:
    """One row per bucket: entries by document, with 40 bits of the hash below the bucket, in byte planes."""
    bucket = (h >> U64(44)) % U64(buckets)
    order = np.lexsort((pos, row, bucket))
    row, pos, h, many, bucket = row[order], pos[order], h[order], many[order], bucket[order]
    out = []
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(bucket)) + 1):
        if not len(part):
            continue
        new = np.ones(len(part), bool)
        new[1:] = row[part[1:]] != row[part[:-1]]
        starts = np.flatnonzero(new)
        owners = row[part[starts]]
        place = pos[part].astype(np.uint64) << U64(1) | many[part].astype(U64)
        out.append(
            {
                "bucket": int(bucket[part[0]]),
                "batch": int(mix(h[part[:1]]).view(np.int64)[0]),
                "docs": np.concatenate([ids[owners], marks[owners]]).tobytes(),
                "counts": np.diff(np.append(starts, len(part))).astype(np.int32).tobytes(),
                "low": (h[part] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                "high": (h[part] >> U64(32)).astype(np.uint32).astype(np.uint16).tobytes(),
                "pos": b"".join(((place >> U64(16 * k)) & U64(0xFFFF)).astype(np.uint16).tobytes() for k in range(3)),
            }
        )
    return out


#: What documents are told: ids and marks, the number of 64-bit words of each, the words.
PACKED = "part int, docs binary, counts binary, words binary"
_PACKED = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("docs", "counts", "words")]])
Told = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def gather(words: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The words of segments in another order of the segments."""
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    return words[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


def told_before(known: pa.Table) -> Told:
    """(ids, marks, counts, words) of rows (doc_id, mark, words) that a task knew by itself."""
    blobs = known.column(2).to_pylist()
    return known.column("doc_id").to_numpy(), known.column(1).to_numpy(), np.array([len(b) // 8 for b in blobs], np.int64), np.frombuffer(b"".join(blobs), np.int64)


def told_here(ids: np.ndarray, marks: np.ndarray, words: np.ndarray) -> Told:
    """The same of a row of words for each finding, with the findings of a document brought together."""
    order = np.lexsort((marks, ids))
    ids, marks, words = ids[order], marks[order], words[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    return ids[first], marks[first], np.diff(np.append(first, len(ids))) * words.shape[1], words.ravel()


def packed(told: list[Told], parts: int) -> pa.Table:
    """PACKED rows: one for each part that has a document."""
    ids, marks, counts, words = (np.concatenate(x).astype(np.int64) for x in zip(*told, strict=True))
    part = (mix(marks.view(U64) ^ mix(ids.view(U64))) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    words = gather(words, counts, order)
    ids, marks, counts, part = ids[order], marks[order], counts[order], part[order]
    ends = np.cumsum(counts)
    rows = []
    for own in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
        if len(own):
            a, b = own[0], own[-1] + 1
            of = words[ends[a] - counts[a] : ends[b - 1]]
            rows.append({"part": int(part[a]), "docs": np.concatenate([ids[a:b], marks[a:b]]).tobytes(), "counts": counts[a:b].tobytes(), "words": of.tobytes()})
    return pa.Table.from_pylist(rows, _PACKED)


def unpack(table: pa.Table) -> pa.Table:
    """For applyInArrow on a part: PACKED rows to one row (doc_id, mark, words) for each document."""
    docs = [np.frombuffer(b, np.int64).reshape(2, -1) for b in table.column("docs").to_pylist()]
    ids, marks = np.concatenate(docs, axis=1)
    counts, words = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("counts", "words"))
    order = np.lexsort((marks, ids))
    words = gather(words, counts, order)
    ids, marks, counts = ids[order], marks[order], counts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    first = np.flatnonzero(new)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, first) * 8)])
    blobs = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words)])
    return pa.table({"doc_id": ids[first], "mark": marks[first], "words": blobs.cast(pa.binary())})


def meet_grams(parts: int):
    """A function for applyInArrow on a bucket: NAMED rows to PACKED positions of grams in two documents; sampled grams go on in part -1."""

    def run(table: pa.Table) -> pa.Table:
        ids, marks, doc, keys, places = [], [], [], [], []
        known = table.filter(pc.is_valid(table.column("named"))).select(["doc_id", "mark", "named"])
        drawn = known.filter(pc.is_null(known.column("doc_id"))).column("named").to_pylist()
        drawn = pa.Table.from_pylist([{"part": -1, "words": b} for b in drawn], _PACKED)
        told = [told_before(known.filter(pc.is_valid(known.column("doc_id"))))]
        base = 0
        for r in table.filter(pc.is_null(table.column("named"))).to_pylist():
            both = np.frombuffer(r["docs"], np.int64).reshape(2, -1)
            ids.append(both[0])
            marks.append(both[1])
            counts = np.frombuffer(r["counts"], np.int32)
            doc.append(np.repeat(np.arange(len(counts)) + base, counts))
            base += len(counts)
            keys.append(np.frombuffer(r["low"], np.uint32).astype(U64) | np.frombuffer(r["high"], np.uint16).astype(U64) << U64(32))
            planes = np.frombuffer(r["pos"], np.uint16).astype(U64).reshape(3, -1)
            places.append(planes[0] | planes[1] << U64(16) | planes[2] << U64(32))
        if not base:
            return pa.concat_tables([drawn, packed(told, parts)])
        ids, marks, doc, keys, place = (np.concatenate(x) for x in (ids, marks, doc, keys, places))
        order = np.argsort(keys, kind="stable")
        doc, keys, place = doc[order], keys[order], place[order]
        shared = (place & U64(1)).astype(bool)
        two, group = in_two(keys, doc)
        if len(group):
            two |= (np.bincount(group, shared) > 0)[group]
        two &= ~shared  # those were named by their own task
        told.append(told_here(ids[doc[two]], marks[doc[two]], (place >> U64(1)).astype(np.int64)[two][:, None]))
        return pa.concat_tables([drawn, packed(told, parts)])

    return run


#: A run: front-coded suffixes of one task for one bucket, with what the windows need.
RUN = "bucket int, lcp binary, rest binary, left binary, doc binary, mark binary, pos binary, low binary, high binary, doc_id long, row_mark long, cut binary"
_RUN = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("lcp", "rest", "left", "doc", "mark", "pos", "low", "high")], ("doc_id", pa.int64()), ("row_mark", pa.int64()), ("cut", pa.binary())])


def suffix_runs(length: int, gram: int, splits: np.ndarray):
    """A function for mapInArrow: (doc_id, mark, named, text) to RUN rows: sorted runs for the ranges between ``splits``, or cuts that are known already."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            named = [np.unique(np.frombuffer(b, np.int64)) for b in batch.column("named").to_pylist()]
            waiting: list[tuple[np.ndarray, ...]] = []
            size = 0
            for first, data, offsets, start in pieces(batch.column("text"), length):
                row, pos, lo, hi, h = anchors(data, offsets, length, gram)
                place = pos - offsets[row] + start
                keep = np.zeros(len(row), bool)
                ends = np.searchsorted(row, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    a, b = ends[k], ends[k + 1]
                    keep[a:b] = np.isin(place[a:b], named[first + k])
                row, pos, lo, hi, h, place = (x[keep] for x in (row, pos, lo, hi, h, place))
                padded = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)])
                context = np.lib.stride_tricks.sliding_window_view(padded, before + length)[pos]
                waiting.append((row + first, place, pos - hi, pos - lo, h, context))
                size += len(row)
                if size >= MOST_SUFFIXES:
                    yield _runs(waiting, ids, marks, before, length, gram, splits)
                    waiting, size = [], 0
            if size:
                yield _runs(waiting, ids, marks, before, length, gram, splits)

    return run


def big_endian(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers that are in the same order."""
    words = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    words[:, : x.shape[1]] = x
    return words.view(">u8").astype(U64)


def _runs(waiting: list[tuple[np.ndarray, ...]], ids: np.ndarray, marks: np.ndarray, before: int, length: int, gram: int, splits: np.ndarray) -> pa.RecordBatch:
    row, place, low, high, _, context = (np.concatenate(x) for x in zip(*waiting, strict=True))
    # Bytes outside the windows of an anchor do not count; zero them so that equal needs are equal rows.
    column = np.arange(before + length)
    context[(column < before - high[:, None]) | (column >= before + length - low[:, None])] = 0
    words = np.concatenate([big_endian(context[:, before:]), big_endian(context[:, :before]), (low << 8 | high).astype(U64)[:, None]], axis=1)
    order = np.lexsort((ids[row], *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)]))
    words, doc = words[order], ids[row][order]
    new = np.ones(len(row), bool)
    new[1:] = (words[1:] != words[:-1]).any(1)
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = order[doc > least]  # a smaller document of the batch has the same bytes: all windows go
    every = (np.int64(2) << (high - low)) - 1
    buckets = len(splits) + 1
    out = [*_cuts(row[later], place[later], low[later], high[later], every[later], ids, marks, buckets)]
    send = order[doc == least]
    suffix = np.ascontiguousarray(context[send, before:])
    bucket = np.searchsorted(splits, np.ascontiguousarray(suffix[:, :gram]).view(f"S{gram}").ravel(), "right")
    for part in np.split(np.arange(len(send)), np.flatnonzero(np.diff(bucket)) + 1):
        if not len(part):
            continue
        block, own = suffix[part], send[part]
        lcp = np.zeros(len(part), np.uint8)
        if len(part) > 1:
            differ = block[1:] != block[:-1]
            lcp[1:] = np.where(differ.any(1), differ.argmax(1), length)
        rest = block[np.arange(length) >= lcp[:, None]]
        out.append(
            {
                "bucket": int(bucket[part[0]]),
                "lcp": lcp.tobytes(),
                "rest": rest.tobytes(),
                "left": np.ascontiguousarray(context[own, :before]).tobytes(),
                "doc": ids[row[own]].tobytes(),
                "mark": marks[row[own]].tobytes(),
                "pos": place[own].tobytes(),
                "low": low[own].astype(np.uint8).tobytes(),
                "high": high[own].astype(np.uint8).tobytes(),
            }
        )
    return pa.RecordBatch.from_pylist(out, _RUN)


def _cuts(row, place, low, high, mask, ids, marks, buckets) -> Iterator[dict]:
    """One row (doc_id, mark, cut) per document: for each anchor the first window's position and the mask of windows from there."""
    order = np.argsort(row, kind="stable")
    packed = np.stack([place - high, mask], axis=1)[order]
    row = row[order]
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
        if len(part):
            k = row[part[0]]
            yield {"bucket": int(marks[k] % buckets), "doc_id": int(ids[k]), "row_mark": int(marks[k]), "cut": packed[part].astype(np.int64).tobytes()}


def front_decode(lcp: np.ndarray, rest: bytes, length: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for common in lcp.tolist():
        end = at + length - common
        last = last[:common] + rest[at:end]
        out.append(last)
        at = end
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]], length: int) -> tuple[list[int], list[int]]:
    """Merged order of sorted runs (strings, common prefixes with the string before): run of each output, and its
    common prefix with the output before it.

    A loser tree: every node keeps the run that lost there, and every run the length of the prefix that its head shares with
    the last output. Of two heads the one that shares more comes first; bytes are compared only behind equal
    shared lengths, so a known prefix is never read again.
    """
    k = len(runs)
    size = 1 << max(0, k - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (size - k)
    commons = [r[1] for r in runs] + [[]] * (size - k)
    ends = [len(s) for s in strings]
    at, shared = [0] * size, [0] * size
    done = -1  # shared length of an exhausted run: after all others

    def first(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        ha, hb = shared[a], shared[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha == done:
            return a, b
        x, y = strings[a][at[a]], strings[b][at[b]]
        if x == y:
            if b < a:
                a, b = b, a
            shared[b] = length
            return a, b
        left, right = int.from_bytes(x[ha:], "big"), int.from_bytes(y[ha:], "big")
        common = length - ((left ^ right).bit_length() + 7) // 8
        if left < right:
            shared[b] = common
            return a, b
        shared[a] = common
        return b, a

    for s in range(size):
        shared[s] = 0 if ends[s] else done
    losers = [0] * size
    level = list(range(size))
    base = size // 2
    while len(level) > 1:
        nxt = []
        for j in range(0, len(level), 2):
            win, lose = first(level[j], level[j + 1])
            losers[base + j // 2] = lose
            nxt.append(win)
        level = nxt
        base //= 2
    win = level[0]
    order, lcps = [], []
    while shared[win] != done:
        order.append(win)
        lcps.append(shared[win])
        at[win] += 1
        shared[win] = commons[win][at[win]] if at[win] < ends[win] else done
        node = (win + size) // 2
        while node:
            win, losers[node] = first(win, losers[node])
            node //= 2
    return order, lcps


def meet_suffixes(length: int, gram: int, parts: int):
    """A function for applyInArrow on a bucket: RUN rows to PACKED cuts."""
    before = length - gram

    def run(table: pa.Table) -> pa.Table:
        told = [told_before(table.filter(pc.is_valid(table.column("cut"))).select(["doc_id", "row_mark", "cut"]))]
        rows = table.filter(pc.is_null(table.column("cut"))).to_pylist()
        if not rows:
            return packed(told, parts)
        runs = []
        for r in rows:
            lcp = np.frombuffer(r["lcp"], np.uint8)
            runs.append((front_decode(lcp, r["rest"], length), lcp.tolist()))
        order, lcps = merge_runs(runs, length)
        del runs
        order, lcp = np.array(order, np.int64), np.array(lcps, np.int64)
        sizes = [len(r["low"]) for r in rows]
        starts = np.cumsum([0, *sizes[:-1]])
        turn = np.empty(len(order), np.int64)  # a run's records come out in their order
        for s in range(len(rows)):
            turn[order == s] = starts[s] + np.arange(sizes[s])

        def field(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in rows), kind)[turn]

        doc, mark, pos = field("doc", np.int64), field("mark", np.int64), field("pos", np.int64)
        low, high = field("low", np.uint8).astype(np.int64), field("high", np.uint8).astype(np.int64)
        left = np.frombuffer(b"".join(r["left"] for r in rows), np.uint8).reshape(-1, before)[turn]
        mask = removed_windows(doc, low, high, lcp, left, length)
        hit = np.flatnonzero(mask)
        told.append(told_here(doc[hit], mark[hit], np.stack([pos[hit] - high[hit], mask[hit]], axis=1)))
        return packed(told, parts)

    return run


def removed_windows(doc, low, high, lcp, left, length: int) -> np.ndarray:
    """Bit ``high - offset`` of a record is set if its window at that offset occurs in a smaller document.

    lcp: common prefixes of the suffixes in their order; left: the bytes before the anchors, which are put in order backwards here.
    """
    mask = np.zeros(len(doc), np.int64)
    backwards = np.ascontiguousarray(left[:, ::-1])
    words = big_endian(backwards)
    order_back = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)]) if words.shape[1] else np.arange(len(doc))
    backwards = backwards[order_back]
    common = np.zeros(len(doc), np.int64)
    differ = backwards[1:] != backwards[:-1]
    if left.shape[1]:
        common[1:] = np.where(differ.any(1), differ.argmax(1), left.shape[1])
    behind = np.zeros(len(doc), np.int64)
    for offset in range(left.shape[1] + 1):
        use = np.flatnonzero((low <= offset) & (offset <= high))
        if len(use) < 2:
            continue
        ahead = np.cumsum(lcp < length - offset)
        behind[order_back] = np.cumsum(common < offset)
        key = ahead[use] * (len(doc) + 1) + behind[use]
        order = np.argsort(key)
        key, owner = key[order], doc[use[order]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
        late = use[order[owner > least]]
        mask[late] |= np.int64(1) << (high[late] - offset)
    return mask


def cover(n: int, whole: bool, cuts: bytes | None, length: int) -> np.ndarray:
    """Which of a text's n bytes go."""
    if whole:
        return np.full(n, n >= length)
    if not cuts:
        return np.zeros(n, bool)
    rows = np.frombuffer(cuts, np.int64).reshape(-1, 2)
    bits = np.arange(64)
    starts = (rows[:, :1] + bits)[(rows[:, 1:] >> bits) & 1 == 1]
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


class SuffixDedup:
    """The jobs of one run; every job is written, so lost executors cost no more than one."""

    def __init__(self, documents: DataFrame, length: int, gram: int = GRAM):
        if not 8 <= gram <= length <= gram + 60:
            raise ValueError("length must be from gram to gram + 60 bytes")
        self.documents, self.length, self.gram = documents, length, gram
        self.scratch = Scratch(documents.sparkSession, "suffix")
        self.mark = F.xxhash64("text")

    def verdicts(self) -> DataFrame:
        """(doc_id, mark, whole, cuts) of the texts that lose something."""
        save = self.scratch.save
        texts = self.documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", self.mark.alias("mark"), "text")
        texts = texts.where(F.octet_length("text") >= self.length)
        keys = texts.select("doc_id", "mark", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"))
        keys = save(keys.distinct(), "keys")
        total = keys.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
        buckets = max(16, -(-total // BUCKET_BYTES))
        parts = max(16, -(-buckets // PART_BUCKETS))
        least = keys.groupBy("sha", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        least = least.select("sha", "n", "least", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        salted = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        copies = save(salted.join(least, ["sha", "n", "salt"]).where("doc_id > least").select("doc_id", "mark"), "copies")
        self.scratch.drop("keys")

        single = texts.join(copies.hint("merge"), ["doc_id", "mark"], "left_anti")
        rate = SAMPLE / max(1, total / 16)  # there is about one anchor to 16 bytes
        sent = single.mapInArrow(tidy(name_grams(self.length, self.gram, buckets, rate)), NAMED)
        named = save(sent.groupBy("bucket").applyInArrow(tidy_group(meet_grams(parts)), PACKED), "named")
        drawn = b"".join(bytes(r[0]) for r in named.where("part < 0").select("words").collect())  # about SAMPLE grams
        grams = np.sort(np.frombuffer(drawn, f"S{self.gram}"))
        splits = np.unique(grams[np.linspace(0, len(grams) - 1, buckets + 1).astype(int)[1:-1]]) if len(grams) else grams
        per_doc = named.where("part >= 0").groupBy("part").applyInArrow(tidy_group(unpack), "doc_id long, mark long, words binary")
        per_doc = per_doc.select("doc_id", "mark", F.col("words").alias("named"))
        joined = texts.join(per_doc.hint("merge"), ["doc_id", "mark"]).select("doc_id", "mark", "named", "text")
        runs = joined.mapInArrow(tidy(suffix_runs(self.length, self.gram, splits)), RUN)
        cuts = save(runs.groupBy("bucket").applyInArrow(tidy_group(meet_suffixes(self.length, self.gram, parts)), PACKED), "cuts")
        self.scratch.drop("named")
        cut = cuts.groupBy("part").applyInArrow(tidy_group(unpack), "doc_id long, mark long, words binary")
        cut = cut.select("doc_id", "mark", F.col("words").alias("cuts"), F.lit(False).alias("whole"))
        both = cut.unionByName(copies.select("doc_id", "mark", F.lit(None).cast("binary").alias("cuts"), F.lit(True).alias("whole")))
        out = save(both, "verdicts")
        self.scratch.drop("copies", "cuts")
        return out

    def _joined(self, columns: list[str]) -> DataFrame:
        verdicts = self.verdicts()
        names = {"doc_id": "girder_doc", "mark": "girder_mark", "cuts": "girder_cuts", "whole": "girder_whole"}
        marked = self.documents.select(*columns).withColumn("girder_text_mark", self.mark)
        right = verdicts.withColumnsRenamed(names)
        on = (marked["doc_id"] == right["girder_doc"]) & (marked["girder_text_mark"] == right["girder_mark"])
        return marked.join(right.hint("merge"), on, "left").drop("girder_doc", "girder_mark", "girder_text_mark")

    def report(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_bytes, n_removed, n_spans, digests = [], [], [], []
                for data, gone in _gone(batch, length):
                    edges = np.diff(gone.astype(np.int8), prepend=0)
                    n_bytes.append(len(data))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int((edges == 1).sum()))
                    digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return self._joined(["doc_id", "text"]).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def cleaned(self) -> DataFrame:
        """The documents with repeated bytes cut from text; of a character that a cut splits, the remaining bytes go too.

        Null text stays null.
        """
        length = self.length
        names = [f.name for f in self.documents.schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [data[~gone].tobytes().decode("utf-8", "ignore") for data, gone in _gone(batch, length)]
                valid = batch.column("text").is_valid().to_pylist()
                made = pa.array([t if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([made if n == "text" else batch.column(n) for n in names], names=names)

        return self._joined(names).mapInArrow(tidy(run), T.StructType(self.documents.schema.fields))


def _gone(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for k, (cuts, whole) in enumerate(zip(batch.column("girder_cuts").to_pylist(), batch.column("girder_whole").to_pylist(), strict=True)):
        own = data[offsets[k] : offsets[k + 1]]
        yield own, cover(len(own), bool(whole), cuts, length)


def removed_report(documents: DataFrame, length: int = 50) -> DataFrame:
    return SuffixDedup(documents, length).report()


def remove_repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    return SuffixDedup(documents, length).cleaned()
