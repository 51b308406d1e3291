"""N-gram Jaccard self-join by grouped prefixes: link components, and the number of links of every document.

A document is the set of its distinct word shingles. Two documents link if the Jaccard similarity of their sets
reaches ``percent``. Shingles are ordered from rare to frequent; linked sets share one of the first
``n - ceil(percent * n / 100) + 1`` of them.

1. A fixed-size count sketch of all shingles of all documents gives the order: (log count of the bucket,
   hash). Any order is correct; this one keeps common passages out of the prefixes.
2. Documents with equal sets become one node, and nodes with identical prefixes and size become one group, named
   by its least doc_id. Only groups are indexed: one entry for each prefix shingle.
3. Entries of a shingle form a list of groups with their sizes and the shingle's places in their orders; equal
   lists count once. A pair counts only if what follows its places can still make the overlap that its sizes ask for.
   Each list is first paired as a star around its least group, and each group as a star around its least member; these
   pairs are verified exactly on the full sets, and components are drawn from those that link.
4. What is left are pairs of a list that lie in different components. The nodes of a list fall into classes by size and by the
   share of the set that follows the place; the bounds of two classes tell whether any of their nodes can link, so a list
   whose nodes cannot is never paired, however long it is. Nodes of classes that can are expanded to members and verified: pair by
   pair in lists of up to SMALL nodes, and part against part in longer ones, as in step 5. Sets are written in buckets of their
   document, so that no join moves them again.
5. Every link lies inside a component. The sets of a component are dealt to parts of about PART nodes, and any two parts
   meet once: all their pairs are counted exactly, by products of their shingle tables. So every pair of different
   sets is judged, however many near copies there are, and a set travels once for each part of its component, not
   once for each pair. A meeting returns one number of links for each set, or the links (:func:`jaccard_links`).

A task holds one block of a list or one meeting of two parts. The sketch has SKETCH counters whatever
the input; what the driver holds is one byte for each.

Defined cases: texts without words and null texts have an empty set, link with nothing and are their own
component; a text of fewer than ``width`` words is one shingle; rows that repeat a doc_id get the least
component of their texts; a null doc_id links with nothing and has a null component, and no links; an empty table gives an
empty result; other columns are ignored. Of the links of a document, every other row with a linked or equal set counts once.
Shingles are compared as 64-bit hashes, sets of documents as 128-bit sums of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.components import connected_components
from girder.llm.textkernel import U64, mix, shingle_sets, tidy
from girder.scratch import Scratch, short_shuffles

SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
SLICE = 1 << 14
BLOCK = 2048
SMALL = 128
SALTS = 8
PART = 512
PART_BYTES = 1 << 24
COLUMNS = 1 << 12
NODES = "doc_id long, n_shingles long, h1 long, h2 long, g long, prefix array<bigint>"
SETS = "doc_id long, h1 long, h2 long, shingles binary"
LINKS = "a1 long, a2 long, b1 long, b2 long"
COUNTS = "h1 long, h2 long, n_links long"
_I64 = pa.int64()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - SKETCH_BITS)).astype(np.int64)


def count_shingles(width: int):
    """A function for mapInArrow: (text) to (slice, counts) of the task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, found in shingle_sets(batch.column("text"), width):
                waiting.append(found)
                size += len(found)
                if size > SKETCH:
                    total += np.bincount(_bucket(np.concatenate(waiting)), minlength=SKETCH)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(_bucket(np.concatenate(waiting)), minlength=SKETCH)
        for k in range(0, SKETCH, SLICE):
            part = total[k : k + SLICE]
            if part.any():
                kind = next(c for c in (np.uint8, np.uint16, np.uint32, np.int64) if part.max() <= np.iinfo(c).max)
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["slice", "counts"])

    return run


def add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, counts) to the sum of each slice, as rounded log counts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            data = counts.as_buffer()
            part = np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data.size // SLICE]).astype(np.int64)
            total[number] = total[number] + part if number in total else part
    levels = [np.round(4 * np.log2(np.maximum(1, part))).astype(np.uint8).tobytes() for part in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["slice", "levels"])


def frequency_levels(documents: DataFrame, width: int) -> np.ndarray:
    """Rounded log count of each sketch bucket, over all documents."""
    counted = documents.select("text").mapInArrow(tidy(count_shingles(width)), "slice int, counts binary")
    summed = counted.repartition("slice").mapInArrow(add_sketches, "slice int, levels binary")
    out = np.zeros(SKETCH, np.uint8)
    with short_shuffles(documents.sparkSession):
        rows = summed.collect()
    for number, levels in rows:
        out[number * SLICE : (number + 1) * SLICE] = np.frombuffer(levels, np.uint8)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_hashes(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(signed(mix(found).sum(keepdims=True))[0]), int(signed(mix(found ^ U64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True))[0])


def prefixes(width: int, percent: int, levels: np.ndarray):
    """A function for mapInArrow: (doc_id, text) to NODES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            numbers = np.zeros((4, rows), np.int64)
            parts: list[np.ndarray] = []
            ends = np.zeros(rows + 1, np.int64)
            for row, found in shingle_sets(batch.column("text"), width):
                n = len(found)
                numbers[0, row] = n
                if n:
                    numbers[1:3, row] = set_hashes(found)
                    order = np.argsort(levels[_bucket(found)], kind="stable")
                    first = found[order[: prefix_length(n, percent)]]
                    numbers[3, row] = signed(mix(mix(first).sum(keepdims=True) + U64(n)))[0]
                    parts.append(first)
                    ends[row + 1] = len(first)
            values = signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x) for x in numbers], lists], names=["doc_id", "n_shingles", "h1", "h2", "g", "prefix"])

    return run


def token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, gid, n, place) sorted by token and gid to blocks of the lists that have two groups or more.

    Only the block at hand is held, however long a list is.
    """
    token, block, center, taken = None, 0, None, 0
    ids: list[int] = []
    sizes: list[int] = []
    places: list[int] = []
    out: list[tuple] = []

    def flush() -> None:
        nonlocal ids, sizes, places, block
        if taken > 1 and ids:
            out.append((token, block, *center, ids, sizes, places))
            block += 1
        ids, sizes, places = [], [], []

    def table() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 8
        types = [_I64, pa.int32(), _I64, _I64, _I64, *[pa.list_(_I64)] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["token", "block", "center", "center_n", "center_place", "ids", "sizes", "places"])

    for batch in batches:
        tokens = batch.column("token").to_numpy()
        gid, n, place = (batch.column(c).to_numpy() for c in ("gid", "n", "place"))
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(tokens))
        # Runs of one entry inside the batch are alone; the first and last run may go on in other batches.
        wide = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            if token is None or tokens[a] != token:
                flush()
                token, block, center, taken = int(tokens[a]), 0, (int(gid[a]), int(n[a]), int(place[a])), 0
            while a < b:
                step = min(b - a, BLOCK - len(ids))
                ids.extend(gid[a : a + step].tolist())
                sizes.extend(n[a : a + step].tolist())
                places.extend(place[a : a + step].tolist())
                taken += step
                a += step
                if len(ids) == BLOCK:
                    flush()
        if len(out) > 2000:
            yield table()
            out.clear()
    flush()
    yield table()


def shingle_table(width: int):
    """A function for mapInArrow: (doc_id, text) to SETS; shingles are the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*set_hashes(x), x.tobytes()) for _, x in shingle_sets(batch.column("text"), width)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (_I64, _I64, pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "h1", "h2", "shingles"])

    return run


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verify(percent: int):
    """A function for mapInArrow: (a, b, x, y) to the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = shared(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y."""
    if len(x) == len(y) == 1:
        return np.array([[shared(x[0], y[0])]])
    same = x is y
    values = np.concatenate(x if same else [*x, *y])
    rows = np.repeat(np.arange(len(x) + (0 if same else len(y))), [len(s) for s in (x if same else [*x, *y])])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one set is in no intersection but that of the set with itself
    rows = rows[often]
    column = np.cumsum(new[often]) - 1
    out = np.zeros((len(x), len(y)), np.int64)
    ends = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS)) if len(column) else [0]
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        table = np.zeros((len(x) + (0 if same else len(y)), min(COLUMNS, int(column[b - 1]) + 1 - k * COLUMNS)), np.float32)
        table[rows[a:b], column[a:b] - k * COLUMNS] = 1
        out += (table[: len(x)] @ (table if same else table[len(x) :]).T).astype(np.int64)
    return out


def fitting(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of x link with which of y; of x with itself, where x is y, all but the diagonal."""
    both = overlaps(x, y) if x and y else np.zeros((len(x), len(y)), np.int64)
    sizes = np.array([len(s) for s in x], np.int64)[:, None] + np.array([len(s) for s in y], np.int64)[None, :]
    fits = (100 + percent) * both >= percent * sizes
    if x is y:
        np.fill_diagonal(fits, False)
    return fits


def meetings(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """((p, q), rows of (part, *names, set)) of rows sorted by key, p and q; one meeting of two parts is held at a time."""
    now: tuple[int, int, int] | None = None
    rows: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "p", "q", "part", *names)]
        for key, p, q, *row, shingles in zip(*columns, batch.column("shingles"), strict=True):
            if (key, p, q) != now:
                if now:
                    yield now[1:], rows
                now, rows = (key, p, q), []
            rows.append((*row, np.frombuffer(shingles.as_buffer(), U64)))
    if now:
        yield now[1:], rows


def part_links(percent: int, listed: bool):
    """A function for mapInArrow: (key, p, q, part, h1, h2, copies, shingles) sorted by key, p and q to LINKS or COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, q), rows in meetings(batches, ("h1", "h2", "copies")):
            found = {row[1:3]: row for row in rows}  # rows with equal sets are one class
            sides = [[row for row in found.values() if row[0] == side] for side in (p, q)]
            x = [row[-1] for row in sides[0]]
            y = x if p == q else [row[-1] for row in sides[1]]
            fits = fitting(x, y, percent)
            left, right = (np.array([row[1:4] for row in side], np.int64).reshape(-1, 3) for side in sides)
            if listed:
                a, b = np.nonzero(np.triu(fits) if p == q else fits)
                turn = (left[a, 0] > right[b, 0])[:, None]
                low, high = np.where(turn, right[b], left[a]), np.where(turn, left[a], right[b])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (low[:, 0], low[:, 1], high[:, 0], high[:, 1])], names=["a1", "a2", "b1", "b2"])
                continue
            made = [(left, fits @ right[:, 2]), *([] if p == q else [(right, fits.T @ left[:, 2])])]
            for nodes, n in made:
                nodes, n = nodes[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), pa.array(n, _I64)], names=["h1", "h2", "n_links"])

    return run


def part_bridges(percent: int):
    """A function for mapInArrow: (key, p, q, part, node, component, shingles) sorted by key, p and q to links (a, b).

    Of the links of a meeting as many come out as it takes to join the components that they join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, q), rows in meetings(batches, ("node", "component")):
            sides = [[row for row in rows if row[0] == side] for side in (p, q)]
            x = [row[-1] for row in sides[0]]
            y = x if p == q else [row[-1] for row in sides[1]]
            own = [np.array([row[2] for row in side], np.int64) for side in sides]
            a, b = np.nonzero(fitting(x, y, percent) & (own[0][:, None] != own[1][None, :]))
            _, first = np.unique(np.stack([own[0][a], own[1][b]]), axis=1, return_index=True)
            root: dict[int, int] = {}

            def find(c: int, root: dict[int, int] = root) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            out: list[tuple[int, int]] = []
            for k in first.tolist():
                u, v = find(int(own[0][a[k]])), find(int(own[1][b[k]]))
                if u != v:
                    root[u] = v
                    out.append((sides[0][a[k]][1], sides[1][b[k]][1]))
            yield pa.RecordBatch.from_arrays([pa.array([min(o) for o in out], _I64), pa.array([max(o) for o in out], _I64)], names=["a", "b"])

    return run


class JaccardJoin:
    """The steps of one self-join; :func:`jaccard_components` and :func:`jaccard_links` run them."""

    def __init__(self, documents: DataFrame, width: int, percent: int):
        self.documents = documents.select("doc_id", "text")
        self.width, self.percent = width, percent
        self.scratch = Scratch(documents.sparkSession, "jaccard")

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, h1, h2, copies, component_id) of every document; what :meth:`links` needs stays until :meth:`close`."""
        save, drop = self.scratch.save, self.scratch.drop
        levels = frequency_levels(self.documents, self.width)
        made = self.documents.mapInArrow(tidy(prefixes(self.width, self.percent, levels)), NODES)
        whole = save(made, "prefixes")
        docs = save(whole.drop("prefix", "g"), "documents")
        real = whole.where("n_shingles > 0 AND doc_id IS NOT NULL")
        nodes = real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min("g").alias("g"), F.count("*").alias("copies"))
        self.nodes = nodes = save(nodes, "nodes")
        groups = nodes.groupBy("g", "n_shingles").agg(F.min("node").alias("gid"))
        members = save(nodes.join(groups, ["g", "n_shingles"]).select("gid", "node", F.col("n_shingles").alias("n")), "members")

        entries = real.join(groups.select(F.col("gid").alias("doc_id"), "g", "n_shingles"), ["doc_id", "g", "n_shingles"], "left_semi")
        entries = entries.select(F.posexplode("prefix").alias("place", "token"), F.col("doc_id").alias("gid"), F.col("n_shingles").alias("n"))
        entries = entries.select("token", "gid", "n", F.col("place").cast("long").alias("place"))
        lists = entries.repartition("token").sortWithinPartitions("token", "gid").mapInArrow(
            token_lists, "token long, block int, center long, center_n long, center_place long, ids array<bigint>, sizes array<bigint>, places array<bigint>"
        )
        # Equal one-block lists count once, with the places of their first shingle: all groups share the order of shingles, so
        # their arrays of places are ordered alike. A list of several blocks keeps its token, so that its blocks find each other.
        alone = F.when((F.col("block") == 0) & (F.size("ids") < BLOCK), F.xxhash64("ids")).otherwise(F.col("token"))
        lists = lists.withColumn("key", alone).groupBy("key", "block", "center", "center_n", "ids", "sizes").agg(F.min(F.struct("places", "center_place")).alias("p"))
        lists = lists.select("key", "block", "center", "center_n", "p.center_place", "ids", "sizes", "p.places")
        lists = save(lists, "lists")
        drop("prefixes")

        star = lists.select("center", "center_n", "center_place", F.explode(F.arrays_zip("ids", "sizes", "places")).alias("e"))
        star = star.where((F.col("center") != F.col("e.ids")) & self._can_link(F.col("center_n"), F.col("center_n") - F.col("center_place"), F.col("e.sizes"), F.col("e.sizes") - F.col("e.places")))
        star = star.select(F.least("center", "e.ids").alias("a"), F.greatest("center", "e.ids").alias("b"))
        inside = members.where("gid != node").select(F.col("gid").alias("a"), F.col("node").alias("b"))
        first = save(star.unionByName(inside).distinct(), "pairs-1")

        wanted = lists.select(F.explode("ids").alias("gid")).distinct().join(members, "gid").select("node").unionByName(first.select(F.col("b").alias("node"))).distinct()
        sets = self.documents.join(wanted.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
        size = 8 * (nodes.agg(F.sum("n_shingles")).first()[0] or 0)
        self.sets = sets = self.scratch.save_bucketed(sets.mapInArrow(tidy(shingle_table(self.width)), SETS), "sets", "doc_id", size)

        links = save(self._verified(first, sets), "links-1")
        found = save(connected_components(links, self.scratch, "components-1"), "first")
        more = self._open_links(lists, members, found, first, sets)
        self.labels = found if more.isEmpty() else save(connected_components(links.unionByName(more), self.scratch, "components-2"), "second")
        drop("members", "lists", "pairs-1", "links-1", "links-2", "bridges")
        named = nodes.join(self.labels, "node", "left").select("h1", "h2", "n_shingles", "copies", F.coalesce("component", "node").alias("component"))
        out = docs.join(named, ["h1", "h2", "n_shingles"], "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
        out = save(out.select("doc_id", "n_shingles", "h1", "h2", F.when(F.col("doc_id").isNotNull(), F.col("copies")).alias("copies"), own), "result")
        drop("documents")
        return out

    def close(self) -> None:
        """Delete all tables but the result."""
        self.scratch.drop("nodes", "sets", "placed-sets", "first", "second")

    def _can_link(self, na: Column, ra: Column, nb: Column, rb: Column) -> Column:
        """Whether sets of sizes na and nb with ra and rb shingles from their first common one on can have the overlap to link."""
        return (100 + self.percent) * F.least(ra, rb) >= self.percent * (na + nb)

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).hint("merge")
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")).hint("merge")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(verify(self.percent)), "a long, b long")

    def _open_links(self, lists: DataFrame, members: DataFrame, found: DataFrame, first: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) that join the components found so far, wherever two of them have a link."""
        flat = lists.select("key", F.explode(F.arrays_zip("ids", "places")).alias("e")).select("key", F.col("e.ids").alias("gid"), F.col("e.places").alias("place"))
        groups = members.where("gid != node").select(F.xxhash64(F.lit("group"), "gid").alias("key"), "gid", F.lit(0).cast("long").alias("place")).distinct()
        placed = members.join(found, "node", "left").select("gid", "node", "n", F.coalesce("component", "node").alias("component"))
        placed = flat.unionByName(groups).join(placed, "gid").select("key", "node", "n", (F.col("n") - F.col("place")).alias("rest"), "component")
        placed = placed.withColumns({"size": F.floor(10 * F.log("n")).cast("int"), "share": F.floor(20 * F.col("rest") / F.col("n")).cast("int")})
        placed = self.scratch.save(placed, "placed")

        kind = ["key", "size", "share"]
        classes = placed.groupBy(*kind).agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
        mixed = classes.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("key")
        classes = self.scratch.save(classes.join(mixed, "key", "left_semi"), "classes")
        other = classes.select("key", *[F.col(c).alias(f"{c}_b") for c in ("n", "rest", "low", "high")])
        apart = (F.col("low") != F.col("low_b")) | (F.col("high") != F.col("high_b")) | (F.col("low") != F.col("high"))
        fits = self._can_link(F.col("n"), F.col("rest"), F.col("n_b"), F.col("rest_b"))
        live = classes.join(other, "key").where(apart & fits).select(*kind, "nodes", "shingles").distinct()
        total = live.groupBy("key").agg(F.sum("nodes").alias("key_nodes"), F.sum("shingles").alias("key_shingles"))
        live = live.join(total, "key").select(*kind, "key_nodes", "key_shingles", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        salted = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        rest = self.scratch.save(salted.join(live, [*kind, "salt"]).select("key", "node", "n", "rest", "component", "key_nodes", "key_shingles"), "open")
        self.scratch.drop("placed", "classes")

        few = rest.where(F.col("key_nodes") <= SMALL)
        a = few.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("component").alias("ca"))
        b = few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("component").alias("cb"))
        pairs = a.join(b, "key").where("a < b AND ca != cb").where(self._can_link(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb"))).select("a", "b").distinct()
        pairs = self.scratch.save(pairs.join(first, ["a", "b"], "left_anti"), "pairs-2")

        parts = F.ceil(F.greatest(F.col("key_nodes") / PART, F.col("key_shingles") * 8 / PART_BYTES))
        many = rest.where(F.col("key_nodes") > SMALL).select("key", "node", "component", parts.alias("parts")).distinct()
        # Sets are the bulk of what is on disk. They lie in buckets of doc_id, so only what is joined with them moves.
        empty = pairs.limit(0)
        found = empty if pairs.isEmpty() else self.scratch.save(self._verified(pairs, sets), "links-2")
        many = self.scratch.save(many, "many")
        if not many.isEmpty():
            placed = sets.select(F.col("doc_id").alias("node"), "shingles").join(many.hint("merge"), "node").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
            bridges = _dealt(placed, "node", "component").mapInArrow(tidy(part_bridges(self.percent)), "a long, b long")
            found = found.unionByName(self.scratch.save(bridges, "bridges"))
        self.scratch.drop("open", "pairs-2", "many")
        return found

    def links(self, listed: bool) -> DataFrame:
        """LINKS of every two different sets that link, or COUNTS: the documents that the sets linked with a set stand for."""
        # The labels leave out the least node of each component. What is small is joined first, then sets by doc_id, which they lie in
        # buckets of; that their hashes are equal too is no key of the join, so they are not moved for it.
        labels = self.labels.select(F.col("node").alias("doc_id"), F.col("component").alias("key")).unionByName(self.labels.select(F.col("component").alias("doc_id"), F.col("component").alias("key")).distinct())
        own = self.sets.select("doc_id", "h1", "h2").join(labels, "doc_id").join(self.nodes.select("h1", "h2", "n_shingles", "copies"), ["h1", "h2"])
        parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("n_shingles") * 8 / PART_BYTES))
        own = own.join(own.groupBy("key").agg(parts.alias("parts")), "key").select("doc_id", "h1", "h2", "key", "parts", "copies", F.pmod("h1", "parts").alias("part"))
        own = self.scratch.save(own, "placed-sets")
        own = own.withColumnsRenamed({"h1": "own1", "h2": "own2"}).hint("merge")
        equal = F.col("h1").bitwiseXOR(F.col("own1")).bitwiseOR(F.col("h2").bitwiseXOR(F.col("own2"))) == 0
        placed = self.sets.join(own, "doc_id").where(equal)
        made = _dealt(placed, "h1", "h2", "copies").mapInArrow(tidy(part_links(self.percent, listed)), LINKS if listed else COUNTS)
        if listed:
            return made.distinct()
        return made.groupBy("h1", "h2").agg(F.sum("n_links").alias("n_links"))


def _dealt(placed: DataFrame, *names: str) -> DataFrame:
    """Rows (key, part, parts, names, shingles) once for every part that theirs meets, sorted by key and meeting (p, q)."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    met = placed.select("key", other, "part", *names, "shingles")
    met = met.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", *names, "shingles")
    return met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def jaccard_components(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document."""
    join = JaccardJoin(documents, width, percent)
    docs = join.components()
    counts = join.scratch.save(join.links(False), "counts")
    join.close()
    n = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce(F.when(F.col("copies").isNotNull(), F.col("n_links")), F.lit(0))
    return docs.join(counts, ["h1", "h2"], "left").select("doc_id", "n_shingles", "component_id", n.alias("n_links"))


def jaccard_links(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(a, b) with a < b, once for every two documents that link; documents with equal sets do."""
    join = JaccardJoin(documents, width, percent)
    docs = join.components().where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "h1", "h2").distinct()
    links = join.scratch.save(join.links(True), "links")
    join.close()
    x = docs.select(F.col("doc_id").alias("x"), F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    y = docs.select(F.col("doc_id").alias("y"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    equal = x.join(y.withColumnsRenamed({"b1": "a1", "b2": "a2"}), ["a1", "a2"]).select("x", "y")
    other = links.join(x, ["a1", "a2"]).join(y, ["b1", "b2"]).select("x", "y")
    pairs = equal.unionByName(other).where("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_representatives(documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents with all their columns, but of each link component only the one with the least doc_id.

    Rows with a null doc_id and documents without words stay.
    """
    # Components follow from the links that join them; the links inside one name no other representative.
    join = JaccardJoin(documents, width, percent)
    gone = join.components().where("doc_id != component_id").select("doc_id").distinct()
    join.close()
    return documents.join(gone.hint("merge"), "doc_id", "left_anti").select(*documents.columns)
