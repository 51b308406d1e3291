"""Benchmark decontamination by size-partitioned MinHash containment search with exact verification.

An item (a test text) is contained in a document if at least ``percent`` of its distinct word shingles occur there.
Items are partitioned by the size of their shingle sets, and every partition has an index of its own. An item's signature
is its k least hashes, with a k that follows from the partition's largest size u: at most ``u - ceil(percent * u / 100)``
shingles of an item can be missing, so with k above that number a document that contains the item must
hit the signature, at any length of the document. The signatures of a partition lie below a bound; a document's signature
for it is the part of its hashes up to that bound, so short and long documents are sketched at one scale. The hits an item needs follow
from its own size; every candidate pair is then verified on the full sets.

The items are the stated query set: they are held by every task in blocks of at most BLOCK_BYTES of text, and
further blocks take further passes, whose results are written; the driver holds one block at a time. Documents never move.

Defined cases: null and wordless items and texts match nothing; items of fewer than ``width`` words are one
shingle and are looked for anywhere in a document; equal items all match; repeated documents match alike; an empty
table gives an empty result; other columns are kept by ``clean`` and ignored by ``search``. Shingles are
compared as 64-bit hashes of A-Z folded words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.textkernel import LOWER, U64, Words, chunks, tidy, windows_hash
from girder.scratch import Scratch

BLOCK_BYTES = 32 << 20
MATCHES = "doc_id long, item_id long, n_item_shingles long, n_shared long"
_SIEVE_BITS = 20


def window_sets(column: pa.Array, widths: list[int]) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
    """(row, {width: sorted distinct hashes of all runs of that many words}) of every row."""
    for row, _, data, offsets in chunks(column):
        words = Words(data, offsets, LOWER)
        made = {w: windows_hash(words.hashes, w) for w in widths}
        for k in range(len(offsets) - 1):
            a, b = int(words.rows[k]), int(words.rows[k + 1])
            yield row + k, {w: np.unique(made[w][a : max(a, b - w + 1)]) for w in widths}


class Partition:
    """Signatures and sets of the items of one block, one shingle width and one range of sizes."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets = ids, sets
        sizes = np.array([len(s) for s in sets], np.int64)
        largest = int(sizes.max())
        k = np.minimum(sizes, largest - -(-percent * largest // 100) + 2)
        self.need = -(-percent * sizes // 100)
        self.least_hits = np.maximum(1, k - (sizes - self.need))
        flat, owner = np.concatenate([s[:n] for s, n in zip(sets, k, strict=True)]), np.repeat(np.arange(len(sets)), k)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.bound = self.keys[-1]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.keys >> U64(64 - _SIEVE_BITS)] = True

    def contained(self, found: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a document's sorted set contains."""
        signature = found[: np.searchsorted(found, self.bound, "right")]
        close = signature[self.sieve[signature >> U64(64 - _SIEVE_BITS)]]
        if not len(close):
            return []
        at = np.searchsorted(self.keys, close)
        at = at[self.keys[at] == close]
        if not len(at):
            return []
        owners = np.concatenate([self.owner[self.first[k] : self.first[k + 1]] for k in at])
        hit, hits = np.unique(owners, return_counts=True)
        out = []
        for k in hit[hits >= self.least_hits[hit]]:
            place = np.minimum(np.searchsorted(found, self.sets[k]), len(found) - 1)
            both = int((found[place] == self.sets[k]).sum())
            if both >= self.need[k]:
                out.append((int(k), both))
        return out


#: Partitions of a block by shingle width.
Block = dict[int, list[Partition]]


def blocks(items: DataFrame, width: int, percent: int) -> Iterator[tuple[Block, bool]]:
    """(block, whether it is the only one); a block's texts have BLOCK_BYTES at most, about, and are read when it is asked for."""
    usable = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, -(-size // BLOCK_BYTES))
    for number in range(many):
        part = usable if many == 1 else usable.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == number)
        rows = part.orderBy("item_id", "text").toArrow()
        ids = rows.column("item_id").to_pylist()
        by: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
        for row, sets in window_sets(rows.column("text"), list(range(1, width + 1))):
            fitting = max((w for w, s in sets.items() if len(s)), default=0)
            if fitting:
                own = by.setdefault((fitting, len(sets[fitting]).bit_length()), ([], []))
                own[0].append(ids[row])
                own[1].append(sets[fitting])
        made: Block = {}
        for (fitting, _), own in sorted(by.items(), key=lambda x: x[0]):
            made.setdefault(fitting, []).append(Partition(*own, percent))
        if made:
            yield made, many == 1


def search_block(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items, sizes, shared = [], [], [], []
            for row, sets in window_sets(batch.column("text"), list(block)):
                for w, partitions in block.items():
                    for own in partitions:
                        for k, both in own.contained(sets[w]):
                            docs.append(row)
                            items.append(own.ids[k])
                            sizes.append(len(own.sets[k]))
                            shared.append(both)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(items, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return run


def clean_block(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, sets in window_sets(batch.column("text"), list(block)):
                keep[row] = not any(own.contained(sets[w]) for w, partitions in block.items() for own in partitions)
            yield batch.filter(pa.array(keep))

    return run


def search(documents: DataFrame, items: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row (doc_id, item_id, n_item_shingles, n_shared) for each document and item that it contains."""
    texts, scratch = documents.select("doc_id", "text"), Scratch(documents.sparkSession, "items")
    found = []
    for number, (block, alone) in enumerate(blocks(items, width, percent)):
        made = texts.mapInArrow(tidy(search_block(block)), MATCHES)
        found.append(made if alone else scratch.save(made, str(number)))
    return reduce(DataFrame.unionByName, found) if found else documents.sparkSession.createDataFrame([], MATCHES)


def clean(documents: DataFrame, items: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    out, scratch = documents, Scratch(documents.sparkSession, "items")
    for number, (block, alone) in enumerate(blocks(items, width, percent)):
        out = out.mapInArrow(tidy(clean_block(block)), documents.schema)
        if not alone:
            out = scratch.save(out, str(number))
            scratch.drop(str(number - 1))
    return out
