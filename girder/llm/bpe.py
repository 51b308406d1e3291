"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is cut at special tokens and then into words by the byte-level word pattern. Each distinct word is first
tokenised by greedy longest match. That guess is the BPE result exactly if every token is what its own bytes merge to and
every two adjacent tokens are compatible, that is, if merging the pair's bytes gives the pair again.

All adjacent pairs of a batch's new words are tested at once, without merging anything: the last merges that made the two
tokens are undone in falling order of rank, which walks down the right edge of the left token's merge tree and the left
edge of the right one's. If at any time the two tokens at the border have a merge that would have come before the one
just undone, the pair is not compatible. Only the words that fail are merged exactly, with a heap in O(n log n).

Bounds: a task keeps about CACHE_WORDS encoded words, starts afresh beyond that, and keeps none when it ends;
the vocabulary file is read once per worker. A path without a folder names a public vocabulary and is resolved in the worker.

Defined cases: null text is encoded as empty text (0 tokens); special tokens in a text become their ids, as in
the library; repeated rows encode alike; an empty table gives an empty result; other columns are kept by
``encode``, ``decode`` and ``roundtrip``, which replace columns of the names that they make, and ignored by ``digests``.
Ids that the vocabulary lacks raise KeyError in ``decode``.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from girder.llm.textkernel import BLOCK, release

CACHE_WORDS = 400_000
HEAD = 4  # bytes by which a longest match is bounded
SHORT = 64
NEVER = 1 << 40
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# The white space of Unicode and the public byte-level word pattern.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = {bytes(letters[c] for c in token): number for token, number in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = vocabulary
        self.bytes = {number: token for token, number in vocabulary.items()} | {n: s.encode() for s, n in self.special.items()}
        self.merges: dict[tuple[int, int], int] = {}  # rank of a pair
        self.made: list[int] = []  # what the pair of a rank becomes
        self.reach: dict[bytes, int] = {}  # longest token by its first HEAD bytes
        for token in vocabulary:
            if len(token) >= HEAD:
                self.reach[token[:HEAD]] = max(len(token), self.reach.get(token[:HEAD], 0))
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.setdefault((vocabulary[left], vocabulary[right]), rank)
            self.made.append(vocabulary[left + right])
        self.text = {number: str(number) for number in self.bytes}
        self.word = regex.compile(WORD)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self._trees(max(self.bytes) + 1)

    def _trees(self, size: int) -> None:
        """Merge trees of the tokens as arrays: rank of the last merge (-1 of a byte), and what it joined."""
        pairs = np.array([[a, b, r, self.made[r]] for (a, b), r in self.merges.items()], np.int64).reshape(-1, 4)
        order = np.argsort(pairs[:, 0] << 32 | pairs[:, 1])
        self.pair_keys, self.pair_ranks = (pairs[:, 0] << 32 | pairs[:, 1])[order], pairs[order, 2]
        self.rank, self.left, self.right = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for a, b, r, token in pairs[np.argsort(-pairs[:, 2])]:  # of several merges to one token the first counts
            self.rank[token], self.left[token], self.right[token] = r, a, b
        whole = np.flatnonzero(self.rank >= 0)
        self.sound = np.zeros(size, bool)  # tokens that their own bytes merge to
        self.sound[[self.ids[bytes([k])] for k in range(256) if bytes([k]) in self.ids]] = True
        fits = self.compatible(self.left[whole], self.right[whole], self.rank[whole])
        for _ in range(64):
            now = fits & self.sound[self.left[whole]] & self.sound[self.right[whole]]
            if (self.sound[whole] == now).all():
                break
            self.sound[whole] = now

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the bytes of each two sound tokens merge to just these two, by merges of ranks below ``limit``."""
        good, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NEVER) if limit is None else limit
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            early = (self.pair_keys[place] == key) & (self.pair_ranks[place] < limit) if len(self.pair_keys) else np.zeros(len(at), bool)
            good[at[early]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~early & ((rank_a >= 0) | (rank_b >= 0))
            at, a, b, rank_a, rank_b = at[on], a[on], b[on], rank_a[on], rank_b[on]
            turn = rank_a > rank_b  # of equal merges the left one came first, so the right one is undone first
            limit = np.where(turn, rank_a, rank_b + 1)
            a, b = np.where(turn, self.right[a], a), np.where(turn, b, self.left[b])
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the pair of least rank, the leftmost first."""
        ids = [self.ids[word[k : k + 1]] for k in range(len(word))]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, made = self.merges.get, self.made
        ranks = [rank(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            k = ranks.index(least)
            new = made[least]
            ids[k : k + 2] = [new]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], new), NEVER)
            if k < len(ranks):
                ranks[k] = rank((new, ids[k + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := self.merges.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, k, a, b = heapq.heappop(heap)
            m = after[k]
            if not alive[k] or m >= n or ids[k] != a or ids[m] != b:
                continue
            ids[k], alive[m] = self.made[r], False
            after[k] = after[m]
            if after[m] < n:
                before[after[m]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := self.merges.get((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[after[left]]))
        return [ids[k] for k in range(n) if alive[k]]

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        find, reach = self.ids.get, self.reach.get
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + reach(word[at : at + HEAD], HEAD - 1))
            while (found := find(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def learn(self, words: Sequence[str]) -> None:
        """Encode distinct new words into the cache."""
        raw = [w.encode() for w in words]
        guesses = [self.guess(w) for w in raw]
        sizes = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        fine = self.sound[flat]
        inner = np.ones(len(flat), bool)  # each token goes with the next one; a word's last token has none
        inner[ends - 1] = False
        first = np.flatnonzero(inner)
        fine[first] &= self.compatible(flat[first], flat[first + 1])
        right = np.logical_and.reduceat(fine, ends - sizes)
        for k, word in enumerate(words):
            self.cache[word] = tuple(guesses[k] if right[k] else self.merge(raw[k]))

    def _words(self, text: str) -> list:
        """Words of a text; special tokens come as their ids."""
        if self.split is None or not any(s in text for s in self.special):
            return self.word.findall(text)
        out: list = []
        for part in self.split.split(text):
            out.extend([self.special[part]] if part in self.special else self.word.findall(part))
        return out

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cut = [self._words(text) for text in texts]
        new = set().union(*cut).difference(self.cache)
        for number in [w for w in new if isinstance(w, int)]:
            self.cache[number] = (number,)
            new.discard(number)
        if new:
            self.learn(list(new))
        find = self.cache.__getitem__
        return [list(chain.from_iterable(map(find, words))) for words in cut]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Bpe(path)


@contextmanager
def task(path: str) -> Iterator[Bpe]:
    """The worker's encoder, which forgets its words when the task ends: workers outlive tasks and serve other stages."""
    bpe = load(path)
    try:
        yield bpe
    finally:
        bpe.cache = {}
        gc.collect()
        release()


def _pieces(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``most`` characters."""
    run: list[str] = []
    first = size = 0
    for k, text in enumerate(texts):
        value = text.as_py() or ""
        if run and size + len(value) > most:
            yield first, run
            run, first, size = [], k, 0
        run.append(value)
        size += len(value)
    if run:
        yield first, run


def _made(batch: pa.RecordBatch, first: int, rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``rows`` rows of a batch, with new columns behind the others; those of the same names go."""
    kept = [n for n in batch.schema.names if n not in columns]
    part = batch.slice(first, rows)
    return pa.RecordBatch.from_arrays([*[part.column(n) for n in kept], *columns.values()], names=[*kept, *columns])


def _schema(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name not in columns], *[T.StructField(n, kind) for n, kind in columns.items()]])


_IDS = T.ArrayType(T.IntegerType())


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``documents`` with the column ``ids`` (array of int) of the text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(path) as bpe:
            for batch in batches:
                for first, texts in _pieces(batch.column(text)):
                    yield _made(batch, first, len(texts), {ids: pa.array(bpe.encode(texts), pa.list_(pa.int32()))})

    return documents.mapInArrow(run, _schema(documents, **{ids: _IDS}))


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``text`` made from the ids; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(path) as bpe:
            for batch in batches:
                made = [bpe.decode(x.as_py() or ()) for x in batch.column(ids)]
                yield _made(batch, 0, batch.num_rows, {text: pa.array(made, pa.string())})

    return encoded.mapInArrow(run, _schema(encoded, **{text: T.StringType()}))


def roundtrip(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with token_ids, the text decoded from them, and n_tokens; one worker does both ways in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(path) as bpe:
            for batch in batches:
                for first, texts in _pieces(batch.column("text")):
                    made = bpe.encode(texts)
                    columns = {"token_ids": pa.array(made, pa.list_(pa.int32())), "text": pa.array([bpe.decode(x) for x in made], pa.string()), "n_tokens": pa.array([len(x) for x in made], pa.int64())}
                    yield _made(batch, first, len(texts), columns)

    return documents.mapInArrow(run, _schema(documents, token_ids=_IDS, text=T.StringType(), n_tokens=T.LongType()))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Token count and SHA-256 of the ids and of the text decoded from them, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(path) as bpe:
            spell = bpe.text.__getitem__
            for batch in batches:
                for first, texts in _pieces(batch.column("text")):
                    made = bpe.encode(texts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(first, len(texts)),
                            pa.array([len(ids) for ids in made], pa.int64()),
                            pa.array([hashlib.sha256(",".join(map(spell, ids)).encode()).hexdigest() for ids in made]),
                            pa.array([hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in made]),
                        ],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    return documents.select("doc_id", "text").mapInArrow(run, DIGESTS)
