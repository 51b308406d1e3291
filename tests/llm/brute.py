"""Plain reference results that the operators are tested against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def components(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component) by comparing all documents that share a shingle."""
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where: dict[tuple[str, ...], list[int]] = {}
    for k, (d, s) in enumerate(sets):
        met: dict[int, int] = {}
        for x in s:
            for j in where.get(x, ()):
                met[j] = met.get(j, 0) + 1
            where.setdefault(x, []).append(k)
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((find(d), find(sets[j][0])))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets}


def removed(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id -> (bytes, removed bytes, removed runs, kept bytes) from a table of the least document of every window."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    least: dict[bytes, int] = {}
    for d, t in texts:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if least.get(w, d) >= d:
                least[w] = d
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out[d] = (len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out
