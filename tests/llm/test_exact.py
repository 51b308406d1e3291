"""Operators with exact results, against brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import bpe, decontaminate, jaccard_join, queries, suffix_dedup, url_filter, warc
from girder.llm.components import connected_components
from girder.llm.suffix_dedup import merge_runs
from girder.scratch import Scratch
from tests.llm.brute import WORD, components, removed, shingles
from tests.llm.conftest import make_docs, odd_rows, prose


def keyed(rows):
    return [(d, t) for d, t, _ in rows if d is not None]


def test_url_filter(spark):
    urls = [
        "http://www.example.com/en/x", "https://example.com/en/", "https://a.b.example.com/en/?q", "HTTP://EXAMPLE.COM/fr/", "http://x.net/es/1", "http://x.net/es", "http://spam-farm.example.org",
        "http://a.spam-farm.example.org/x#y", "http://notspam-farm.example.org/", "no url", None, "", "://", "http://net/fr/", "x://com/?://net/es/", "http://x.com:80/en/", "http://x.com",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    pages = pages.unionByName(pages.where("page_id = 0"))

    def judge(url):
        rest = (url or "").split("://", 1)
        rest = rest[1] if len(rest) == 2 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        under = lambda name: host == name or host.endswith("." + name)
        fits = [(len(k), k, v) for v, k in queries.RULES if under(k.split("/")[0]) and path.startswith(k[k.index("/") :])]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if any(under(h) for h in queries.LISTED_HOSTS) else "allow"

    found = url_filter.filter_urls(pages, queries.RULES, queries.LISTED_HOSTS).collect()
    assert len(found) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == judge(r.url) for r in found)
    assert url_filter.filter_urls(pages.limit(0), queries.RULES, queries.LISTED_HOSTS).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"site{k}.org/" for k in range(4000)]
    scratch = Scratch(spark, "test")
    universe = url_filter.keys_frame(spark, keys)
    listed = url_filter.keys_frame(spark, keys[::17])
    levels = url_filter.build_cascade(universe, listed, len(keys[::17]), len(keys), scratch, "t")
    assert len(levels) > 1
    found = [r[0] for r in universe.where(url_filter.in_cascade(F.col("key"), levels)).collect()]
    assert sorted(found) == sorted(keys[::17])


def test_cascade_over_split_levels(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LEVEL_BITS", 256)
    keys = [f"site{k}.org/" for k in range(1500)]
    universe = url_filter.keys_frame(spark, keys)
    listed = url_filter.keys_frame(spark, keys[::9])
    levels = url_filter.build_cascade(universe, listed, len(keys[::9]), len(keys), Scratch(spark, "test"), "t")
    assert len(levels[0].parts) > 2
    found = [r[0] for r in universe.where(url_filter.in_cascade(F.col("key"), levels)).collect()]
    assert sorted(found) == sorted(keys[::9])


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    items = [(k, prose(k, 8 + 30 * k)) for k in range(12)] + [(20, prose(5, 30_000)[3000:9000]), (21, "Two\twords"), (22, prose(12, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, kept = (sorted(map(str, f(odd, bench).collect())) for f in (decontaminate.search, decontaminate.clean))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert len(list(decontaminate.blocks(bench, 5, 75))) > 3
    assert sorted(map(str, decontaminate.search(odd, bench).collect())) == whole and len(whole) > 3
    assert sorted(map(str, decontaminate.clean(odd, bench).collect())) == kept


def test_partitions_of_sizes(spark):
    """Every size class has its own signature; none misses an item that a document contains just so."""
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 7, 8, 60, 500):
        sets = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(6)]
        own = decontaminate.Partition(list(range(6)), sets, 75)
        for k, s in enumerate(sets):
            need = -(-75 * len(s) // 100)
            part = np.sort(rng.permutation(s)[:need])
            noise = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
            assert own.contained(np.unique(np.concatenate([part, noise]))) == [(k, need)]
            assert own.contained(np.unique(np.concatenate([part[1:], noise]))) == []


def test_decontamination(spark, odd, none):
    items = [(1, prose(1, 300)[100:260], None), (2, "two words", None), (3, None, None), (4, "", None), (5, prose(99, 20), None), (6, prose(12, 40), None), (6, prose(12, 40), None)]
    bench = spark.createDataFrame([(i, t) for i, t, _ in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontaminate.search(odd, bench).collect()}
    wanted = set()
    for d, text, _ in odd_rows():
        for i, t, _ in items:
            width = min(5, len(WORD.findall(t or "")))
            need = shingles(t, max(1, width))
            if need:
                have = shingles(text, width) if len(WORD.findall(text or "")) >= width else set()
                if 100 * len(need & have) >= 75 * len(need):
                    wanted.add((d, i, len(need), len(need & have)))
    assert found == wanted and wanted
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns
    hit = {d for d, *_ in wanted}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(d for d, _, _ in odd_rows() if d is not None and d not in hit)
    assert decontaminate.search(none, bench).count() == 0 and decontaminate.search(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(odd_rows())


def test_jaccard_components(spark, odd, none):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd).collect()}
    wanted = components(keyed(odd_rows()))
    assert {d: v for d, v in rows.items() if d is not None} == wanted
    assert rows[None][1] is None
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in wanted.items() if c == d} | {None}


@pytest.mark.parametrize("small", [128, 1])
def test_jaccard_random(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "PART", 8)
    rng = random.Random(4)
    rows = []
    for k in range(160):
        words = prose(k % 20, 24).split() if k % 3 else prose(k, rng.randint(1, 30)).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z", "w"])
        rows.append((k, " ".join(words), None))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(make_docs(spark, rows)).collect()}
    links = Counter(x for pair in linked(keyed(rows)) for x in pair)
    assert found == {d: (*v, links[d]) for d, v in components(keyed(rows)).items()}


def test_jaccard_lists_that_cannot_link(spark):
    """Many look-alike texts without a link, and a list whose nodes can link by size but mostly do not."""
    blocks = [" ".join(f"w{b}x{k}" for k in range(9)) for b in range(12)]
    rng = random.Random(6)
    rows = [(k, f"the page you asked for cannot be {k}", None) for k in range(400)]
    rows += [(1000 + k, " ".join(rng.sample(blocks, 5)), None) for k in range(200)]
    found = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_components(make_docs(spark, rows)).collect()}
    links = Counter(x for pair in linked(keyed(rows)) for x in pair)
    assert found == {d: (c, links[d]) for d, (_, c) in components(keyed(rows)).items()}


def linked(docs, percent=75):
    """Every two documents that link, by comparing all with all."""
    sets = [(d, s) for d, t in docs if (s := shingles(t))]
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and 100 * len(x & y) >= percent * len(x | y)}


def test_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    rng = np.random.default_rng(3)
    x, y = ([np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (1, 40, 200, 7, k)] for k in (3, 60))
    for a, b in ((x, y), (x, x), (x[:1], y[:1]), (x, y[:2])):
        assert jaccard_join.overlaps(a, b).tolist() == [[len(set(s.tolist()) & set(t.tolist())) for t in b] for s in a] or a is b
    both = jaccard_join.overlaps(x, x)
    assert all(both[i, j] == len(set(x[i].tolist()) & set(x[j].tolist())) for i in range(5) for j in range(5) if i != j)


def test_jaccard_links(spark, odd, none, monkeypatch):
    rng = random.Random(7)
    rows = []
    for k in range(90):  # one large cluster of near and exact copies, small ones, and texts of their own
        words = prose(0 if k < 40 else k % 12, 60).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z", "w"])
        rows.append((k, " ".join(words), None))
    rows += [(100, rows[0][1], None), (0, rows[50][1], None), (None, rows[0][1], None), (101, rows[3][1] + " x", None)]
    wanted = linked(keyed(rows))
    assert len(wanted) > 400
    for part in (512, 7):
        monkeypatch.setattr(jaccard_join, "PART", part)
        found = [(r.a, r.b) for r in jaccard_join.jaccard_links(make_docs(spark, rows)).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    assert {(r.a, r.b) for r in jaccard_join.jaccard_links(odd).collect()} == linked(keyed(odd_rows()))
    assert jaccard_join.jaccard_links(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in connected_components(frame, Scratch(spark, "test"), "c").collect()}
    assert all(found.get(x, x) == find(x) for x in root)


def path():
    import public_tokenizers

    return public_tokenizers.path(queries.TOKENIZER)


def test_bpe(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(path())
    ids = {(d, t or ""): library.encode(t or "", add_special_tokens=False).ids for d, t, _ in odd_rows()}
    made = bpe.encode(odd, path())
    for r in made.collect():
        assert list(r.token_ids) == ids[r.doc_id, r.text or ""]
    both = bpe.roundtrip(odd, path()).collect()
    assert sorted((r.doc_id or 0, r.text, list(r.token_ids), r.n_tokens) for r in both) == sorted((d or 0, t or "", ids[d, t or ""], len(ids[d, t or ""])) for d, t, _ in odd_rows())
    assert bpe.encode(none, path()).count() == bpe.roundtrip(none, path()).count() == 0
    back = bpe.decode(made, path()).collect()
    assert sorted((r.text, r.doc_id or 0) for r in back) == sorted((t or "", d or 0) for d, t, _ in odd_rows())
    for r in bpe.digests(odd, path()).where("doc_id = 11").collect():
        own = ids[11, odd_rows()[12][1]]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
    assert bpe.digests(none, path()).count() == 0


def test_bpe_pairs_are_judged_without_merging():
    model = bpe.Bpe(path())
    rng = np.random.default_rng(5)
    tokens = np.flatnonzero(model.sound)
    a, b = rng.choice(tokens, 4000), rng.choice(tokens, 4000)
    wanted = [model.merge(model.bytes[x] + model.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert model.compatible(a, b).tolist() == wanted and 100 < sum(wanted) < 4000
    for token in rng.choice(sorted(model.ids.values()), 500).tolist():
        assert (model.merge(model.bytes[token]) == [token]) == bool(model.sound[token])


def test_bpe_random_text():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(path())
    rng = random.Random(2)
    signs = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "é", "ñ", "漢", "😀", "1", "²", "\x1c", "\x85", "\u2028", "\u3000", "<|endoftext|>", "!!", "The", " the", "ing", "\u0301", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["ab" * 3000, " " * 900]
    model = bpe.Bpe(path())
    found = model.encode(texts)
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [model.decode(ids) for ids in found] == texts


def test_suffix_dedup(spark, odd, none):
    rows = keyed(odd_rows())
    wanted = removed([(d, t) for k, (d, t) in enumerate(rows) if (d, t) not in rows[:k]])
    found = suffix_dedup.removed_report(odd).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        if r.doc_id is not None:
            n, gone, spans, kept = wanted[r.doc_id]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
        else:
            assert r.n_removed == 0
    cleaned = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(odd).collect()}
    assert cleaned[2] is None and cleaned[6] == "" and cleaned[1] == rows[0][1]
    assert suffix_dedup.remove_repeats(odd).columns == odd.columns
    assert suffix_dedup.removed_report(none).count() == 0


@pytest.mark.parametrize("piece", [1 << 21, 300])
def test_suffix_dedup_random(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(3)
    parts = [prose(k, 14) for k in range(12)] + ["xy" * 60, "z" * 90, "é" * 40]
    rows = [(k, "".join(rng.choice(parts)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 9))), None) for k in range(60)]
    wanted = removed(keyed(rows))
    for r in suffix_dedup.removed_report(make_docs(spark, rows)).collect():
        n, gone, spans, kept = wanted[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_over_many_tasks(spark, monkeypatch):
    """Runs of many tasks meet in many ranges."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").repartition(13, "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = removed(rows)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_report(docs).collect()}
    assert found == {d: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, (n, gone, spans, kept) in wanted.items()}
    assert sum(gone for _, gone, _, _ in found.values()) > 50_000


def test_suffix_dedup_tells_parts_not_documents(spark, monkeypatch):
    """What buckets and ranges tell is a row for each part of the documents, however many documents they know of."""
    made, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert suffix_dedup.removed_report(docs).where("n_removed > 0").count() > 100
    parts, buckets = 16, 16  # the least numbers of both
    assert 0 < made["named"] <= parts * (buckets + 1) + 32  # and a row for each batch of sampled grams
    assert 0 < made["cuts"] <= parts * (buckets + 1)


def test_loser_tree():
    rng = random.Random(5)
    runs = []
    for _ in range(7):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(0, 30)))
        commons = [0] + [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(strings, strings[1:], strict=False)]
        runs.append((strings, commons[: len(strings)]))
    order, lcps = merge_runs(runs, 8)
    at = [0] * 7
    out = []
    for s in order:
        out.append(runs[s][0][at[s]])
        at[s] += 1
    assert out == sorted(x for s, _ in runs for x in s)
    assert lcps[1:] == [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(out, out[1:], strict=False)]


def test_warc(spark):
    html = ["<p>same</p>", "other", None, "", "<p>same</p>", "é\r\n\r\nx", "<p>same</p>"]
    rows = [(k, f"http://a/{k}\r\nX: y" if k == 5 else (None if k == 1 else f"http://a/{k}"), h, 1, "z") for k, h in enumerate(html)] + [(None, "u", "<p>same</p>", 1, "z"), (6, "http://a/6", "<p>same</p>", 1, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int, mark string")

    def run(table):
        scratch = Scratch(spark, "test")
        folder = scratch.path("archives")
        index = scratch.save(warc.write_archives(warc.plan_records(table), folder, most_bytes=700), "index")
        return index, folder

    index, folder = run(pages)
    found = warc.read_records(index, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        body = "<p>same</p>" if r.page_id is None else html[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), warc.base32_digest(body.encode()))
        revisit = {0: 6, 4: 6, 2: 3}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", revisit) if revisit is not None else ("response", None))
        assert r.payload is None if revisit is not None else bytes(r.payload) == body.encode()
    assert {r.page_id for r in warc.read_records(index, folder, where=F.col("url").endswith("/6")).collect()} == {6}
    index, folder = run(pages.limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_ranges_are_joined():
    reads = list(warc.coalesce_ranges(iter([("a", 0, 10), ("a", 10, 10), ("a", 500, 5), ("b", 0, 5)]), most=100, gap=50))
    assert reads == [("a", 0, 20, [(0, 10), (10, 10)]), ("a", 500, 505, [(500, 5)]), ("b", 0, 5, [(0, 5)])]
