"""Methods against brute force, on small tables."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessellum.llm import bloom_lm, common, components, hnsw, licences, mixing, simhash, url_filter, weighted_sampling
from tessellum.llm import sentencepiece_tokens as sp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _unite(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    n = 400
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 90)] + [tuple(map(int, rng.integers(200, n, 2))) for _ in range(120)]
    want = _unite(n, links)
    edges = spark.createDataFrame([*links, (5, 5), (None, 3)], "u long, v long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def test_word_hashes_are_words():
    texts = ["A b\tA  Straße\x0bstraße\nA", "", "   ", "x" * 3000, "b"]
    import pyarrow as pa

    data, offs = common.utf8(pa.array(texts))
    h, _, _, doc = common.word_hashes(data, offs)
    want = [(w.translate(LOWER), i) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert doc.tolist() == [i for _, i in want]
    by = collections.defaultdict(set)
    for (w, _), x in zip(want, h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


def _simhash(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{rng.integers(30)}" for _ in range(rng.integers(0, 700))) + " é\x0bÉ" * int(rng.integers(0, 2)) for _ in range(40)] + ["", None, "one", "one Two"]
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert [int(x) for x in got] == [_simhash(t) for t in texts]


@pytest.mark.parametrize("hot", [256, 3])
@pytest.mark.parametrize("parts", [(3,), (2,), (4,)])
def test_simhash_links(spark, hot, parts):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(25):
            x = b
            for bit in rng.integers(0, 64, 3):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = _unite(len(fps), near)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    plan = simhash.plan_search(table, part_counts=parts)
    got = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(table, plan, hot)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_thresholds_are_dealt_to_cheap_parts():
    costs = [{-1: 0.0, 0: 100.0, 1: 900.0}, {-1: 0.0, 0: 5.0, 1: 20.0}, {-1: 0.0, 0: 6.0, 1: 30.0}]
    assert simhash.deal_thresholds(costs, 0) == (26.0, [-1, 1, 0])


def test_hnsw_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(900):
        v = centres[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in (v if i % 50 else centres[0])], i % 2))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    s = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    want = _unite(len(rows), zip(*np.nonzero(s), strict=True))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in hnsw.embedding_links(df, shard=120, queries=200).collect()}
    assert [got[i].n_links for i in range(len(rows))] == s.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == want
    assert all(r.audit_recall == 1.0 for r in got.values())


def test_hnsw_sparse_links_are_audited_and_found(spark):
    """Thirty planted pairs among vectors that link with nothing else, and one pair across shards of a size used in production."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[30:60] = hnsw._turned(x[:30], 0.94, rng)
    s = x @ x.T >= 0.93
    np.fill_diagonal(s, False)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in hnsw.embedding_links(df, shard=1500).collect()}
    assert [got[i].n_links for i in range(3000)] == s.sum(axis=1).tolist() and s.sum() >= 60
    assert {r.audit_recall for r in got.values()} <= {got[0].audit_recall} and got[0].audit_recall >= 0.999


def test_audit_knows_planted_links_where_there_are_none():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    audit = hnsw.audited_beam(graph, x, x[:500], np.arange(500), 0.97)
    assert audit.links >= hnsw.AUDIT and audit.planted == hnsw.AUDIT and audit.recall >= hnsw.AUDIT_RECALL
    for level in graph.links:  # a graph without edges fails its audit and falls back on the whole shard
        level[:] = -1
    assert hnsw.audited_beam(graph, x, x[:500], np.arange(500), 0.97).beam > hnsw.WIDEST


def test_links_are_folded_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(hnsw, "HELD_LINKS", 1000)
    ids = np.arange(100, 3100)
    links = hnsw.Links(ids, ids, np.full(3000, 2))
    for lo in range(0, 3000, 50):  # all pairs of a group of near copies
        i, j = np.meshgrid(np.arange(lo, lo + 50), np.arange(3000), indexing="ij")
        links.add(i.ravel(), j.ravel())
        assert sum(len(u) for u, _ in links.held) < 3000
    node, root = links.fold()
    assert (links.found == 2 * 2999).all() and len(node) == 2999 and (root == 100).all()


def test_large_numbers_do_not_overflow(spark):
    df = spark.createDataFrame([(1, [1e200, 1e200], 1), (2, [1.0, 1.0], 1), (3, [-0.0, 5.0], 1), (4, [0.0, 5.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.embedding_links(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def test_graph_beams_find_neighbours():
    x = np.random.default_rng(5).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    ids, _ = graph.search(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :64].tolist(), true.tolist(), strict=True)]) > 0.9


def _bigram_counts(tokens):
    pairs = collections.Counter(p for t in tokens for p in zip(["<s>", *t], t, strict=False))
    return pairs, collections.Counter(w for t in tokens for w in t), len(tokens)


def _brute_probability(u, w, pairs, c, n_docs, n, v):
    once, twice = (sum(x == k for x in pairs.values()) for k in (1, 2))
    seen, discount = 1 - once / sum(pairs.values()), once / (once + 2 * twice)
    before = n_docs if u == "<s>" else c[u]
    least = 2 ** int(math.log2(pairs[u, w])) if pairs[u, w] else 0
    s = seen * before / (before + 1)
    return s * max(0.0, (least - discount) / max(before, 1)) + (1 - s) * (c[w] + 1) / (n + v + 1)


@pytest.mark.parametrize("size", [bloom_lm.MODEL_BYTES, 0])
def test_language_model(spark, size):
    rng = np.random.default_rng(16)
    texts = ["the cat sat on the mat", "The cat sat", None, "", "a dog sat on the cat", "zebra zebra"] * 5 + [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 40) % 90) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = df.filter("doc_id % 4 <> 3")
    tokens = [[*WORD.findall((t or "").translate(LOWER)), "\0"] for t in texts]
    pairs, c, n_docs = _bigram_counts([t for i, t in enumerate(tokens) if i % 4 != 3])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in bloom_lm.lm_scores(df, training, ["doc_id"], model_bytes=size, bits_per_item=256).collect()}  # as good as no false positives
    for i, t in enumerate(tokens):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        own = sum(math.log10(_brute_probability(u, w, pairs, c, n_docs, n, v)) for u, w in zip(["<s>", *t], t, strict=False))
        r = got[i]
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.score == pytest.approx(own)


def test_probabilities_of_a_context_sum_to_one_at_most(spark):
    """Over all known words and one unknown one, of the model as it is used, false positives included."""
    rng = np.random.default_rng(18)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 120) % 400) for _ in range(150)]
    import pyarrow as pa

    model, _ = bloom_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words = sorted({w for t in texts for w in t.split()})
    tokens, first = bloom_lm.tokens_of(pa.array(words))
    tokens = np.append(tokens[first[:-1]], bloom_lm.END)
    c = model.count(tokens)
    size = model.total + model.distinct + 1
    sums = []
    for u, n in zip(tokens[:-1], c[:-1], strict=True):
        least = bloom_lm.least_count(model.levels(bloom_lm.pair_hash(np.full(len(tokens), u), tokens)))
        sums.append(model.probability(least, np.full(len(tokens), n), (c + 1) / size).sum() + model.probability(np.zeros(1), np.array([n]), np.array([1 / size])).sum())
    assert model.false_rate > 0.0005 and len(sums) > 200 and np.mean(np.array(sums) <= 1 + 1e-9) > 0.98 and max(sums) < 1.2 and np.average(sums, weights=c[:-1]) < 1


def test_counts_over_32_bits_are_kept():
    keys = np.arange(4, dtype=np.uint64).tobytes()
    assert bloom_lm._counts(keys, np.array([1, 2, 3, 1 << 40], np.uint64).tobytes()).tolist() == [1, 2, 3, 1 << 40]
    assert bloom_lm._counts(keys, np.array([1, 2, 3, 4], np.uint32).tobytes()).tolist() == [1, 2, 3, 4]


def test_bloom_levels():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    counts = rng.integers(1, 300, 5000)
    bits = bloom_lm.filter_segment(keys, counts)
    model = bloom_lm.BloomModel(b"", b"", bits, np.array([0, len(bits)]), 63, 0, 0, 0, 0.0)
    keys = keys >> np.uint64(1)
    bits = bloom_lm.filter_segment(keys, counts)
    model.segments, model.starts = bits, np.array([0, len(bits), len(bits)])
    got = model.levels(keys)
    true = bloom_lm._level(counts)
    assert (got >= true).all() and (got == true).mean() > 0.9
    assert (model.levels(rng.integers(0, 1 << 62, 5000, dtype=np.uint64)) > 0).mean() < 0.08


def test_tokenizer_is_the_library_s():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)
    p = sp.read_pieces(sp.MODEL_PATH)
    rng = np.random.default_rng(7)
    bits = ["a", "th", "the", "日本", "😀", " ", "  ", "\n", "ing", "É", "\t", "0", "==", "    ", "import "]
    texts = []
    for _ in range(300):
        text = "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 120)))
        texts.append(text)
        ids = p.encode(text)
        assert ids == lib.encode(text) and p.decode(ids) == text
        marked = "▁" + text.replace(" ", "▁")
        if text:
            commits = list(p.stream(marked[k : k + 5] for k in range(0, len(marked), 5)))
            assert [i for c in commits for i in c] == ids
    for _ in range(2):  # the second time words and pairs are remembered
        ids, counts = p.encode_texts(texts)
        assert counts.tolist() == [len(lib.encode(t)) for t in texts] and ids.tolist() == [i for t in texts for i in lib.encode(t)]
    assert p.decode(p.encode("a ▁ b▁")) == "a ▁ b▁"
    whole = "x" * 20_000
    assert p.encode(whole) == lib.encode(whole) and len(list(p.stream(iter([whole])))) > 50
    assert len(list(p.stream(iter(["日本語" * 5000])))) > 50


@pytest.mark.parametrize("limit", [1, 7, 64])
def test_slices_and_tables_change_no_ids(monkeypatch, limit):
    rng = np.random.default_rng(17)
    texts = [None, "", " ", "▁", "a\n\n b", *["".join(chr(c) for c in rng.choice([32, 97, 101, 104, 116, 233, 10, 0x65E5, 0x1F600, 0x2581], rng.integers(1, 200))) for _ in range(80)]]
    want, sizes = sp.read_pieces(sp.MODEL_PATH).encode_texts(texts)
    for name, value in (("SLICE", limit), ("TOGETHER", limit), ("ARENA", limit)):
        monkeypatch.setattr(sp, name, value)
    p = sp.Pieces.load(open(sp.MODEL_PATH, "rb").read())
    got, counts = p.encode_texts(texts)
    assert got.tolist() == want.tolist() and counts.tolist() == sizes.tolist()
    import pyarrow as pa

    assert p.gives(got, counts, pa.array(texts)).all()
    wrong = got.copy()
    wrong[-1] = wrong[-1] + 1
    assert p.gives(wrong, counts, pa.array(texts)).tolist() == [True] * (len(texts) - 1) + [False]


def test_columns_come_back(spark):
    texts = ["", None, "a b", "日本語 ▁", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = sp.encode_column(df, ["doc_id"], sp.MODEL_PATH)
    back = {r.doc_id: r.text for r in sp.decode_column(coded, ["doc_id"], sp.MODEL_PATH).collect()}
    assert [back[i] for i in range(5)] == ["", "", *texts[2:]] and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in coded.collect())


def test_weighted_jaccard():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 300) % 400) for _ in range(60)]
    sig = weighted_sampling.signatures(texts, 64)
    errors = []
    for i in range(0, 60, 2):
        a, b = (collections.Counter(t.split()) for t in texts[i : i + 2])
        k = set(a) | set(b)
        errors.append(float(weighted_sampling.likeness(sig[i : i + 1], sig[i + 1 : i + 2])[0]) - sum(min(a[x], b[x]) for x in k) / sum(max(a[x], b[x]) for x in k))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert (weighted_sampling.signatures([texts[3]] + texts, 64)[0] == sig[3]).all()


def test_next_document(spark):
    texts = {i * 3: f"text number {i} " * (i % 7) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in weighted_sampling.fingerprint_with_next(df, range_rows=20).collect()}
    order = sorted(texts, reverse=True)
    import hashlib

    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, u = texts[i], texts[after]
        m = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + u[:m]).encode()).hexdigest() and got[i].n_chars == len(t)
    alone = weighted_sampling.fingerprint_with_next(df.filter("doc_id = 6")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_url_rules_in_chunks(spark):
    rules = [*url_filter.RULES, ("a.example.net", "/en/x", "block"), ("example.org", "", "block"), ("org", "/fr/", "block"), ("b.c", "/a/b", "allow"), ("b.c", "/a/", "block")]
    urls = ["http://a.example.net/en/xyz", "http://a.example.net/en/", "http://q.example.org", "http://example.org/fr/", "http://fr.org/fr/", "http://x.b.c/a/bc/d", "http://b.c/a/c", "http://b.c/a", "http://net/", "http://xnet/", "x", "http://net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = None
    for size in (500_000, 2, 1):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, max_rules=size).collect()}
        assert want is None or got == want
        want = got
    assert [want[i] for i in range(len(urls))] == [
        ("a.example.net/en/x", "block"), ("example.net/en/", "allow"), ("example.org", "block"), ("example.org", "block"), ("org/fr/", "block"), ("b.c/a/b", "allow"), ("b.c/a/", "block"), (None, "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]


def _slow_match(rules, host, path):
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1, -1, "", ""), (h.count(".") + 1, len(p), verdict == "block", f"{h}{p}"))
    return best and (best[3], "block" if best[2] else "allow")


def test_url_trie_is_brute_force_and_scales():
    import time

    rng = np.random.default_rng(19)
    hosts, parts = ["a.b", "b", "x.a.b", "c"], ["", "d", "de", "def", "e", "é"]

    def path():
        return "".join("/" + parts[int(k)] for k in rng.integers(0, len(parts), rng.integers(0, 4)))

    rules = [(hosts[int(rng.integers(4))], path(), "block" if rng.random() < 0.5 else "allow") for _ in range(120)]
    trie = url_filter.UrlTrie(rules)
    for _ in range(2000):
        host, p = ["y.", ""][int(rng.integers(2))] + hosts[int(rng.integers(4))], path()
        got = trie.match(host, p)
        assert (got and got[2:]) == _slow_match(rules, host, p)
    many = [("big.net", f"/p/q{k}", "block") for k in range(100_000)]
    began = time.process_time()
    trie = url_filter.UrlTrie(many)
    for k in range(0, 100_000, 10):
        assert trie.match("www.big.net", f"/p/q{k}-more")[2] == f"big.net/p/q{k}"
    assert time.process_time() - began < 5


def test_licences_found_and_prose_left_alone(spark):
    prose = ["the river runs under the bridge and the work is long", "all the rights of way were reserved seats", "a public library with general books, version two"] * 40
    rows = [(i, t) for i, t in enumerate(prose)] + [(900, "x\nLicensed under the Apache License, Version 2.0.\ny"), (901, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"), (902, "word " * 300 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files" + " word" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licences.scan(df, licences.train(df)).filter("confirmed").collect()
    assert {(r.doc_id, r.family) for r in found} == {(900, "apache"), (901, "gpl"), (902, "mit")}
