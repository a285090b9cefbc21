"""Merkle manifests, byte-level BPE and collocations against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessellum.llm import bpe, collocations, merkle

LOWER = {c: c + 32 for c in range(65, 91)}


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves, fanout):
    """(root, siblings of each leaf as (before, after) a level), level by level."""
    at, paths, nodes = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for leaf, i in enumerate(at):
            run, k = runs[i // fanout], i % fanout
            paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        at, nodes = [i // fanout for i in at], [_h(r) for r in runs]
    return nodes[0], paths


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (3, 1), (2, 8)])
def test_manifest(spark, fanout, levels):
    rnd = random.Random(fanout)
    sizes = {"a": 37, "": 1, None: 2, "é": 8, "Z": 16, "b": 64}
    rows = [(g, i, _h([str(g), str(i)])) for g, n in sizes.items() for i in range(n)]
    rows += [("a", 5, rows[5][2])] * 3 + [("a", None, _h(["x"])), ("a", 7, _h(["other"]))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, r[1]) for r in rows], "g string, id long, leaf string, path long").repartition(5)
    got = merkle.manifest(docs, "g", ["id"], keep=["id"], fanout=fanout, levels=levels).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    groups = collections.defaultdict(list)
    for g, i, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = _tree([trees[g][0] for g in names], fanout)
    want = collections.Counter()
    for g, up in zip(names, above, strict=True):
        for (has, i, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            want[g, i if has else None, leaf, trees[g][0], root, tuple(path + up)] += 1
    assert collections.Counter((r.g, r.id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in got) == want
    assert all(r.again == root for r in got)


def test_manifest_query_tells_what_was_changed(spark, tmp_path):
    rows = [(i, f"text é {i}", None if i % 9 == 0 else "en", "s", None if i % 4 == 0 else i) for i in range(50)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1
    for r in got:
        i, text, lang, source, n = next(x for x in rows if x[0] == r.doc_id)
        assert r.leaf == _h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text))
        assert r.verified == (r.folded_root == r.root) == (i is None or n is None or zlib.crc32(str(i).encode()) % 7 != 0)


def _library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS_PATH, "rb"))}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rnd = random.Random(3)
    kinds = ["word ", "don't", "I'll ", "  ", "\n\n", "\t", "日本語。", "ещё ", "3.14", "—", "<|endoftext|>", "　", "\x1c", "\x85", " !?", "x" * 40, "😀", "é", "'", "'s"]
    texts = ["", " ", "\n", "'s", "a  ", "   b", "<|endoftext|>"]
    texts += ["".join(rnd.choices(kinds, k=rnd.randint(1, 60))) for _ in range(200)]
    return texts + ["".join(rnd.choices(kinds, k=40_000)), "ab1" * 90_000, "日本、" * 40_000, " " * 70_000 + "x\n" + " " * 70_000, "x" + "\n" * 66_000 + "y" + " " * 70_000 + "\n"]


def test_chunks_keep_the_ids():
    whole, ranks = _library(), bpe.Ranks(open(bpe.RANKS_PATH, "rb").read(), public_tokenizers.PATTERN)
    for text in _texts():
        ids = ranks.encode(text)
        assert ids.tolist() == whole.encode_ordinary(text)
        assert ranks.decode(ids) == text.encode()
        assert "".join(part for _, part in bpe.chunks(text)) == text
    assert len(list(bpe.chunks(_texts()[-5]))) > 1 < len(list(bpe.chunks("ab1" * 90_000)))
    # more white space than the library's expression can hold: one match before the last character
    long = "x" + " " * 1_200_000 + "y"
    ids = ranks.encode(long)
    assert ids.tolist() == [*whole.encode_ordinary("x"), *ranks.as_one.encode_ordinary(" " * 1_199_999), *whole.encode_ordinary(" y")]
    assert ranks.decode(ids) == long.encode() and ranks.decode(np.array([len(ranks.known)])) is None


def test_bpe_columns(spark):
    whole, texts = _library(), [*_texts(), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = {i: whole.encode_ordinary(t or "") for i, t in enumerate(texts)}
    plain = bpe.encode_column(docs, ["id"], bpe.RANKS_PATH)
    packed = bpe.encode_column(docs, ["id"], bpe.RANKS_PATH, packed=True)
    assert {r.id: r.token_ids for r in plain.collect()} == want
    assert {r.id: np.frombuffer(r.token_ids, "<u4").tolist() for r in packed.collect()} == want
    assert all(r.n_tokens == len(want[r.id]) for r in plain.collect())
    for tokens in (plain, packed):
        assert {r.id: bytes(r.decoded) for r in bpe.decode_column(tokens, ["id"], bpe.RANKS_PATH).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [5, None]), (4, [10**6]), (5, [-1])], "id long, token_ids array<int>")
    assert {r.id: r.decoded for r in bpe.decode_column(odd, ["id"], bpe.RANKS_PATH).collect()} == {1: None, 2: b"", 3: None, 4: None, 5: None}
    broken = spark.sql("SELECT 1 AS id, cast(unhex('61ff62') AS string) AS text")
    assert bpe.encode_column(broken, ["id"], bpe.RANKS_PATH).first().token_ids == whole.encode_ordinary("a�b")


def _words(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def _collocations(docs, least, top, covered, longest=3):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        for ws in _words(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = []
    known = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, ws), a in known.items():
        if any(g == lang and len(vs) > len(ws) and 100 * b >= covered * a and any(vs[i : i + len(ws)] == ws for i in range(len(vs))) for (g, vs), b in known.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(ws), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked = collections.Counter()
    for r in out:
        ranked[r[0]] += 1
        if ranked[r[0]] <= top:
            yield (r[0], ranked[r[0]], *r[1:])


def _talk():
    rnd = random.Random(11)
    words = ["Of", "the", "new", "York", "times", "a", "éa", "B", "\x1c", "\xa0x", "in", "Straße"]
    docs = []
    for i in range(150):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", ""]) for _ in range(rnd.randint(0, 80)))
        docs.append((text + " New York Times" * (i % 3), ["en", "EN", None, "de"][i % 4]))
    return [*docs, (None, "en"), ("", "en"), ("the same of", None), docs[0], docs[0]]


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (4, 4, 7), (2, 300, 5)])
def test_collocations(spark, monkeypatch, longest, least, top):
    monkeypatch.setattr(collocations, "RANKED", 2)
    docs = [(t, g) for t, g in _talk()]
    frame = spark.createDataFrame([(t, g, 1, "x") for t, g in docs], "text string, g string, a long, phrase string").repartition(4)
    got = collocations.collocations(frame, "g", least=least, words=longest, top=top).collect()
    want = list(_collocations([(t, g or "und") for t, g in docs], least, top, 50, longest))
    assert sorted((r.group, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == sorted(want)
    assert want or least == 300


def test_slices_of_a_long_text_count_each_phrase_once(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 100)
    text = " ".join(t for t, _ in _talk() if t)
    found = collections.Counter()
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text])], names=["_group", "_text"])
    for data, offs, groups, own in collocations._slices([batch], 3):
        grams = collocations._Grams(data, offs, groups, own, 3, True)
        found.update(grams.phrases(np.arange(len(grams.first))).to_pylist())
    want = collections.Counter(" ".join(ws[i : i + k]) for ws in _words(text) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    assert found == want


def test_merged_sketches_never_undercount():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    parts = [keys[rng.zipf(1.3, 5000) % 3000] for _ in range(4)]
    true = collections.Counter(np.concatenate(parts).tolist())
    for row in (0, 1):
        total = np.zeros(1 << 12, np.int64)
        for part in parts:
            for stripe, raw in collocations._sketch(part, row, 12, 300):
                cells, counts = collocations._unpack(raw)
                total[cells + (stripe << 12)] += counts
        assert all(total[int(collocations._cells(np.array([k], np.uint64), row, 12)[0])] >= min(300, c) for k, c in true.items())
    cells, counts = np.array([0, 65534, 65535, 200_000, 4_000_000], np.uint32), np.array([1, 254, 255, 256, 70_000])
    back = collocations._unpack(collocations._pack(cells, counts))
    assert back[0].tolist() == cells.tolist() and back[1].tolist() == counts.tolist()
