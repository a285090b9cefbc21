"""Phrase collocation mining (13): count-min sketches find what may be frequent, a second pass counts that exactly.

First pass: each task adds the n-grams of a slice of text to a sketch of two rows of counters, which is sent in stripes and
merged by sums; the rows grow with the text, so stripes, not tasks, become more. A counter is never below the count of an
n-gram that falls on it, so where both of its counters are high enough, an n-gram survives, and none that is frequent is lost.
Which counters are high enough is a bitmap of at most ``BITMAP_BITS`` bits a row (neighbours share a bit where there are more
counters), which is broadcast. Second pass: n-grams that survive are counted by their words, in the task first; what the
sketch let through too much ends here, so its size changes costs, never results. Words, too, are n-grams, and n is the sum of
all of them. Scores are decimals of 38 digits.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessellum.llm.common import _BYTE, blocks, discard, materialise, mix64, table, utf8, word_spans

#: Bytes of text that a task works on at once, and of which it sends one sketch.
SLICE = 2 << 20
#: Counters a row for each byte of text; rows have 2^16 to 2^34 counters.
COUNTERS_A_BYTE, MIN_BITS, MAX_BITS = 0.25, 16, 34
#: Counters of a stripe (4 MB while it is merged), and bits of a bitmap: 32 MB a row at most.
STRIPE_BITS, BITMAP_BITS = 22, 28
#: Rows that are ranked in one task, in lists to be kept.
RANKED = 32

_WORD_END, _PIECE_END = np.zeros(256, bool), np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD_END[:] = _PIECE_END
_WORD_END[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SECOND_BYTE = mix64(_BYTE)
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROW = np.uint64(0xA0761D6478BD642F)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, twice: bool) -> list[np.ndarray]:
    """One or two 64-bit hashes of each word, A-Z as a-z, by spans of a million bytes."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(1 + twice)]
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20))))
        lens = ends[lo:hi] - starts[lo:hi]
        at = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum())) - np.repeat(at, lens)
        chars = data[within + np.repeat(starts[lo:hi], lens)]
        for h, base, byte in zip(out, _BASES, (_BYTE, _SECOND_BYTE), strict=False):
            h[lo:hi] = np.add.reduceat(byte[chars] * np.cumprod(np.full(int(lens.max()) + 1, base, np.uint64))[within], at)
        lo = hi
    return [mix64(h) for h in out]


def _next(data: np.ndarray, at: int, word_end: bool) -> int:
    """The first byte from ``at`` on that ends a word (or doesn't), or the length."""
    while at < len(data):
        found = np.flatnonzero(_WORD_END[data[at : at + 65536]] == word_end)
        if len(found):
            return at + int(found[0])
        at += 65536
    return len(data)


def _slices(batches, words: int):
    """(bytes, offsets, group of each text, bytes in which n-grams start): slices of texts, and parts of long ones, which
    overlap by the words that an n-gram can reach over the end."""
    for b in blocks(batches, "_text", SLICE, 1 << 30):
        data, offs = utf8(b.column("_text"))
        groups = b.column("_group")
        if len(data) <= 2 * SLICE or b.num_rows > 1:
            yield data, offs, groups, len(data)
            continue
        lo = 0
        while lo < len(data):
            hi = _next(data, lo + SLICE, True)
            end = hi
            for _ in range(words - 1):
                end = _next(data, _next(data, end, False), True)
            yield data[lo:end], np.array([0, end - lo]), groups, hi - lo
            lo = hi


class _Grams:
    """All n-grams of up to ``words`` words of a slice: hashes, first words and sizes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, groups: pa.Array, own: int, words: int, twice: bool):
        self.data = data
        self.starts, self.ends = word_spans(data, offs, _WORD_END)
        docs = np.searchsorted(offs, self.starts, side="right") - 1
        coded = groups.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.group = coded.indices.to_numpy(zero_copy_only=False)[docs] if len(docs) else np.zeros(0, np.int64)
        breaks = np.concatenate(([0], np.cumsum(_PIECE_END[data], dtype=np.int32)))
        goes_on = np.zeros(len(docs), bool)
        goes_on[:-1] = (breaks[self.starts[1:]] == breaks[self.ends[:-1]]) & (docs[1:] == docs[:-1])
        n = int(np.searchsorted(self.starts, own))
        named = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in self.names), np.uint64).reshape(-1, 2)
        of_word = _hashes(data, self.starts, self.ends, twice)
        fits = np.arange(n)
        so_far = [mix64(h[:n] ^ named[self.group[:n], i]) for i, h in enumerate(of_word)]
        hashes, first, size = [so_far], [fits], [np.ones(n, np.int8)]
        for k in range(1, words):
            on = goes_on[fits + k - 1]
            fits, so_far = fits[on], [h[on] for h in so_far]
            so_far = [mix64(h * base + of_word[i][fits + k]) for i, (h, base) in enumerate(zip(so_far, _BASES, strict=False))]
            hashes.append(so_far)
            first.append(fits)
            size.append(np.full(len(fits), k + 1, np.int8))
        self.hashes = [np.concatenate([h[i] for h in hashes]) for i in range(len(of_word))]
        self.first, self.size = np.concatenate(first), np.concatenate(size)
        self.words = np.bincount(self.group[:n], minlength=len(self.names))

    def phrases(self, which: np.ndarray) -> pa.Array:
        """Lower-cased words of these n-grams, joined by spaces."""
        first, size = self.first[which], self.size[which].astype(np.int64)
        word = _ranges(first, size)
        last = np.zeros(len(word), bool)
        last[np.cumsum(size) - 1] = True
        lens = self.ends[word] - self.starts[word] + ~last
        out = _LOWER[self.data[np.minimum(_ranges(self.starts[word], lens), len(self.data) - 1)]]
        stops = np.cumsum(lens)
        out[stops[~last] - 1] = 32
        offs = np.concatenate(([0], stops[last])).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offs), pa.py_buffer(out)]).cast(pa.string())


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h if row == 0 else mix64(h ^ _ROW)) >> np.uint64(64 - bits)


def _sketch(h: np.ndarray, row: int, bits: int, cap: int):
    """(stripe, counters of a slice that aren't 0) of one row: a uint32 and a capped count each."""
    stripe = min(bits, STRIPE_BITS)
    cells = np.sort(_cells(h, row, bits))
    if not len(cells):
        return
    new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    counts = np.minimum(np.diff(np.append(new, len(cells))), cap)
    cells = cells[new]
    ends = np.searchsorted(cells >> np.uint64(stripe), np.arange((1 << bits - stripe) + 1, dtype=np.uint64))
    low = (cells & np.uint64((1 << stripe) - 1)).astype(np.uint32)
    for s in np.flatnonzero(np.diff(ends)):
        part = slice(int(ends[s]), int(ends[s + 1]))
        yield int(s), _pack(low[part], counts[part])


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending cells as their count, gaps of two bytes (65,535: further on) and counts of one (255: in four at the end)."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype(np.int64)
    far, many = np.flatnonzero(gaps >= 65535), np.flatnonzero(counts >= 255)
    parts = [np.array([len(cells), len(far), len(many)], "<u4"), np.minimum(gaps, 65535).astype("<u2"), np.minimum(counts, 255).astype(np.uint8), gaps[far].astype("<u4"), counts[many].astype("<u4")]
    return b"".join(p.tobytes() for p in parts)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, far, many = np.frombuffer(raw, "<u4", 3).tolist()
    gaps = np.frombuffer(raw, "<u2", n, 12).astype(np.int64)
    counts = np.frombuffer(raw, np.uint8, n, 12 + 2 * n).astype(np.int64)
    gaps[gaps == 65535] = np.frombuffer(raw, "<u4", far, 12 + 3 * n)
    counts[counts == 255] = np.frombuffer(raw, "<u4", many, 12 + 3 * n + 4 * far)
    return np.cumsum(gaps), counts


def _frequent_bits(texts: DataFrame, words: int, least: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch a bitmap of the counters (or their neighbours) of at least ``least``."""
    shown = min(bits, BITMAP_BITS)
    fold = 1 << bits - shown
    stripe = min(bits, STRIPE_BITS)

    def sketch(batches):
        for data, offs, groups, own in _slices(batches, words):
            h = _Grams(data, offs, groups, own, words, False).hashes[0]
            for row in (0, 1):
                found = list(_sketch(h, row, bits, least))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["row", "stripe", "part"])

    def merge(parts: pa.Table) -> pa.Table:
        total = np.zeros(1 << stripe, np.uint32 if least > 127 else np.uint8)
        for raw in parts.column("part"):
            cells, counts = _unpack(raw.as_py())
            total[cells] = np.minimum(total[cells] + counts, least)
        high = np.packbits((total >= least).reshape(-1, fold).any(axis=1), bitorder="little")
        return parts.slice(0, 1).drop_columns("part").append_column("high", pa.array([zlib.compress(high.tobytes(), 1)], pa.binary()))

    parts = texts.mapInArrow(sketch, "row int, stripe int, part binary").groupBy("row", "stripe").applyInArrow(merge, "row int, stripe int, high binary")
    found = [np.zeros((1 << shown) // 8, np.uint8) for _ in (0, 1)]
    for r in parts.collect():  # at most the bitmaps, however many n-grams there are
        high = np.frombuffer(zlib.decompress(bytes(r.high)), np.uint8)
        found[r.row][r.stripe * len(high) : (r.stripe + 1) * len(high)] = high
    return found


def _counts(texts: DataFrame, words: int, bitmaps: list[np.ndarray]) -> DataFrame:
    """(group, size, phrase, count) of the n-grams whose counters are high, and of all words of a group (size 0, no phrase)."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)
    shown = (len(bitmaps[0]) * 8).bit_length() - 1

    def count(batches):
        maps = shared.value
        for data, offs, groups, own in _slices(batches, words):
            grams = _Grams(data, offs, groups, own, words, True)
            h, second = grams.hashes
            here = np.arange(len(h))
            for row, bitmap in enumerate(maps):
                at = _cells(h[here], row, shown)
                here = here[bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
            order = here[np.argsort(h[here])]
            new = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])))) if len(order) else np.zeros(0, np.int64)
            one, times = order[new], np.diff(np.append(new, len(order)))
            names = pa.array(grams.names, pa.string())
            for lo in range(0, len(one), 1 << 16):
                part = one[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(grams.group[grams.first[part]])), pa.array(grams.size[part]), grams.phrases(part), pa.array(times[lo : lo + (1 << 16)])], names=["group", "size", "phrase", "count"])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(names), np.int8)), pa.nulls(len(names), pa.string()), pa.array(grams.words)], names=["group", "size", "phrase", "count"])

    out = texts.mapInArrow(count, "group string, size byte, phrase string, count long")
    return out.groupBy("group", "size", "phrase").agg(F.sum("count").alias("count"))


def _first_of_each(rows: DataFrame, group: str, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; a group of many rows is ranked in parts by ``key`` first, so no task has one whole."""
    written = []
    while True:
        most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        if most <= RANKED * k:
            break
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(len(written))), F.lit(-(-2 * most // (RANKED * k)))))
        of_part = Window.partitionBy(group, "_part").orderBy(*order)
        rows = materialise(dealt.withColumn("_rank", F.row_number().over(of_part)).where(F.col("_rank") <= k).drop("_part", "_rank"))
        written.append(rows)
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
    if written:
        out = materialise(out)
        discard(*written)
    return out


def collocations(docs: DataFrame, group_col: str, text_col: str = "text", least: int = 10, words: int = 3, covered: int = 50, top: int = 2000, default: str = "und") -> DataFrame:
    """Phrases of 2 to ``words`` words, ``least`` times or more in a group, by how far they exceed what their parts suggest.

    Columns group, rank, phrase, a (its count), l and r (counts of its parts), n (words of the group), score: the lowest over
    cuts of floor(1000000 a a / (l r)), the smallest cut of equal ones. A phrase within a longer candidate that has at least
    ``covered`` per cent of its count is dropped. The first ``top`` a group by score, count (both descending) and phrase.
    Words are told apart by their bytes, A-Z lower-cased; a null group is ``default``; null and empty texts count nothing;
    repeated rows count as often as they stand; an empty table gives an empty result. Decimals hold counts to 10^16.
    """
    texts = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(default)).alias("_group"), F.col(f"`{text_col}`").alias("_text")).where("octet_length(_text) > 0")
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, int(size * COUNTERS_A_BYTE).bit_length()))
    counted = _counts(texts, words, _frequent_bits(texts, words, least, bits))
    known = materialise(counted.where((F.col("size") == 0) | (F.col("count") >= least)))
    totals = known.where("size = 0").select(F.col("group").alias("_g"), F.col("count").alias("n"))
    phrases = known.where("size > 1").select("group", "size", "phrase", F.col("count").alias("a"))
    split = F.split("phrase", " ")

    # what a longer candidate covers
    inner = F.expr(f"flatten(transform(sequence(2, {max(2, words - 1)}), k -> transform(sequence(1, {words}), i -> if(k < size and i + k - 1 <= size, array_join(slice(split(phrase, ' '), i, k), ' '), null))))")
    within = phrases.where("size > 2").select("group", F.explode(F.array_distinct(inner)).alias("phrase"), "a").where("phrase IS NOT NULL").groupBy("group", "phrase").agg(F.max("a").alias("_longer"))
    open_ = phrases.join(within, ["group", "phrase"], "left").where(f"_longer IS NULL OR 100 * _longer < {covered} * a").drop("_longer")

    # scores of cuts
    cuts = open_.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("group", "phrase", "a", "k", F.array_join(F.slice(split, 1, F.col("k")), " ").alias("_left"), F.array_join(F.slice(split, F.col("k") + 1, F.col("size").cast("int")), " ").alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        part = known.where(f"size BETWEEN 1 AND {words - 1}").select("group", F.col("phrase").alias(side), F.col("count").alias(name))
        cuts = cuts.join(part, ["group", side])
    d = "cast({} as decimal(19, 0))"
    scored = cuts.withColumn("score", F.expr(f"cast(1000000 as decimal(7, 0)) * {d.format('a')} * {d.format('a')} div ({d.format('l')} * {d.format('r')})"))
    lowest = scored.groupBy("group", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    lowest = materialise(lowest.select("group", "phrase", "a", "m.l", "m.r", "m.score"))
    best = _first_of_each(lowest, "group", "phrase", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(totals, F.col("group") == F.col("_g")).select("group", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lang (null: ``und``) its first 2000 phrases of 2 to 3 words: lang, rank, phrase, a, l, r, n, score; see
    ``collocations`` for nulls, empty and repeated texts and ties."""
    return collocations(table(spark, sf_dir, "documents"), "lang").withColumnRenamed("group", "lang")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY lang, phrase
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer l ON c.lang = l.lang AND c.phrase = l.phrase WHERE l.a IS NULL OR 100 * l.a < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(ws[:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM kept, (VALUES (1), (2)) AS s(cut) WHERE cut < k
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u JOIN f x ON u.lang = x.lang AND u.lp = x.phrase JOIN f y ON u.lang = y.lang AND u.rp = y.phrase
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON r.lang = n.lang WHERE r.rank <= 2000
"""
