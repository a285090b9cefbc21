"""LM scoring (3): a bigram model whose counts lie in a log-frequency Bloom filter that is broadcast to the workers.

A bigram of count n stands in the filter once for each level 1 .. 1 + floor(log2 n); a query probes level after level
until one is missing, which gives the quantised count back. Word counts are exact and broadcast beside it. Counting
covers all training documents: each map task sends sorted runs of 64-bit hashes, cut by hash range, and one task a range
merges them and builds its own segment of the filter.

The model's probability is an interpolation, s p2(w|u) + (1 - s) p1(w), with p1 add-one over words and p2 the count's lower
bound at its level, less an absolute discount, over the context's count and what false positives of the filter add to it over
all words: with the filter's rate f (its fill to the power of the probes) these are f V entries of level 1, and a level too
much for a share f of the true ones. So each context's probabilities sum to one at most, in the mean over hash functions.
Words that the training doesn't know have no bigrams. s is the share of training bigrams that occur again (Good-Turing's seen
mass), less for rare contexts; the discount is n1 / (n1 + 2 n2) of the numbers of bigrams that come once and twice.

``score`` broadcasts the filter, up to MODEL_BYTES. ``score_by_runs``, which the query takes at every size, leaves it where it
is: a run of texts sends each of its words and bigrams once, with its counts in training texts; the task of a hash range sums
them, builds its segment and answers from it with a byte a bigram, in the order of the question; the answers meet the texts of
the run. The scores are the same, false positives included. Hashes travel as sorted differences, split into bytes of equal
weight, which the shuffle's compression shortens to some six bytes a hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import blocks, discard, fold, give_back, materialise, mix64, segment_sum, table, utf8, word_hashes

#: Word counts and filter together are broadcast up to this size.
MODEL_BYTES = 160 << 20
BITS_PER_ITEM = 12
PROBES = 8
MAX_LEVEL = 48
#: Hashes that a counting task holds before it sends a run.
RUN = 1 << 21
#: Bytes of a run of texts that asks for counts and levels.
ASKING = 8 << 20
END, START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each row and their number); each row's words and one end."""
    data, offs = utf8(column)
    word, _, _, doc = word_hashes(data, offs)
    n = len(offs) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(int(first[-1]), END, np.uint64)
    out[np.arange(len(word)) + doc] = word
    return out, first


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return before


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(u * np.uint64(0x9E3779B97F4A7C15) + w)


def _level(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), MAX_LEVEL)


def least_count(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, 2.0 ** (np.maximum(level, 1) - 1), 0.0)


def _counts(keys: bytes, counts: bytes) -> np.ndarray:
    """Counts of 64-bit keys, of 32 bits where all of them fit, else of 64."""
    return np.frombuffer(counts, np.uint64 if len(counts) == len(keys) else np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, those of equal weight together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(data, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _cut(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, first, end) of the parts of ascending keys by hash range."""
    part = keys >> np.uint64(shift)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return part[at].astype(np.int64), at, np.append(at[1:], len(keys))[: len(at)]


def _positions(keys: np.ndarray, level: int, bits: np.ndarray | int):
    """Bit positions of (key, level), one array a probe."""
    h = mix64(keys + np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * step & np.uint64((1 << 40) - 1)) % np.asarray(bits, np.uint64)


def filter_segment(keys: np.ndarray, counts: np.ndarray, bits_per_item: int = BITS_PER_ITEM) -> bytes:
    """The bits of one hash range, in proportion to its entries."""
    level = _level(counts)
    bits = max(64, -(-int(level.sum()) * bits_per_item // 64) * 64)
    out = np.zeros(bits // 8, np.uint8)
    for k in range(1, int(level.max(initial=0)) + 1):
        for at in _positions(keys[level >= k], k, bits):
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def _false_rate(segment: bytes) -> float:
    """The chance that a segment shows a level that nobody put in."""
    bits = np.frombuffer(segment, np.uint8)
    return float(np.bitwise_count(bits).sum() / (8 * len(bits))) ** PROBES if len(bits) else 0.0


def segment_levels(keys: np.ndarray, segment: bytes) -> np.ndarray:
    """Levels of keys of one hash range by its segment; without one 0."""
    out = np.zeros(len(keys), np.int64)
    bits = np.frombuffer(segment, np.uint8)
    alive = np.arange(len(keys) if len(bits) else 0)
    for level in range(1, MAX_LEVEL + 1):
        if not len(alive):
            break
        keep = np.ones(len(alive), bool)
        for at in _positions(keys[alive], level, 8 * len(bits)):
            at = at.astype(np.int64)
            keep &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        alive = alive[keep]
        out[alive] = level
    return out


@dataclass
class BloomModel:
    words: bytes  # sorted uint64 hashes
    word_counts: bytes  # uint32, or uint64 where a count needs it
    segments: bytes
    starts: np.ndarray  # first byte of each range's segment, and the end
    shift: int  # hash >> shift is the range
    total: int
    distinct: int
    start_count: int
    seen: float
    discount: float = 0.0
    false_rate: float = 0.0

    def count(self, tokens: np.ndarray) -> np.ndarray:
        keys, counts = np.frombuffer(self.words, np.uint64), _counts(self.words, self.word_counts)
        if not len(keys):
            return np.zeros(len(tokens), np.int64)
        some, back = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        return np.where(keys[at] == some, counts[at], 0).astype(np.int64)[back]

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        bits = np.frombuffer(self.segments, np.uint8)
        part = (pairs >> np.uint64(self.shift)).astype(np.int64)
        base, size = self.starts[part], (self.starts[part + 1] - self.starts[part]) * 8
        alive = np.flatnonzero(size > 0)
        for level in range(1, MAX_LEVEL + 1):
            if not len(alive):
                break
            keep = np.ones(len(alive), bool)
            for at in _positions(pairs[alive], level, size[alive]):
                at = at.astype(np.int64)
                keep &= (bits[base[alive] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[keep]
            out[alive] = level
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each row."""
        tokens, first = tokens_of(column)
        return self.sums(first, self.count(tokens), lambda at: self.levels(pair_hash(contexts(tokens, first), tokens)[at]))

    def sums(self, first: np.ndarray, c: np.ndarray, levels: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """The columns of ``score`` from the counts of the rows' tokens and what gives the levels of the bigrams at some places."""
        n = len(first) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[first[:-1]] = self.start_count
        level = np.zeros(len(c), np.int64)
        both = np.flatnonzero((c > 0) & (before > 0))  # words that the training doesn't know have no bigram
        level[both] = levels(both)
        size = self.total + self.distinct + 1
        p1 = (c + 1) / size
        p = self.probability(least_count(level), before, p1)
        base = segment_sum(np.log10(c + 1.0), owner, n) - np.diff(first) * np.log10(size)
        return np.diff(first), segment_sum(c > 0, owner, n).astype(np.int64), base, segment_sum(np.log10(p), owner, n)

    def probability(self, least: np.ndarray, before: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Of a token with this least bigram count, count of its context and unigram probability."""
        weight = self.seen * before / (before + 1)
        share = (least - self.discount) / np.maximum(before * (1 + self.false_rate) + self.false_mass, 1)
        return weight * np.clip(share, 0.0, 1.0) + (1 - weight) * p1

    @property
    def false_mass(self) -> float:
        """What false positives are expected to add to the counts of a context."""
        return self.false_rate * self.distinct * (1 - self.discount)


def _runs(hashes: list[np.ndarray], kind: int, shift: int):
    keys, counts = np.unique(np.concatenate(hashes), return_counts=True)
    part, at, ends = _cut(keys, shift)
    counts = counts.astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(at), pa.int32()), pa.array(part), pa.array([pack_keys(keys[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary())],
        names=["kind", "part", "keys", "counts"],
    )


def count_ranges(docs: DataFrame, text_col: str = "text", bits_per_item: int = BITS_PER_ITEM) -> tuple[DataFrame, int]:
    """Merged counts by kind (0 words, 1 bigrams) and hash range: ``n`` entries, ``total``, ``once`` (entries of count one),
    ``size`` of what would be broadcast, and for words keys and counts, for bigrams the filter's segment."""
    parts = docs.rdd.getNumPartitions()  # of the plan; runs nothing
    bits = min(16, max(4, int(np.ceil(np.log2(8 * max(1, parts))))))
    shift = 64 - bits

    def count(batches):
        held, size = ([], []), 0
        for b in blocks(batches, text_col):
            tokens, first = tokens_of(b.column(0))
            held[0].append(tokens)
            held[1].append(pair_hash(contexts(tokens, first), tokens))
            size += len(tokens)
            if size >= RUN:
                for kind in (0, 1):
                    yield _runs(held[kind], kind, shift)
                held, size = ([], []), 0
        if size:
            for kind in (0, 1):
                yield _runs(held[kind], kind, shift)

    def merge(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        keys = np.concatenate([unpack_keys(x.as_buffer()) for x in group.column("keys")])
        counts = np.concatenate([_from_planes(x.as_buffer(), np.uint32) for x in group.column("counts")])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, sums = keys[at], np.add.reduceat(counts, at, dtype=np.int64)
        wide = np.uint64 if len(sums) and sums.max() >= 1 << 32 else np.uint32
        first, second = (keys.tobytes(), sums.astype(wide).tobytes()) if kind == 0 else (filter_segment(keys, sums, bits_per_item), b"")
        row = {"kind": [kind], "part": [part], "n": [len(keys)], "total": [int(sums.sum())], "once": [int((sums == 1).sum())], "twice": [int((sums == 2).sum())], "false": [_false_rate(first) if kind else 0.0], "size": [len(first) + len(second)], "first": [first], "second": [second]}
        return pa.table(row, schema=pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("once", pa.int64()), ("twice", pa.int64()), ("false", pa.float64()), ("size", pa.int64()), ("first", pa.binary()), ("second", pa.binary())]))

    runs = docs.select(F.col(text_col)).mapInArrow(count, "kind int, part long, keys binary, counts binary")
    return runs.groupBy("kind", "part").applyInArrow(merge, "kind int, part long, n long, total long, once long, twice long, false double, size long, first binary, second binary"), shift


def train(docs: DataFrame, text_col: str = "text", model_bytes: int = MODEL_BYTES, bits_per_item: int = BITS_PER_ITEM) -> tuple[BloomModel, DataFrame]:
    """Count all of ``docs``: the model and the table of counts and segments by hash range that it comes from. Null texts
    count as empty: one end. Over ``model_bytes`` the model has sums but no tables."""
    counted, shift = count_ranges(docs, text_col, bits_per_item)
    counted = materialise(counted)
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("once").alias("once"), F.sum("twice").alias("twice"), F.sum("false").alias("false"), F.sum("size").alias("size")).collect()}
    if not sums:
        return BloomModel(b"", b"", b"", np.zeros((1 << 64 - shift) + 1, np.int64), shift, 0, 0, 0, 0.0), counted
    sizes = np.zeros((1 << 64 - shift) + 1, np.int64)
    words: list[bytes] = []
    counts: list[bytes] = []
    segments: list[bytes] = []
    start_count = 0
    if sum(r["size"] for r in sums.values()) <= model_bytes:
        ordered = counted.select("kind", "part", "first", "second").repartitionByRange(16, "kind", "part").sortWithinPartitions("kind", "part")
        for r in ordered.toLocalIterator():
            if r["kind"] == 0:
                words.append(bytes(r["first"]))
                counts.append(bytes(r["second"]))
            else:
                segments.append(bytes(r["first"]))
                sizes[r["part"] + 1] = len(segments[-1])
    if any(len(c) == len(w) for w, c in zip(words, counts, strict=True) if w):
        counts = [_counts(w, c).astype(np.uint64).tobytes() for w, c in zip(words, counts, strict=True)]
    discount = sums[1]["once"] / max(1, sums[1]["once"] + 2 * sums[1]["twice"])
    model = BloomModel(b"".join(words), b"".join(counts), b"".join(segments), np.cumsum(sizes), shift, sums[0]["total"], sums[0]["n"], 0, 1.0 - sums[1]["once"] / sums[1]["total"], discount, sums[1]["false"] * 2.0 ** (shift - 64))
    del words, counts, segments
    # each document starts and ends once
    start_count = int(model.count(np.array([END]))[0]) if model.words else docs.count()
    model.start_count = start_count
    return model, counted


def score(docs: DataFrame, model: BloomModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and n_tokens, n_known, train_tokens, base_score, score; one row for each row; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]

    def run(batches):
        for b in blocks(batches, "_text"):
            n, known, base, own = shared.value.score(b.column("_text"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n), pa.array(known), pa.array(base), pa.array(own)], names=[*b.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    out = source.mapInArrow(run, ", ".join([*types, "n_tokens long, n_known long, base_score double, score double"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _asking(batches, column: str):
    """(number, blocks) of the runs of a task's texts."""
    held, size, n = [], 0, 0
    for b in blocks(batches, column):
        held.append(b)
        size += int(utf8(b.column(column))[1][-1])
        if size >= ASKING:
            yield n, held
            held, size, n = [], 0, n + 1
    if held:
        yield n, held


def _run_id(n: int) -> int:
    return TaskContext.get().partitionId() << 32 | n


def _marks(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A digest of the keys of each part."""
    return np.bitwise_xor.reduceat(mix64(keys), at).view(np.int64)


def _questions(docs: DataFrame, training: Column, asks: bool, shift: int, text_col: str) -> DataFrame:
    """``(kind, part, run, mark, keys, counts)``: the distinct words (0) and bigrams (1) of each run of texts, by hash range,
    with their counts in the texts of ``training``. Without ``asks`` the run is null: nobody waits for an answer."""

    def run(batches):
        for n, held in _asking(batches, "text"):
            hashes = ([], []), ([], [])
            for b in held:
                tokens, first = tokens_of(b.column("text"))
                learns = np.repeat(b.column("learns").to_numpy(zero_copy_only=False), np.diff(first))
                for kind, h in enumerate((tokens, pair_hash(contexts(tokens, first), tokens))):
                    hashes[kind][0].append(h)
                    hashes[kind][1].append(h[~learns])
            for kind in (0, 1):
                keys, counts = np.unique(np.concatenate(hashes[kind][0]), return_counts=True)
                others, times = np.unique(np.concatenate(hashes[kind][1]), return_counts=True)
                counts[np.searchsorted(keys, others)] -= times
                counts = counts.astype(np.uint32)
                part, at, ends = _cut(keys, shift)
                packed = [pa.array([f(x[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()) for f, x in ((pack_keys, keys), (_planes, counts))]
                run = pa.array([_run_id(n) if asks else None] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(part), run, pa.array(_marks(keys, at)), *packed], names=["kind", "part", "run", "mark", "keys", "counts"])

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("learns"))
    return rows.mapInArrow(run, "kind int, part long, run long, mark long, keys binary, counts binary")


_ANSWER = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("run", pa.int64()), ("mark", pa.int64()), ("told", pa.binary()), *[(x, pa.int64()) for x in ("n", "total", "once", "twice", "ends")], ("false", pa.float64())])


def _answers(questions: DataFrame, bits_per_item: int) -> DataFrame:
    """The answer of each hash range to each run, ``(kind, part, run, mark, told)``: the counts of words, in 32 bits or 64, or
    the levels of bigrams in the range's filter, a byte each. A row without a run has the range's sums."""

    def merge(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        asked = [unpack_keys(x.as_buffer()) for x in group.column("keys")]
        counts = np.concatenate([_from_planes(x.as_buffer(), np.uint32) for x in group.column("counts")])
        ends = np.cumsum([len(x) for x in asked])
        keys = np.concatenate(asked)
        del asked
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        at = np.flatnonzero(new)
        keys, sums = keys[at], np.add.reduceat(counts[order], at, dtype=np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        known = sums > 0
        segment = filter_segment(keys[known], sums[known], bits_per_item) if kind and known.any() else b""
        value = segment_levels(keys, segment).astype(np.uint8) if kind else sums
        rows = {x: [] for x in _ANSWER.names}
        for run, mark, a, b in zip(group.column("run").to_pylist(), group.column("mark").to_pylist(), [0, *ends[:-1]], ends, strict=True):
            if run is not None:
                told = value[place[a:b]]
                told = told.tobytes() if kind else _planes(told if told.max() >= 1 << 32 else told.astype(np.uint32))
                for x, v in (("run", run), ("mark", mark), ("told", told)):
                    rows[x].append(v)
        n = len(rows["run"])
        sums = {"n": known.sum(), "total": sums.sum(), "once": (sums == 1).sum(), "twice": (sums == 2).sum(), "ends": sums[keys == END].sum() if kind == 0 else 0, "false": _false_rate(segment)}
        for x in ("run", "mark", "told"):
            rows[x].append(None)
        for x, v in sums.items():
            rows[x] = [None] * n + [v.item() if hasattr(v, "item") else v]
        return pa.table(rows | {"kind": [kind] * (n + 1), "part": [part] * (n + 1)}, schema=_ANSWER)

    return questions.groupBy("kind", "part").applyInArrow(merge, "kind int, part long, run long, mark long, told binary, n long, total long, once long, twice long, ends long, false double")


def score_by_runs(docs: DataFrame, training: Column | DataFrame, keep: list[str], text_col: str = "text", bits_per_item: int = BITS_PER_ITEM) -> DataFrame:
    """The rows of ``score`` by a model that is never in one place: see above. ``training`` marks rows of ``docs``, or is a
    table of its own. ``docs`` is read twice and must give the same rows in the same tasks each time, as a stored table does;
    if it doesn't, the digests of questions and texts differ, which is an error."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    kept = [f"_k{i}" for i in range(len(keep))]
    own = {f.name: f"{f.name} {f.dataType.simpleString()}" for f in source.schema}
    apart = isinstance(training, DataFrame)
    parts = max([x.rdd.getNumPartitions() for x in ([docs, training] if apart else [docs])])  # of the plan; runs nothing
    shift = 64 - min(16, max(4, int(np.ceil(np.log2(8 * max(1, parts))))))
    questions = _questions(docs, F.lit(False) if apart else training, True, shift, text_col)
    if apart:
        questions = questions.union(_questions(training, F.lit(True), False, shift, text_col))
    answers = materialise(_answers(questions, bits_per_item))
    sums = {r["kind"]: r for r in answers.filter("run IS NULL").groupBy("kind").agg(*[F.sum(x).alias(x) for x in ("n", "total", "once", "twice", "ends", "false")]).collect()}
    model = BloomModel(b"", b"", b"", np.zeros(1, np.int64), shift, 0, 0, 0, 0.0)
    if sums and sums[1]["total"]:
        words, pairs = sums[0], sums[1]
        discount = pairs["once"] / max(1, pairs["once"] + 2 * pairs["twice"])
        # each document starts and ends once
        model = replace(model, total=words["total"], distinct=words["n"], start_count=words["ends"], seen=1.0 - pairs["once"] / pairs["total"], discount=discount, false_rate=pairs["false"] * 2.0 ** (shift - 64))

    def placed(batches):
        for n, held in _asking(batches, "_text"):
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_run_id(n)] * b.num_rows, pa.int64())], names=[*b.schema.names, "run"])

    def told(answers: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
        part, at, ends = _cut(keys, shift)
        mine = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part")
        if not (np.array_equal(mine.column("part").to_numpy(), part) and np.array_equal(mine.column("mark").to_numpy(), _marks(keys, at))):
            raise RuntimeError("the table of texts gave other rows when it was read again: write it first")
        out = np.zeros(len(keys), np.int64)
        for x, a, b in zip(mine.column("told"), at, ends, strict=True):
            x = x.as_buffer()
            out[a:b] = np.frombuffer(x, np.uint8) if kind else _from_planes(x, np.uint64 if len(x) == 8 * (b - a) else np.uint32)
        return out

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise RuntimeError("the table of texts gave other rows when it was read again: write it first")
        tokens, first = tokens_of(texts.column("_text"))
        words, word = np.unique(tokens, return_inverse=True)
        pairs, pair = np.unique(pair_hash(contexts(tokens, first), tokens), return_inverse=True)
        del tokens
        c, level = told(answers, 0, words)[word], told(answers, 1, pairs)
        n, known, base, total = model.sums(first, c, lambda at: level[pair[at]])
        give_back()
        return pa.table([*(texts.column(k) for k in kept), pa.array(n), pa.array(known), pa.array(base), pa.array(total)], names=[*kept, "n_tokens", "n_known", "base_score", "score"])

    texts = source.mapInArrow(placed, ", ".join([*own.values(), "run long"]))
    types = ", ".join([*(own[k] for k in kept), "n_tokens long, n_known long, base_score double, score double"])
    asked = answers.filter("run IS NOT NULL").select("run", "kind", "part", "mark", "told")
    out = texts.groupBy("run").cogroup(asked.groupBy("run")).applyInArrow(run, types)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, training: DataFrame, keep: list[str], text_col: str = "text", model_bytes: int = MODEL_BYTES, bits_per_item: int = BITS_PER_ITEM) -> DataFrame:
    """Train on ``training`` and score ``docs``: by the broadcast filter up to ``model_bytes``, else by segments that stay where they are."""
    if model_bytes:
        model, counted = train(training, text_col, model_bytes, bits_per_item)
        if model.words or not model.total:
            return score(docs, model, keep, text_col)
        discard(counted)
    stored = materialise(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])]))
    return score_by_runs(stored, training, keep, text_col, bits_per_item)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null ids are in neither fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_by_runs(docs, fold("doc_id", 7) != 2, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
