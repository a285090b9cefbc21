"""License scans (5): a paragraph classifier (sparse word n-grams, logistic regression) with a calibrated unknown class,
whose predictions a comparison with templates confirms.

A paragraph is a line, or 40 words of a longer line, each 20 words on. The classifier learns from variants of the
templates and, for the unknown class, from paragraphs of the corpus, cut in the same way, that resemble no template; those
that share some word pairs with one stay as hard cases. Temperature and threshold are calibrated on whole templates, and
paragraphs, that the model at hand has not learned from: two models, each without every other template of a family and
without some variants of the rest, see what the other learned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import blocks, mix64, table, utf8, word_hashes
from tessellum.llm.licence_templates import TEMPLATES

BITS = 18
ORDERS = (1, 2, 3)
WINDOW, STRIDE = 40, 20
#: Documents whose paragraphs teach the unknown class, about, and paragraphs of them (by a hash) at most.
UNKNOWN_DOCS = 400
UNKNOWN_PARAGRAPHS = 6000
#: Variants made of each template.
VARIANTS = 24
STEPS = 200
#: The fit ends when no weight moves by more than this share of the largest.
SETTLED = 1e-3
FOLDS = 2
#: Share of paragraphs that are taken to belong to no family before they are read; classes weigh alike in training.
UNKNOWN_PRIOR = 0.9
LEAST_THRESHOLD, MOST_THRESHOLD = 0.02, 0.95
#: Share of held-out unknown paragraphs that may pass for a family: the threshold is set by it.
FALSE_RATE = 0.001
#: Share of held-out paragraphs of families that it may keep out: the comparison with templates, not the threshold, has the last word.
MISS_RATE = 0.02
#: Share of word pairs (of the shorter side) that a paragraph and a template must have in common.
MIN_OVERLAP = 0.6
#: A paragraph with less than this in common with every template is none of their families.
FOREIGN = 0.3
#: Words that may stand between matched ones of one place.
GAP = 4
#: Share of a place's word pairs that families of higher probability may have taken already.
MOST_TAKEN = 0.5
UNKNOWN = "unknown"
_STRIP = b"\"'()[]{}<>.,;:!?*#/-_|"


def _clean(text: bytes) -> bytes:
    """Lower case with punctuation at word ends taken off, so that quotes and stops don't hide a notice."""
    return text.lower().translate(_SPACED)


_SPACED = bytes(32 if b in _STRIP and b not in b"./-" else b for b in range(256))


def _grams(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its first word) of the word n-grams inside lines."""
    out, at = [], []
    h = words
    for n in ORDERS:
        if n > 1:
            if len(h) < 2:
                break
            h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :])
        k = np.flatnonzero(line[: len(h)] == line[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        out.append((h[k] + np.uint64(n)) >> np.uint64(64 - BITS))
        at.append(k)
    return np.concatenate(out).astype(np.int64), np.concatenate(at)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, text) of cleaned texts."""
    data, offs = utf8(pa.array([_clean(t).decode("utf-8", "replace") for t in texts], pa.large_string()))
    h, _, _, doc = word_hashes(data, offs)
    return h, doc


def _rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket)."""
    h, doc = _words(texts)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, at = _grams(h, doc)
    key = np.unique(doc[at].astype(np.int64) << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def _pairs(text: bytes) -> set:
    w = [x.strip(_STRIP) for x in text.lower().split()]
    w = [x for x in w if x]
    return set(zip(w, w[1:], strict=False)) or {tuple(w)}


@dataclass
class LicenceModel:
    families: list[str]
    weight: np.ndarray  # (buckets, families) float32; family 0 is unknown
    bias: np.ndarray
    temperature: float
    threshold: float
    pairs: dict[str, list[set]] = field(default_factory=dict)

    def matches(self, paragraph: bytes) -> dict[str, list[tuple[float, int, int, set]]]:
        """Of each family (overlap, first word, end, word pairs) of the places that resemble one of its templates.

        The overlap is the share of the word pairs of the shorter of paragraph and template that both have. A template
        that comes again after other words has a place of its own each time.
        """
        words = [(k, x) for k, x in ((k, x.strip(_STRIP)) for k, x in enumerate(paragraph.lower().split())) if x]
        own = _pairs(paragraph)
        steps = [((a, b), i, j) for (i, a), (j, b) in zip(words, words[1:], strict=False)] or [(tuple(x for _, x in words), k, k) for k, _ in words[:1]]
        out: dict[str, list[tuple[float, int, int, set]]] = {}
        for family, templates in self.pairs.items():
            places: list[tuple[float, int, int, set]] = []
            for t in templates:
                least = max(1, min(len(own), len(t)))
                if len(own & t) < MIN_OVERLAP * least:
                    continue
                runs: list[list] = []
                for step in (x for x in steps if x[0] in t):
                    if runs and step[1] - runs[-1][-1][2] <= GAP:
                        runs[-1].append(step)
                    else:
                        runs.append([step])
                whole = [r for r in runs if len({x[0] for x in r}) >= MIN_OVERLAP * least] or [[x for r in runs for x in r]]
                places += [(len({x[0] for x in r}) / least, r[0][1], r[-1][2] + 1, {x[0] for x in r}) for r in whole]
            if places:
                out[family] = places
        return out

    def overlap(self, family: str, paragraph: bytes) -> float:
        """Largest share of the word pairs of the shorter of paragraph and template that both have."""
        own = _pairs(paragraph)
        return max((len(own & t) / max(1, min(len(own), len(t))) for t in self.pairs[family]), default=0.0)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature + _log_prior(len(self.families))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _log_prior(families: int) -> np.ndarray:
    return np.log([UNKNOWN_PRIOR, *[(1 - UNKNOWN_PRIOR) / max(1, families - 1)] * (families - 1)])


def _variants(rng: np.random.Generator, text: str, filler: list[bytes]) -> list[bytes]:
    words = text.encode().split()
    out = [text.encode(), text.lower().encode(), text.upper().encode()]
    while len(out) < VARIANTS:
        kept = [w for w in words if rng.random() > 0.08] or words
        pad = lambda: filler[rng.integers(len(filler))].split()[: rng.integers(0, 6)] if filler else []
        out.append(b" ".join([*pad(), *kept, *pad()]))
    return out


def _softmax_fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """L2-regularised softmax regression on binary features, classes weighing alike, by Nesterov's method."""
    n = len(y)
    share = 1 / np.maximum(np.bincount(y, minlength=k), 1)[y] / k
    one = np.eye(k)[y]
    norm = np.bincount(row, minlength=n).max(initial=1) + 1
    w, b = np.zeros((m, k)), np.zeros(k)
    w0, b0 = w, b
    step = 4.0 / norm * n / 4
    for s in range(STEPS):
        t = s / (s + 3)
        v, c = w + t * (w - w0), b + t * (b - b0)
        z = np.stack([np.bincount(row, weights=v[col, j], minlength=n) for j in range(k)], axis=1) + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - one) * share[:, None]
        w0, b0 = w, b
        rate = step / n * 4
        w = v - rate * (np.stack([np.bincount(col, weights=g[row, j], minlength=m) for j in range(k)], axis=1) + 1e-5 * v)
        b = c - rate * g.sum(axis=0)
        if s % 10 == 9 and np.abs(w - w0).max(initial=0.0) < SETTLED * np.abs(w).max(initial=0.0):
            break
    return w, b


def _paragraphs(docs: DataFrame, text_col: str) -> DataFrame:
    """``(line)``: the paragraphs of all lines, as a scan cuts them: WINDOW words from each STRIDE-th on, the last one reaching the end."""
    words = F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = docs.filter(F.col(text_col).isNotNull()).select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).select(words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - WINDOW) / STRIDE)).cast("int")
    return lines.select("w", F.explode(F.sequence(F.lit(0), last)).alias("k")).select(F.array_join(F.slice("w", F.col("k") * STRIDE + 1, WINDOW), " ").alias("line"))


def _fit(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, use: np.ndarray, families: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of all buckets, biases) learned from the texts in ``use``."""
    mine = use[row]
    used, col = np.unique(bucket[mine], return_inverse=True)
    # features of the unknown class alone carry no weight: they'd only follow the sample's own words
    speaks = np.zeros(len(used), bool)
    speaks[col[y[row[mine]] > 0]] = True
    place = np.cumsum(speaks) - 1
    keep = speaks[col]
    w, b = _softmax_fit((np.cumsum(use) - 1)[row[mine][keep]], place[col[keep]], y[use], int(speaks.sum()), families)
    full = np.zeros((1 << BITS, families), np.float32)
    full[used[speaks]] = w
    return full, b


def _logits(weight: np.ndarray, row: np.ndarray, bucket: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of weights of the texts ``of`` (a mask), without biases."""
    mine = of[row]
    at, n = (np.cumsum(of) - 1)[row[mine]], int(of.sum())
    return np.stack([np.bincount(at, weights=weight[bucket[mine], j], minlength=n) for j in range(weight.shape[1])], axis=1)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: dict[str, list[str]] | None = None, unknown_docs: int = UNKNOWN_DOCS, seed: int = 3) -> LicenceModel:
    """Learn families from templates and the unknown class from paragraphs of about ``unknown_docs`` documents (by a hash
    of their ids), UNKNOWN_PARAGRAPHS at most (by a hash of theirs; repeated ones count once). Null ids and texts teach
    nothing; an empty table teaches no unknown class beyond shuffled templates. Of equal probabilities the family that
    comes first by name wins."""
    templates = templates or TEMPLATES
    total = docs.count()
    u = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter(F.col(id_col).isNotNull() & (u < min(1.0, unknown_docs / max(1, total))))
    lines = _paragraphs(sample, text_col).distinct().orderBy(F.xxhash64("line"), "line").limit(UNKNOWN_PARAGRAPHS)
    corpus = [r[0].encode("utf-8", "surrogatepass") for r in lines.collect()]
    pairs = {f: [_pairs(t.encode()) for t in texts] for f, texts in templates.items()}
    flat = [p for v in pairs.values() for p in v]
    known_pairs = set().union(*flat)

    def foreign(x: bytes) -> bool:
        own = _pairs(x)
        shared = own & known_pairs
        return not shared or all(len(shared & p) < FOREIGN * max(1, min(len(own), len(p))) for p in flat)

    unknown = [x for x in corpus if foreign(x)]
    found_ones = len(unknown)
    rng = np.random.default_rng(seed)
    # words of the templates in another order belong to no family
    bag = [w for texts in templates.values() for t in texts for w in t.encode().split()]
    unknown += [b" ".join(bag[i] for i in rng.integers(0, len(bag), rng.integers(3, 20))) for _ in range(400)]
    families = [UNKNOWN, *sorted(templates)]
    texts, y, fold = list(unknown), [0] * len(unknown), (np.arange(len(unknown)) % FOLDS).tolist()
    for k, f in enumerate(families[1:], 1):
        for nth, t in enumerate(templates[f]):
            made = _variants(rng, t, unknown)
            texts += made
            y += [k] * len(made)
            # a fold leaves out whole templates (not a family's only one) and every fourth variant of the others
            left_out = nth % FOLDS if len(templates[f]) > 1 else -1
            fold += [1 - left_out if left_out >= 0 and v % 4 == 3 else left_out if left_out >= 0 else v % FOLDS if v % 4 == 3 else -1 for v in range(len(made))]
    y, fold = np.array(y), np.array(fold)
    row, bucket = _rows(texts)
    seen, truth, from_corpus = [], [], np.arange(len(y)) < found_ones
    for k in range(FOLDS):
        weight, bias = _fit(row, bucket, y, fold != k, len(families))
        seen.append(_logits(weight, row, bucket, fold == k) + bias)
        truth.append(y[fold == k])
    logits, truth, own = np.concatenate(seen), np.concatenate(truth), np.concatenate([from_corpus[fold == k] for k in range(FOLDS)])
    full, bias = _fit(row, bucket, y, np.ones(len(y), bool), len(families))
    model = LicenceModel(families, full, bias, 1.0, 0.5, pairs)

    def soft(t: float) -> np.ndarray:
        z = logits / t + _log_prior(len(families))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return -np.log(np.maximum(soft(t)[np.arange(len(truth)), truth], 1e-12)).mean()

    # a temperature, then the threshold that keeps the corpus's unknown paragraphs out, but few of the families'
    model.temperature = min([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0], key=loss)
    outside = 1 - soft(model.temperature)[own, 0]
    inside = 1 - soft(model.temperature)[truth > 0, 0]
    low, high = np.quantile(inside, MISS_RATE) if len(inside) else 1.0, np.quantile(outside, 1 - FALSE_RATE) if len(outside) else 0.0
    model.threshold = float(np.clip(min(low, high), LEAST_THRESHOLD, MOST_THRESHOLD))
    return model


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings ``(id, line, family, probability, overlap, confirmed, paragraph)`` of whole texts, by document and line
    (counted from 0); each place of a family in a line counts once, by its best paragraph. Documents without a finding, null and empty
    texts give no row; repeated rows and null ids give their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        speaks = m.weight.any(axis=1)
        k = len(m.families)
        for b in blocks(batches, "_text"):
            raw = b.column(1).cast(pa.binary()).to_pylist()
            lines = [(i, j, x) for i, t in enumerate(raw) if t for j, x in enumerate(t.split(b"\n")) if x and not x.isspace()]
            spans: dict[tuple, list] = {}
            doubtful: dict[tuple, tuple] = {}
            if lines:
                h, line = _words([x for _, _, x in lines])
                if len(h):
                    first = np.searchsorted(line, np.arange(len(lines)))
                    bucket, at = _grams(h, line)
                    keep = speaks[bucket]
                    bucket, at = bucket[keep], at[keep]
                    pos = at - first[line[at]]
                    counts = np.diff(np.append(first, len(h)))
                    last = np.maximum(0, -(-(counts - WINDOW) // STRIDE))[line[at]]  # the last window of the line
                    k1 = np.minimum(pos // STRIDE, last)
                    k2 = np.minimum(np.maximum(pos // STRIDE - 1, 0), k1)
                    key = np.concatenate([line[at] << 32 | k1, (line[at] << 32 | k2)[k2 < k1]])
                    cell = np.concatenate([bucket, bucket[k2 < k1]])
                    key, cell = _distinct(key, cell)
                    windows, back = np.unique(key, return_inverse=True)
                    logits = np.stack([np.bincount(back, weights=m.weight[cell, j], minlength=len(windows)) for j in range(k)], axis=1)
                    p = m.probabilities(logits) if len(windows) else np.zeros((0, k))
                    p_family = p[:, 1:]
                    best = p_family.argmax(axis=1) + 1 if len(windows) else np.zeros(0, int)
                    hit = np.flatnonzero(1 - p[:, 0] >= m.threshold) if len(windows) else []
                    for w in hit:
                        li, win = int(windows[w] >> 32), int(windows[w] & 0xFFFFFFFF)
                        i, j, x = lines[li]
                        words = _clean(x).split()[win * STRIDE : win * STRIDE + WINDOW]
                        paragraph = b" ".join(words)
                        matched = m.matches(paragraph)
                        taken: set = set()
                        confirmed = False
                        # the likeliest first; a family that resembles nothing but what these matched is none of its own
                        for f in np.argsort(-p[w, 1:], kind="stable") + 1:
                            family = m.families[f]
                            own = [x for x in matched.get(family, []) if len(x[3] & taken) <= MOST_TAKEN * len(x[3])]
                            for overlap, start, end, _ in own:
                                spans.setdefault((i, j, family), []).append((win * STRIDE + start, win * STRIDE + end, (float(p[w, f]), overlap, paragraph)))
                            taken = taken.union(*[x[3] for x in own])
                            confirmed |= bool(own)
                        if not confirmed:
                            family = m.families[best[w]]
                            row = (float(p[w, best[w]]), m.overlap(family, paragraph), paragraph)
                            doubtful[i, j, family] = max(row, doubtful.get((i, j, family), row))
            found = {(*key, 0): row for key, row in doubtful.items() if key not in spans}
            for key, places in spans.items():
                end = -1
                for start, stop, row in sorted(places):
                    if start >= end:
                        at = (*key, start)
                        found[at] = row
                    else:
                        found[at] = max(found[at], row)
                    end = max(end, stop)
            order = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([i for i, *_ in order], pa.int64())),
                    pa.array([j for _, j, *_ in order], pa.int64()),
                    pa.array([f for _, _, f, _ in order], pa.string()),
                    pa.array([found[o][0] for o in order], pa.float64()),
                    pa.array([found[o][1] for o in order], pa.float64()),
                    pa.array([found[o][1] >= MIN_OVERLAP for o in order], pa.bool_()),
                    pa.array([found[o][2].decode("utf-8", "replace") for o in order], pa.string()),
                ],
                names=["id", "line", "family", "probability", "overlap", "confirmed", "paragraph"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, line long, family string, probability double, overlap double, confirmed boolean, paragraph string")
    return out.withColumnRenamed("id", id_col)


def _distinct(key: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((cell, key))
    key, cell = key[order], cell[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))) if len(key) else np.zeros(0, bool)
    return key[new], cell[new]


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed findings: doc_id, line, family, probability, overlap, confirmed, paragraph."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).filter("confirmed")
