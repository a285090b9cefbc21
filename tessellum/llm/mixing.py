"""Mixing sources to target weights (7), with soft membership; DataFrame functions only.

A naive Bayes classifier over hashed n-grams, learned from a labelled table, gives each document a posterior over domains:
its features are the words and the character pairs at their ends. With n tokens, posterior p and rate r of
each document, the expected tokens of domain d are sum(r n p[d]). Nonnegative rates are fitted to the targets t by
projected gradient steps on the least-squares objective (A r - t)' M (A r - t) / 2, where A r are the domains' expected
tokens: r becomes max(0, r - p . v) with v = M (A r - t). M is the (pseudo-)inverse of sum(n p p') over all documents, so
a step of one is the reciprocal of the gradient's Lipschitz constant and the objective falls at every step, whatever the
targets; where no mixture reaches them, the steps end at the nearest one. A longer step, scaled by the documents whose
rates are above zero alone, is tried first and taken back unless it lowers the objective more than by half.

A step is one aggregation to the sums of domains and of their pairs. A document's rate is a function of its posterior and the
steps so far, so no rate is held anywhere but in the table that is written now and then to keep that function short.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import OWN, materialise, table

#: Hash buckets of the features, and domains at most: they bound the model, which is a literal of the plan (16 MB), and
#: the square matrix of the fit at the driver (8 MB).
BUCKETS, MAX_DOMAINS = 2048, 1024
#: Products that one row of a step's aggregation adds up.
CELLS = 8
#: Labelled documents of a domain to learn from, about (a hash of the id picks them from all rows).
TRAIN_DOCS = 4000
ALPHA = 0.5
#: The posterior is that of so many average features of a text; the evidence of whole texts would make it 0 or 1.
EVIDENCE = 100.0
#: Steps at most, and steps between two tables of rates. The fit ends when every domain is within TOLERANCE of all tokens,
#: or when a step lowers the objective by less than STALLED of it.
STEPS, SETTLE = 60, 12
TOLERANCE, STALLED = 1e-5, 1e-4
_log = logging.getLogger(__name__)


def words_of(text: str = "text") -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none of null."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.size(words_of(text)).cast("long")


def features(words: Column) -> Column:
    """Buckets of a text's features, from the array of its words: each word and its last two characters."""

    def bucket(x: Column, kind: int) -> Column:
        return F.pmod(F.hash(x, F.lit(kind)), F.lit(BUCKETS))

    return F.concat(
        F.transform(words, lambda w: bucket(w, 0)),
        F.transform(words, lambda w: bucket(F.right(w, F.lit(2)), 1)),
    )


def _numbers(values: list[float] | np.ndarray) -> Column:
    """A constant array, as short text that the optimizer folds to a literal."""
    return F.split(F.lit(",".join(f"{v:.4f}".rstrip("0").rstrip(".") for v in values)), ",").cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _looked_up(at: Column, values: Column) -> Column:
    """The sum of the values at these places."""
    return F.aggregate(at, F.lit(0.0), lambda a, b: a + F.get(values, b))


@dataclass
class DomainModel:
    domains: list[str]
    log_prior: list[float]
    weight: np.ndarray  # (domains, buckets): log-probabilities, less the bucket's mean

    def posterior(self, buckets: Column) -> Column:
        """Array of the domains' probabilities, from a column of features that is evaluated once; the priors without features."""

        def logits(at: Column) -> Column:
            share = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size(at), F.lit(1)))
            sums = [_looked_up(at, _numbers(w)) for w in self.weight]
            return F.array(*[F.lit(float(prior)) + share * s for prior, s in zip(self.log_prior, sums, strict=True)])

        bound = F.transform(F.array(buckets), logits)  # a lambda's argument is evaluated once
        exps = F.transform(bound, lambda z: F.transform(z, lambda a: F.exp(a - F.array_max(z))))
        return F.transform(exps, lambda e: F.transform(e, lambda a: a / _sum(e)))[0]


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DomainModel:
    """Learn from about ``train_docs`` of the documents that ``labelled`` (id, domain) gives to each domain.

    Null ids and domains teach nothing; a document of several domains teaches each; equal counts keep the order of the
    domains' names, and no result depends on the order of rows. Only ids are joined; the picked ones, MAX_DOMAINS times
    ``train_docs`` at most by expectation, are broadcast to the texts.
    """
    rows = labelled.select(F.col("id").alias("_id"), F.col("domain").alias("d")).filter("_id IS NOT NULL AND d IS NOT NULL").distinct()
    rows = rows.join(docs.select(F.col(id_col).alias("_id")), "_id")
    got = sorted(rows.groupBy("d").count().limit(MAX_DOMAINS + 1).collect(), key=lambda r: r[0])
    if len(got) > MAX_DOMAINS:
        raise ValueError(f"over {MAX_DOMAINS} domains")
    if not got:
        return DomainModel([], [], np.zeros((0, BUCKETS)))
    names, sizes = [r[0] for r in got], np.array([r[1] for r in got], float)
    rate = F.create_map(*[F.lit(x) for name, n in zip(names, sizes, strict=True) for x in (name, min(1.0, train_docs / n))])
    at = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = F.broadcast(rows.filter(at < rate[F.col("d")]).distinct())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id")
    # at most MAX_DOMAINS * BUCKETS sums come to the driver
    sums = texts.select("d", F.explode(features(words_of("_text"))).alias("b")).groupBy("d", "b").count().collect()
    counts, place = np.zeros((len(names), BUCKETS)), {d: k for k, d in enumerate(names)}
    for r in sums:
        counts[place[r["d"]], r["b"]] = r["count"]
    logs = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))
    return DomainModel([str(d) for d in names], np.log(sizes / sizes.sum()).tolist(), logs - logs.mean(axis=0))


def rate_of(p: Column, steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate of a posterior after these steps: from one, or from ``start``."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start

    def step(r: Column, v: Column) -> Column:
        return F.greatest(F.lit(0.0), r - _sum(F.zip_with(p, v, lambda a, b: a * b)))

    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in steps]), start, step)


@dataclass
class Fit:
    steps: list[list[float]] = field(default_factory=list)
    #: What the expected tokens of each domain have over its target, as shares of all tokens.
    gap: list[float] = field(default_factory=list)
    met: bool = True


def fit_rates(soft: DataFrame, weights: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Steps for documents (``n`` tokens, ``p`` posterior), so that expected domain tokens match ``weights`` of all tokens.

    The result says how far each domain is from its target. Without tokens there are no steps.
    """
    d = len(weights)
    want, fit = np.array(weights, float) / sum(weights), Fit()
    n, r, p, i, b = (F.col(c) for c in ("n", "r", "p", "i", "b"))

    def look(rated: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens, what domains have over their targets, and sum(n p p') of the documents with a rate above zero.

        A document gives a row for each domain and each CELLS domains from there on, so that a plan holds as many sums
        whatever the number of domains; d * d / CELLS rows come to the driver at most.
        """
        own = rated.select("n", "r", "p", F.posexplode("p").alias("i", "q")).select("n", "r", "p", "i", "q", F.explode(F.sequence(F.floor(i / CELLS), F.lit((d - 1) // CELLS).cast("long"))).alias("b"))
        products = [F.sum(F.when(r > 0, n * F.col("q") * F.get(p, (b * CELLS + k).cast("int")))).alias(f"c{k}") for k in range(CELLS)]
        got = own.groupBy("i", "b").agg(F.sum("n").alias("n"), F.sum(n * r * F.col("q")).alias("e"), *products).collect()
        tokens = max([float(x["n"] or 0) for x in got], default=0.0)
        gram, has, total = np.zeros((d, d)), np.zeros(d), max(tokens, 1.0)
        for x in got:
            lo, at = x["b"] * CELLS, x["i"]
            has[at] = (x["e"] or 0.0) / total
            gram[at, lo : lo + CELLS] = [(x[f"c{k}"] or 0.0) / total for k in range(min(CELLS, d - lo))]
        above = np.triu(gram)
        return tokens, has - want, above + np.triu(above, 1).T

    def inverse(gram: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(gram, rcond=1e-6, hermitian=True)

    rows, done = soft.select("n", "p", F.lit(1.0).alias("r")), 0
    total, gap, gram = look(rows)
    if not total:
        return fit
    metric = inverse(gram)
    while True:
        objective = float(gap @ metric @ gap)
        fit.gap, fit.met = gap.tolist(), bool(np.abs(gap).max() < tolerance)
        if fit.met or len(fit.steps) >= steps:
            break
        after = None
        for v, least in ((inverse(gram) @ gap, 0.5), (metric @ gap, 1 - STALLED)):
            tried = [*fit.steps, v.tolist()]
            after = look(rows.select("n", "p", rate_of(F.col("p"), tried[done:], F.col("r")).alias("r")))
            if float(after[1] @ metric @ after[1]) < least * objective:
                break
            after = None
        if after is None:  # the nearest mixture
            break
        fit.steps, (_, gap, gram) = tried, after
        if len(fit.steps) - done >= SETTLE:
            rows, done = materialise(rows.select("n", "p", rate_of(F.col("p"), fit.steps[done:], F.col("r")).alias("r"))), len(fit.steps)
    if not fit.met:
        _log.warning("no mixture meets the targets to %g within %d steps; largest gap %.3g of all tokens", tolerance, len(fit.steps), np.abs(fit.gap).max())
    return fit


def copies_of(rate: Column, id_col: str) -> Column:
    """The rate rounded up or down by a hash of the id, so that it holds in the mean."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def described(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n`` and ``p`` (under names of this library): number of words and posterior."""

    def both(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), model.posterior(features(words)).alias("p"))

    at = F.transform(F.array(words_of(text_col)), both)[0]
    return docs.select("*", at.alias(f"{OWN}at")).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{OWN}at.n").alias(f"{OWN}n"), F.col(f"{OWN}at.p").alias(f"{OWN}p"))


def _fitted(marked: DataFrame, model: DomainModel, weights: dict[str, float]) -> Fit:
    known = [weights.get(d, 0.0) for d in model.domains]
    return fit_rates(marked.select(F.col(f"{OWN}n").alias("n"), F.col(f"{OWN}p").alias("p")), known) if sum(known) else Fit()


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DomainModel, Fit]:
    """Soft mixture of ``docs`` with the classifier and the fit it is made by.

    ``labelled``: (id, domain). Domains without a weight weigh 0; without ``weights`` the production targets hold. The
    result has ``id``, ``n_tokens``, ``posterior`` (of the model's domains in order), ``rate`` and ``copies``, one row for
    each row of ``docs``: equal texts have equal rates. Empty and null texts have no tokens and the priors as posterior;
    null ids are never labelled. Without labelled rows all rates are 1 and posteriors empty; targets that no mixture
    reaches give the nearest one, and the fit's gap tells by how much it misses them.
    """
    model = learn(docs, labelled, id_col, text_col)
    if not model.domains:
        rows = docs.select(F.col(id_col), n_words(text_col).alias("n_tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
        return rows, model, Fit()
    marked = materialise(described(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(f"{OWN}text")), model, f"{OWN}text").drop(f"{OWN}text"))
    fit = _fitted(marked, model, weights or target_weights(model.domains))
    rated = marked.select(F.col(f"`{id_col}`"), F.col(f"{OWN}n").alias("n_tokens"), F.col(f"{OWN}p").alias("posterior"), rate_of(F.col(f"{OWN}p"), fit.steps).alias("rate"))
    return rated.withColumn("copies", copies_of(F.col("rate"), f"`{id_col}`")), model, fit


#: Production targets: all languages alike, nine tokens in ten of good quality.
GOOD = 0.9


def target_weights(domains: list[str]) -> dict[str, float]:
    """Weights of domains ``language/quality``."""
    return {d: GOOD if d.endswith("/1") else 1 - GOOD for d in domains}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table: language and quality of the documents that ``labels`` knows."""
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").filter("id IS NOT NULL AND lang IS NOT NULL")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality").filter("quality IS NOT NULL")
    return langs.join(marks, "id").select("id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, posterior, rate, copies."""
    return mix(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir))[0]


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document comes as often as its rate says (0 times and more); columns stay.

    Rows without an id and repeated rows have rates like others; rows of one id come equally often. Without labelled
    rows, or without tokens, the table stays as it is.
    """
    model = learn(docs, domain_labels(spark, sf_dir), "doc_id", "text")
    if not model.domains:
        return docs
    marked = materialise(described(docs, model))  # each text is read once; its copies come from what was written
    fit = _fitted(marked, model, target_weights(model.domains))

    def times(rate: Column) -> Column:
        return F.array_repeat(F.lit(1), copies_of(rate, "doc_id"))

    # the rate is a lambda's argument, so that it is worked out once
    rate = rate_of(F.col(f"{OWN}p"), fit.steps)
    return marked.select("*", F.explode(F.transform(F.array(rate), times)[0]).alias(f"{OWN}nth")).select(*[F.col(f"`{c}`") for c in docs.columns])
