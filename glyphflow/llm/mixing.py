"""Mixing to target weights by soft membership.

A classifier learned from a labelled table gives each document posteriors over domains
(the label combinations). Each document gets a nonnegative rate, its expected number of
copies, such that the expected tokens of each domain (rate * tokens * posterior, summed)
meet the targets, with rates as near to 1 as that allows. The fit is least squares by
projected gradient: a pass over the staged posteriors sums one number per domain; the
next rate of a document follows from the short history of those sums, so nothing per
document is kept between passes, and nothing per document reaches the driver.

The classifier (multinomial naive Bayes over hashed distinct words) is fitted on at most
MAX_LABELLED labelled documents, those with the smallest hash of the id. All other
figures cover every row.

Defined cases: a null or empty text has no tokens, prior posteriors and rate 1; without
labelled rows there is one domain "all"; a domain without tokens cannot meet a target and
is left out of the fit, and where PASSES steps do not meet the targets the last ones stand;
a label with a null is ignored, repeated labels count once each; rows that share an id have
each the rate of its own text; an empty table gives an empty table; further columns are
ignored by ``mix`` and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.kernels import Bytes, slices
from glyphflow.plans.staging import Workspace

BUCKETS = 1 << 16
MAX_LABELLED = 8000
PASSES, TOLERANCE = 60, 1e-9


def _distinct_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per row, row of each distinct hashed word, its bucket)."""
    words = Bytes(col).words()
    bucket = (words.hash >> np.uint64(48)).astype(np.int64)
    pair = np.unique(words.row * BUCKETS + bucket)
    return np.diff(words.first), pair // BUCKETS, pair % BUCKETS


class Classifier:
    """log-posterior weights per bucket and domain, and log priors."""

    def __init__(self, names: list[str], weights: np.ndarray, prior: np.ndarray):
        self.names, self.weights, self.prior = names, weights, prior

    def posteriors(self, rows: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.tile(self.prior, (rows, 1))
        for k in range(len(self.names)):
            out[:, k] += np.bincount(row, self.weights[bucket, k], rows)
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            n, row, bucket = _distinct_words(part.column(1))
            at = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], ["domain", "buckets"])


def fit_classifier(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    """docs: doc_id, text. labels: doc_id, domain."""
    known = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").select("doc_id", "domain").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    rows = docs.join(F.broadcast(sample), "doc_id").select("domain", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_features, "domain string, buckets array<int>")
    # bucket -1 counts the documents; what reaches the driver is at most a number for each domain and bucket
    each = rows.select("domain", F.explode(F.array_append("buckets", F.lit(-1))).alias("bucket")).groupBy("domain", "bucket").count().toArrow()
    names = sorted(set(each.column("domain").to_pylist())) or ["all"]
    at = {x: k for k, x in enumerate(names)}
    domain = np.array([at[x] for x in each.column("domain").to_pylist()], np.int64)
    bucket, n = each.column("bucket").to_numpy().astype(np.int64), each.column("count").to_numpy()
    count, size = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    count[bucket[bucket >= 0], domain[bucket >= 0]] = n[bucket >= 0]
    size[domain[bucket < 0]] = n[bucket < 0]
    # the share of a domain's documents with the word, against that of all, for words that tell
    share = (count + 0.1) / (size + 0.2)
    whole = (count.sum(1, keepdims=True) + 0.1) / (size.sum() + 0.2)
    weights = np.where(count.sum(1, keepdims=True) >= 3, np.log(share / whole), 0.0)
    weights[np.abs(weights) < 0.5] = 0.0
    return Classifier(names, weights, np.log((size + 1) / (size.sum() + len(names))))


def _score(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, row, bucket = _distinct_words(part.column(1))
                p = model.posteriors(len(n), row, bucket)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), flat, part.column(2)], ["doc_id", "n_tokens", "posterior", "of_text"])

    return run


def _rates(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(p))
    for step in history:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def _sums(history: list[np.ndarray], domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(domains), np.zeros((domains, domains))
        for batch in batches:
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)
            w = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            rate = _rates(p, history)
            total += (w * rate) @ p
            gram += (p * (w * (rate > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()]), "gram": pa.array([gram.ravel().tolist()])})

    return run


def fit_rates(scored: DataFrame, targets: np.ndarray, domains: int, passes: int = PASSES) -> list[np.ndarray]:
    """The history of steps whose replay gives each document's rate.

    The metric of the projection is tokens * identity, and the residual is preconditioned
    by the domains' Gram matrix, so that without a rate at 0 one step solves the problem.
    The sums come back as one row per partition, added over at most a few thousand rows.
    """
    history: list[np.ndarray] = []
    for _ in range(passes):
        each = scored.select("n_tokens", "posterior").mapInArrow(_sums(history, domains), "total array<double>, gram array<double>")
        added = each.select(F.posexplode(F.concat("total", "gram")).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        flat = np.array([r.x for r in sorted(added, key=lambda r: r.k)]) if added else np.zeros(domains * (domains + 1))
        total, gram = flat[:domains], flat[domains:].reshape(domains, domains)
        use = (np.diag(gram) > 0) & np.isfinite(targets)
        gap = np.where(use, total - np.nan_to_num(targets), 0.0)
        if not use.any() or np.abs(gap).max() <= TOLERANCE * max(1.0, np.nansum(np.abs(targets))):
            break
        g = gram[np.ix_(use, use)]
        step = np.zeros(domains)
        step[use] = np.linalg.solve(g + 1e-9 * np.trace(g) * np.eye(len(g)), gap[use])
        history.append(step)
    return history


def _with_rates(history: list[np.ndarray], domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(p, history))], ["doc_id", "n_tokens", "posterior", "of_text", "rate"])

    return run


def label_domains(labels: DataFrame) -> DataFrame:
    """The labels table's domains: toxic, else by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


#: Share of its tokens that each domain keeps; a domain not named keeps all.
KEEP = {"toxic": 0.1, "poor": 0.5, "good": 1.0}


def mix(docs: DataFrame, labels: DataFrame, keep: dict[str, float] | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, posteriors, rate and copies.

    labels: doc_id, domain. targets: tokens per domain; by default each domain's own
    tokens times its share in keep. copies is the rate rounded up or down by a hash of the
    id, so that its expectation is the rate and a rerun gives the same.
    """
    return _mixed(docs, labels, keep, targets).drop("of_text")


def _mixed(docs: DataFrame, labels: DataFrame, keep: dict[str, float] | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """What mix gives, with the hash of the text."""
    ws = Workspace(docs.sparkSession, "mixing")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("of_text", F.xxhash64("text"))
    model = fit_classifier(d, labels)
    m = len(model.names)
    scored = ws.keep(d.mapInArrow(_score(model), "doc_id long, n_tokens long, posterior array<double>, of_text long"))
    if targets is None:
        now = scored.select(F.posexplode("posterior").alias("k", "p"), "n_tokens").groupBy("k").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("x")).collect()
        own = {r.k: r.x for r in now}
        goal = np.array([own.get(k, 0.0) * (KEEP if keep is None else keep).get(x, 1.0) for k, x in enumerate(model.names)])
    else:
        goal = np.array([targets.get(x, np.nan) for x in model.names])
    history = fit_rates(scored, goal, m)
    rated = scored.mapInArrow(_with_rates(history, m), "doc_id long, n_tokens long, posterior array<double>, of_text long, rate double")
    unit = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    out = rated.withColumn("copies", F.floor(F.col("rate") + 1e-6 + (1 - 1e-6) * unit).cast("long"))
    for k, name in enumerate(model.names):
        out = out.withColumn(f"p_{name}", F.col("posterior")[k])
    return ws.finish(out.drop("posterior"))


def apply_mix(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs by their copies (none, one or more), with all columns."""
    own = _mixed(docs, labels, **how).where("copies <> 1").select(F.col("doc_id").alias("its_id"), F.col("of_text").alias("its_text"), "copies").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    of_text = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    more = rows.join(own, F.col("row.doc_id").eqNullSafe(F.col("its_id")) & (of_text == F.col("its_text")), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return more.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
