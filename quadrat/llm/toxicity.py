"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Features: for every n in ORDERS the byte n-grams of the lower-cased text, in
which each non-word byte counts as a blank, hashed to 2**HASH_BITS buckets per
order; and per bucket one binary feature for each k in COUNTS, "occurs at least
k times". A feature's value is its naive Bayes log-count ratio

    r = log((p + 1/2) / toxic) - log((q + 1/2) / clean),

p and q being the toxic and clean training documents that have it. Features
seen in fewer than `least_docs` documents or whose shares in the two classes differ
by less than `least_z` standard errors are dropped, of the rest the `max_features`
that differ most are kept, and logistic regression is fitted on them, scaled.

Training uses a bounded sample of labelled rows: at most `max_toxic` and
`max_clean` documents, taken by the hash of the id after each document's labels are
made one; it holds their whole texts in one task. Scoring reads every byte of
every document, keeps no state between rows and shuffles nothing.

Defined results: a null text has a null score and isn't toxic; an empty text
scores the intercept; a very long text is scored whole; a score at the threshold is
toxic; a label above 0 is toxic, any other clean; labels that are null or whose
document is missing are ignored; of several labels of one document the largest
counts; with no label of either class every score is 0. Repeated rows get equal
scores, and all rows that share a labelled id are trained on. An empty table has no
rows. Other columns of the documents, whatever their names, pass drop_toxic()
untouched; detect() doesn't carry them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

ORDERS = (4, 6, 8)
COUNTS = (1, 2, 4)
HASH_BITS = 20
MAX_FEATURES = 20_000


def _grams(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: its number, the document of each n-gram, and its bucket."""
    text = np.where(tokens._IS_WORD[buf], buf, 32).astype(np.uint8)
    s = tokens.prefix_hash(text)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    _, inverse = tokens._powers(len(s))
    for o, k in enumerate(ORDERS):
        n = len(text) - k + 1
        if n <= 0:
            continue
        inside = doc[:n] == doc[k - 1 :]
        h = (s[k:] - s[:n]) * inverse[:n]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(tokens._PRIME) >> np.uint64(64 - HASH_BITS)
        yield o, doc[:n][inside], h[inside].astype(np.int64)


def _features(buf: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all features that occur; only of kept buckets if given."""
    docs, feats = [], []
    for o, doc, h in _grams(buf, offsets):
        if kept is not None:
            hit = kept[o][h]
            doc, h = doc[hit], h[hit]
        key = (doc.astype(np.int64) << HASH_BITS) | h
        key.sort()
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(edge, append=len(key))
        key = key[edge]
        for c, least in enumerate(COUNTS):
            at = key[n >= least]
            docs.append(at >> HASH_BITS)
            feats.append((at & ((1 << HASH_BITS) - 1)) + ((o * len(COUNTS) + c) << HASH_BITS))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(docs), np.concatenate(feats)


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = 400, least_docs: int = 4, least_z: float = 5.0, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept) with the ratios folded into the weights."""
    none = np.empty(0, np.int64), np.empty(0), -30.0
    y = toxic.astype(float)
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        return none
    size = (len(ORDERS) * len(COUNTS)) << HASH_BITS
    p, q = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for a, b, buf, off in tokens.blocks(texts):
        d, f = _features(buf, off, None)
        is_toxic = y[a:b][d] > 0
        np.add.at(p, f[is_toxic], np.float32(1))
        np.add.at(q, f[~is_toxic], np.float32(1))
    often = np.flatnonzero(p + q >= least_docs)
    p, q = p[often].astype(float), q[often].astype(float)
    ratio = np.log((p + 0.5) / pos) - np.log((q + 0.5) / neg)
    mean = (p + q) / len(y)
    spread = np.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg))
    z = np.divide(np.abs(p / pos - q / neg), spread, out=np.zeros(len(p)), where=spread > 0)
    best = np.flatnonzero(z > least_z)
    if len(best) > max_features:
        best = np.sort(best[np.argsort(-z[best], kind="stable")[:max_features]])
    chosen, ratio = often[best], ratio[best]
    if not len(chosen):
        return none
    kept = _mask(chosen)
    docs, feats = [], []
    for a, _, buf, off in tokens.blocks(texts):
        d, f = _features(buf, off, kept)
        at = np.searchsorted(chosen, f)
        same = chosen[np.minimum(at, len(chosen) - 1)] == f
        docs.append(d[same] + a)
        feats.append(at[same])
    d, f = np.concatenate(docs), np.concatenate(feats)
    x = ratio[f]
    n, k = len(y), len(chosen)
    w, b = np.zeros(k), float(np.log(pos / neg))
    seen_w, seen_b = np.full(k, 1e-8), 1e-8
    for _ in range(steps):
        score = np.bincount(d, x * w[f], n) + b
        err = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        gw, gb = np.bincount(f, x * err[d], k) / n + 1e-4 * w, err.mean()
        seen_w += gw * gw
        seen_b += gb * gb
        w -= 0.1 * gw / np.sqrt(seen_w)
        b -= 0.1 * gb / np.sqrt(seen_b)
    return chosen, w * ratio, b


def _mask(features: np.ndarray) -> np.ndarray:
    kept = np.zeros((len(ORDERS), 1 << HASH_BITS), bool)
    kept[(features >> HASH_BITS) // len(COUNTS), features & ((1 << HASH_BITS) - 1)] = True
    return kept


def score(texts: pa.Array, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    features, weights, intercept = model
    out = np.full(len(texts), intercept, float)
    if len(features):
        kept = _mask(features)
        for a, b, buf, off in tokens.blocks(texts):
            d, f = _features(buf, off, kept)
            at = np.minimum(np.searchsorted(features, f), len(features) - 1)
            same = features[at] == f
            out[a:b] += np.bincount(d[same], weights[at[same]], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 3000, max_clean: int = 6000, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit in one task on a bounded sample; only the model comes to the driver."""
    lab = labels.select(F.col(id_col).alias("i"), (F.col("toxic") > 0).cast("int").alias("y")).where("i is not null and y is not null")
    lab = lab.groupBy("i").agg(F.max("y").alias("y"))  # before the bounds, so that no label is taken for the only one
    part = [lab.where(c).orderBy(F.xxhash64("i"), "i").limit(n) for c, n in (("y = 1", max_toxic), ("y = 0", max_clean))]
    sample = part[0].unionByName(part[1])
    texts = docs.select(F.col(id_col).alias("j"), F.col(text_col).alias("t")).where("t is not null")
    rows = texts.join(F.broadcast(sample), F.col("i") == F.col("j")).select("j", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("j", pa.int64()), ("t", pa.string()), ("y", pa.int64())]))
        got = got.sort_by([("j", "ascending"), ("t", "ascending")])
        f, w, b = fit(got["t"].combine_chunks(), got["y"].to_numpy(), max_features=max_features)
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.list_(pa.int64())), pa.array([w], pa.list_(pa.float64())), pa.array([float(b)])], ["f", "w", "b"])

    rows = rows.select(F.col("j").cast("long"), "t", F.col("y").cast("long"))
    one = rows.repartition(1).mapInArrow(run, "f array<long>, w array<double>, b double").first()
    if one is None:  # no labelled document at all
        return fit(pa.array([], pa.string()), np.empty(0))
    return np.array(one.f, np.int64), np.array(one.w, float), one.b


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], out: str, text_col: str = "text") -> DataFrame:
    """docs with the probability of being toxic in the new column `out`."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts, box.value), pa.float64())

    p = probability(F.col(text_col))
    return docs.withColumn(out, F.when(F.col(text_col).isNotNull(), p))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """One row (doc_id, score, toxic) for each document row."""
    model = train(docs, labels, id_col, text_col, **training)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(base, model, "score").select("doc_id", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    model = train(docs, labels, id_col, text_col, **training)
    name = common.fresh(docs, "toxicity")[0]
    return scored(docs, model, name, text_col).where(F.coalesce(F.col(name) < threshold, F.lit(True))).drop(name)
