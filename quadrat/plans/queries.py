"""The catalogue of queries; quadrat.plans.oracle has the SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import engine, metrics
from ..functions import imaging as I
from ..operators import clouds, kmer, linkage, signals
from ..operators import pairs as P
from ..options import Options
from ..sinks import text as sinks
from ..sources import fasta
from . import fixtures as X
from .fixtures import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
INCLUSIVE = Options(include_diagonal=True)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Six digits; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _ij(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.select(F.col(f"i.{key}").cast("long").alias("i"), F.col(f"j.{key}").cast("long").alias("j"))


# -- pair domains


@query
def pairs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.positions(table(spark, "nation", sf_dir).select("n_nationkey"), "n_nationkey")
    return _ij(P.theta_pairs(items), "n_nationkey")


@query
def pairs_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.positions(table(spark, "nation", sf_dir).select("n_nationkey"), "n_nationkey")
    return _ij(P.theta_pairs(items, include_diagonal=True), "n_nationkey")


@query
def pairs_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.positions(table(spark, "supplier", sf_dir).select("s_suppkey"), "s_suppkey")
    return _ij(P.tile_pairs(items, 16), "s_suppkey")


@query
def tile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.positions(table(spark, "customer", sf_dir).select("c_custkey"), "c_custkey")
    return P.tiles(items, 100)


@query
def tile_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.positions(table(spark, "supplier", sf_dir).select("s_suppkey"), "s_suppkey")
    t = items.groupBy(F.expr("pos div 30").alias("t")).agg(F.count("*").alias("n"))
    a, b = t.toDF("ti", "n"), t.toDF("tj", "m")
    size = [P.rectangle_size(F.col("ti") * 30, F.col("n"), F.col("tj") * 30, F.col("m"), d) for d in (False, True)]
    return a.crossJoin(b).select("ti", "tj", size[0].alias("strict_pairs"), size[1].alias("inclusive_pairs"))


@query
def triangle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, "orders", sf_dir).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.select("o_orderpriority", "n", P.triangle_size(F.col("n")).alias("strict_pairs"), P.triangle_size(F.col("n"), True).alias("inclusive_pairs"))


@query
def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = P.positions(table(spark, "nation", sf_dir).select("n_nationkey"), "n_nationkey")
    rows = P.theta_pairs(items, include_diagonal=True).select(F.col("i.pos").alias("i"), F.col("j.pos").alias("j"))
    return rows.select("i", "j", P.hilbert_rank(F.col("i"), F.col("j"), 5).alias("hilbert"))


# -- dense comparators


def _vectors(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    e = table(spark, "embeddings", sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("payload"))
    return e if below is None else e.where(F.col("vec_id") < below)


def _dense(block: Callable) -> engine.Application:
    return engine.Application(key="vec_id", block=block)


def _scores(df: DataFrame, name: str) -> DataFrame:
    return df.select("i", "j", r6("result").alias(name))


def _all_scores(spark: SparkSession, sf_dir: str, block: Callable, name: str, decode: Callable | None = None) -> DataFrame:
    """All pairs of all vectors, which stay as short as they are stored until they are compared; six digits."""
    items = table(spark, "embeddings", sf_dir).select("vec_id", F.col("embedding").alias("payload"))
    app = engine.Application(key="vec_id", block=lambda x, y: I.rounded(block(x, y), 6), decode=decode)
    return engine.all_pairs(app, items).select("i", "j", F.col("result").alias(name))


def _centred(column: pa.Array) -> object:
    """The vectors less their means; a vector with a null has nulls only."""
    x = engine.payloads(column)
    if isinstance(x, np.ndarray):
        x = x.astype(float)
        return x - x.mean(1, keepdims=True)
    return [v if not v else [None] * len(v) if None in v else list(np.array(v, float) - np.mean(np.array(v, float))) for v in x]


@query
def emb_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_scores(spark, sf_dir, I.dot_block, "dot")


@query
def emb_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_scores(spark, sf_dir, I.cosine_block, "cosine")


@query
def emb_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_scores(spark, sf_dir, I.ncc_block, "ncc", _centred)


@query
def emb_dot_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison as a column expression over the theta join, inclusive."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return _scores(engine.all_pairs(engine.Application(key="vec_id", expression=dot), _vectors(spark, sf_dir, 200), INCLUSIVE), "dot")


@query
def pair_error_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _vectors(spark, sf_dir, 20).withColumn("payload", F.when(F.col("vec_id") != 7, F.col("payload")))

    def pair(a: list, b: list) -> float:
        return float(np.dot(np.array(a, float), np.array(b, float)))

    out = engine.all_pairs(engine.Application(key="vec_id", pair=pair), items)
    return out.select("i", "j", r6("result").alias("dot"), F.col("error").isNotNull().alias("failed"))


# -- matrices and edge lists


def _few(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    return engine.all_pairs(_dense(I.dot_block), _vectors(spark, sf_dir, n)).select("i", "j", F.round("result", 6).alias("c"))


@query
def pair_matrix_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sinks.symmetric(_few(spark, sf_dir), _vectors(spark, sf_dir, 40).select(F.col("vec_id").alias("k")))
    return m.select("i", "j", r6("c").alias("c"))


@query
def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.edge_lines(_few(spark, sf_dir).select(F.concat(F.lit("v"), "i").alias("i"), F.concat(F.lit("v"), "j").alias("j"), "c"))


@query
def matrix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.matrix_lines(sinks.symmetric(_few(spark, sf_dir), _vectors(spark, sf_dir, 40).select(F.col("vec_id").alias("k"))))


@query
def cluster_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.linkage_table(_few(spark, sf_dir, 60)).withColumn("sim", r6("sim"))


@query
def cluster_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.flat_table(_few(spark, sf_dir, 60), threshold=0.3)


# -- sequences


@query
def fasta_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, "documents", sf_dir).select("doc_id", F.length(fasta.sequence(text)).cast("long").alias("letters"), fasta.sequence(text).rlike("[^A-Z\n]").alias("invalid"))


def _docs(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    # letter by letter: upper() makes two of some letters, and k-mers of those parts
    d = table(spark, "documents", sf_dir).select("doc_id", F.translate("text", "acgt", "ACGT").alias("seq"))
    return d if below is None else d.where(F.col("doc_id") < below)


@query
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.counts(_docs(spark, sf_dir), "doc_id", "seq", 3)


@query
def kmer_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.probabilities(kmer.counts(_docs(spark, sf_dir), "doc_id", "seq", 3)).withColumn("p", r6("p"))


@query
def kmer_expect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kmer.probabilities(kmer.counts(_docs(spark, sf_dir), "doc_id", "seq", 3))
    return kmer.expectations(p, 3).withColumn("p0", r6("p0"))


@query
def kmer_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kmer.probabilities(kmer.counts(_docs(spark, sf_dir), "doc_id", "seq", 3))
    return kmer.alphas(p, kmer.expectations(p, 3), 3).withColumn("alpha", r6("alpha"))


@query
def cv_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.vectors(_docs(spark, sf_dir), "doc_id", "seq", 3).withColumn("val", r6("val"))


@query
def cv_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the first 300 documents, zeros and the diagonal included."""
    app = engine.Application(key="doc", prep=lambda d: kmer.packed(d, "doc_id", kmer.vectors(d, "doc_id", "seq", 3)), block=kmer.cosine_block, decode=kmer.decode_sparse)
    return _scores(engine.all_pairs(app, _docs(spark, sf_dir, 300), INCLUSIVE), "cosine")


@query
def cv_sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = kmer.vectors(_docs(spark, sf_dir, 100), "doc_id", "seq", 3)
    return kmer.sparse_dots(v).select("i", "j", r6("dot").alias("dot"))


@query
def cv_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return kmer.size_report(d, "doc_id", "seq", kmer.vectors(d, "doc_id", "seq", 3))


# -- images


def _pixel_query(f: Callable[[np.ndarray], np.ndarray]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        img = X.images(spark, sf_dir).select("img", X.kernel(f)("payload").alias("p"))
        return X.long_form(img, "p").withColumn("v", r6("v"))

    return run


@query
def img_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(F.abs("v") * 100000).cast("long")
    b = X.pixels(spark, sf_dir).select("img", "y", "x", (t % 256).alias("b0"), (F.floor(t / 7) % 256).alias("b1"), (F.floor(t / 11) % 256).alias("b2"))
    packed = b.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("y", "x", "b0", "b1", "b2"))).alias("p"))
    packed = packed.select("img", F.flatten(F.transform("p", lambda q: F.array(q["b0"], q["b1"], q["b2"]))).cast("array<double>").alias("p"))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def gray(column: pa.Array) -> pa.Array:
        return pa.array([I.grayscale(np.array(p, np.uint8).tobytes(), X.SIDE, X.SIDE).ravel() for p in column.to_pylist()], pa.list_(pa.float64()))

    return X.long_form(packed.select("img", gray("p").alias("p")), "p").withColumn("v", r6("v"))


QUERIES["img_gradient_x"] = _pixel_query(lambda a: I.gradient(a)[0])
QUERIES["img_gradient_y"] = _pixel_query(lambda a: I.gradient(a)[1])
QUERIES["img_divergence"] = _pixel_query(I.noise)
QUERIES["img_zeromean"] = _pixel_query(I.zero_mean)
QUERIES["img_transpose"] = _pixel_query(lambda a: a.T)
QUERIES["img_power"] = _pixel_query(I.power)
QUERIES["img_localvar"] = _pixel_query(lambda a: I.local_variance(I.power(a)))
QUERIES["img_wiener"] = _pixel_query(I.wiener)
QUERIES["img_pattern"] = _pixel_query(I.pattern)


@query
def img_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(a: np.ndarray) -> np.ndarray:
        f = I.spectrum(a)
        return np.stack([f.real, f.imag], 2)

    w = X.SIDE // 2 + 1
    img = X.images(spark, sf_dir).select("img", X.kernel(both)("payload").alias("p"))
    e = img.select("img", F.posexplode("p").alias("k", "v")).select("img", F.expr(f"k div {2 * w}").cast("int").alias("ky"), F.expr(f"k % {2 * w} div 2").cast("int").alias("kx"), (F.col("k") % 2).alias("part"), "v")
    return e.groupBy("img", "ky", "kx").agg(r6(F.max(F.when(F.col("part") == 0, F.col("v")))).alias("re"), r6(F.max(F.when(F.col("part") == 1, F.col("v")))).alias("im"))


def _spectra(img: DataFrame) -> DataFrame:
    return img.select("img", X.kernel(I.packed_spectrum)("payload").alias("payload"))


@query
def img_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda p: I._halves(p, X.SIDE, X.SIDE)[0]
    app = engine.Application(key="img", prep=_spectra, pair=lambda a, b: I.correlated(half(a), half(b), X.SIDE).ravel().tolist(), result=T.ArrayType(T.DoubleType()))
    c = engine.all_pairs(app, X.images(spark, sf_dir, 4)).select("i", "j", F.posexplode("result").alias("k", "v"))
    return c.select("i", "j", F.expr("k div 32").cast("int").alias("dy"), (F.col("k") % 32).cast("int").alias("dx"), r6("v").alias("v"))


@query
def img_pce(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = engine.Application(key="img", prep=_spectra, block=I.pce_block(X.SIDE, X.SIDE))
    return _scores(engine.all_pairs(app, X.images(spark, sf_dir, 6)), "pce")


@query
def img_pce_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = engine.Application(key="img", prep=_spectra, block=I.pce_block(X.SIDE, X.SIDE, "last", "row"))
    return _scores(engine.all_pairs(app, X.images(spark, sf_dir, 6)), "pce")


# -- point clouds


@query
def pts_rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = clouds.rigid(F.col("x"), F.col("y"), 1.0, 2.0, 0.5)
    e = X.cloud_points(spark, sf_dir)
    return e.select("particle", r6(x).alias("x"), r6(y).alias("y"))


@query
def pts_gauss_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.gauss_costs(X.cloud_points(spark, sf_dir, 12), 1.3).select("i", "j", *[r6(c).alias(c) for c in ("cost", "gx", "gy", "gtheta")])


@query
def pts_expdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.exp_dists(X.cloud_points(spark, sf_dir, 12)).select("i", "j", r6("score").alias("score"))


@query
def pts_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = clouds.registration(scale=1.0, iterations=60)
    return engine.all_pairs(app, X.cloud_points(spark, sf_dir, 5)).select("i", "j", *[r6(f"result.{c}").alias(c) for c in clouds.MATCHING.names])


@query
def pts_resample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.resample_weights(X.cloud_points(spark, sf_dir)).select("particle", r6("x").alias("x"), r6("y").alias("y"), r6("weight").alias("weight"))


# -- signals and metrics


@query
def radio_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = signals.visibilities(X.station_samples(spark, sf_dir))
    return v.select("i", "j", "channel", *[r6(c).alias(c) for c in v.columns[3:]])


@query
def profile_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, "events", sf_dir).select(F.col("user_id").alias("actor"), F.col("event_type").alias("op"), F.col("value").alias("amount"))
    return metrics.aggregate(records).withColumn("total", F.round("total", 4) + F.lit(0.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv_cosine(spark, sf_dir)
