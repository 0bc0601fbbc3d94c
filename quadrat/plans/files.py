"""Queries that write files of every kind and read them back through the sources."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import engine, metrics
from ..functions import comparators
from ..functions import imaging as I
from ..operators import kmer, linkage
from ..operators import pairs as P
from ..options import Options
from ..sinks import text as sinks
from ..sources import fasta, files
from ..storage import scratch
from . import fixtures as X
from .fixtures import table
from .queries import INCLUSIVE, _docs, _few, _scores, _vectors, query, r6


def _stem(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"([^/.]+)\.[a-z.]+$", 1)


@query
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 documents as FASTA files with a header, a comment and wrapped lines, every other one packed, read as sequences."""
    folder = scratch(spark, "fasta")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    body = F.concat(F.lit(">document "), F.col("doc_id").cast("string"), F.lit(" [x]\n;a comment\n"), F.regexp_replace(letters, "(.{60})", "$1\n"))

    @F.arrow_udf(T.BinaryType())
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else gzip.compress(t.encode()) for t in texts.to_pylist()], pa.binary())

    d = table(spark, "documents", sf_dir).where("doc_id < 60 and text is not null").select(F.col("doc_id").cast("string").alias("name"), body.alias("t"))
    sinks.write_files(d.select("name", F.when(F.col("name").cast("long") % 2 == 0, F.encode("t", "utf-8")).otherwise(packed("t")).alias("data")), folder, ".faa")
    seq = fasta.read_fasta(spark, folder)
    return seq.select(_stem().cast("long").alias("doc_id"), F.length("seq").cast("long").alias("letters"), F.md5("seq").alias("digest"))


@query
def particle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 clouds as JSON files, read as points."""
    folder = scratch(spark, "particles")
    point = F.struct("x", "y", F.col("sigma").alias("localization_uncertainty"))
    clouds = X.cloud_points(spark, sf_dir, 20).groupBy(F.col("particle").cast("string").alias("name")).agg(F.to_json(F.collect_list(point)).alias("t"))
    sinks.write_files(clouds.select("name", F.encode("t", "utf-8").alias("data")), folder, ".json")
    p = files.read_particles(spark, folder)
    return p.select(_stem("particle").cast("long").alias("particle"), r6("x").alias("x"), r6("y").alias("y"), r6("sigma").alias("sigma"))


@query
def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.station_keys(spark)


def _nations(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    folder, nations = scratch(spark, "nations"), table(spark, "nation", sf_dir)
    sinks.write_files(nations.select(F.col("n_nationkey").cast("string").alias("name"), F.encode("n_name", "utf-8").alias("data")), folder, ".txt")
    return folder, nations


@query
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names match, in the order of their names."""
    found = files.listing(spark, _nations(spark, sf_dir)[0], "1*.txt")
    return P.positions(found.select("name", "length"), "name").select("name", F.col("length").cast("long").alias("length"), F.col("pos").cast("long").alias("pos"))


@query
def keyed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of the files that each region names, in that order."""
    folder, nations = _nations(spark, sf_dir)
    names = F.transform(F.sort_array(F.collect_list("n_nationkey"), asc=False), lambda k: F.concat(k.cast("string"), F.lit(".txt")))
    keys = nations.groupBy(F.col("n_regionkey").cast("long").alias("key")).agg(names.alias("names"))
    text = F.array_join(F.transform("inputs", lambda b: F.decode(b, "utf-8")), "+")
    return files.read_with_inputs(spark, keys, folder).select("key", text.alias("contents"))


@query
def float_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "floats")
    v = table(spark, "embeddings", sf_dir).where("vec_id < 50")
    sinks.write_float_arrays(v.select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<float>").alias("values")), folder)
    a = files.read_float_arrays(spark, folder).select(_stem("name").cast("long").alias("vec_id"), F.posexplode("values").alias("k", "v"))
    return a.select("vec_id", F.col("k").cast("long").alias("k"), r6(F.col("v").cast("double")).alias("v"))


@query
def matrix_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the binary matrix, in order, as cells."""
    folder, n = scratch(spark, "matrix"), 40
    sinks.write_matrix_binary(sinks.symmetric(_few(spark, sf_dir, n), _vectors(spark, sf_dir, n).select(F.col("vec_id").alias("k"))), folder)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unpack(data: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(d, ">f8").astype(float) for d in data.to_pylist()], pa.list_(pa.float64()))

    parts = spark.read.format("binaryFile").load(folder).select("path", unpack("content").alias("v"))
    whole = parts.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("path", "v"))), lambda s: s["v"])).alias("v"))
    cells = whole.select(F.posexplode("v").alias("at", "c"))
    return cells.select(F.expr(f"at div {n}").alias("i"), (F.col("at") % n).cast("long").alias("j"), r6("c").alias("c"))


@query
def distance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the JSON matrix, in order, as cells."""
    folder, names = scratch(spark, "distances"), _vectors(spark, sf_dir, 40).select(F.format_string("v%03d", "vec_id").alias("name"))
    pairs = _few(spark, sf_dir).select(*[F.format_string("v%03d", c).alias(c) for c in "ij"], "c")
    sinks.write_distance_json(pairs, names, folder)
    parts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    text = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "value"))), lambda s: s["value"]), "").alias("t"))
    whole = text.select(F.from_json("t", "files array<string>, distance array<array<double>>").alias("d"))
    rows = whole.select("d.files", F.posexplode("d.distance").alias("i", "row")).select("files", "i", F.posexplode("row").alias("j", "c"))
    return rows.select(F.get("files", "i").alias("left"), F.get("files", "j").alias("right"), r6("c").alias("c"))


@query
def linkage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.linkage_lines(linkage.linkage_table(_few(spark, sf_dir, 60)).withColumn("sim", r6("sim")))


@query
def flat_cluster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.flat_lines(_few(spark, sf_dir, 60), 0.3)


@query
def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile records written as packed TSV, read back, filtered and aggregated."""
    folder = scratch(spark, "profile")
    e = table(spark, "events", sf_dir)
    records = e.select(F.lit("h").alias("host"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("op"), (F.col("event_id") * 1000).alias("start"), (F.col("event_id") * 1000 + F.floor(F.abs("value") * 1e6).cast("long")).alias("end"), F.lit(None).cast("string").alias("args"))
    sinks.write_profile(records, f"{folder}/p", "gzip")
    back = spark.read.schema(metrics.RECORD).csv(f"{folder}/p", sep="\t")
    out = metrics.aggregate(metrics.durations(metrics.filtered(back, ops="^(view|click)$")))
    return out.select("actor", "op", "n", r6("total").alias("total"))


@query
def pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 pairs drawn of 300: how many there are, distinct ones, and such that are pairs."""
    items = P.positions(table(spark, "nation", sf_dir).select("n_nationkey"), "n_nationkey")
    s = P.pair_sample(P.theta_pairs(items), 200)
    return s.agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("different"), F.count_if(F.col("i.pos") < F.col("j.pos")).alias("ordered"))


@query
def emb_dot_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column expression over tile joins, inclusive."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return _scores(engine.all_pairs(engine.Application(key="vec_id", expression=dot), _vectors(spark, sf_dir, 200), Options(strategy="tile", tile=64, include_diagonal=True)), "dot")


@query
def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison that isn't symmetric, of two thirds of the items and then the rest, as one batch has it."""
    items = _vectors(spark, sf_dir, 150)
    app = engine.Application(key="vec_id", block=lambda x, y: np.subtract.outer(np.asarray(x)[:, 0], 2 * np.asarray(y)[:, 1]))
    old, new = items.where("vec_id % 3 > 0"), items.where("vec_id % 3 = 0")
    out = engine.all_pairs(app, old)
    for part in engine.new_pairs(app, old, new):
        out = out.unionByName(part)
    return _scores(out, "score")


@query
def cv_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition vectors as they are emitted: checked for size and sorted by code."""
    d = _docs(spark, sf_dir)
    v = kmer.packed(d, "doc_id", kmer.checked(kmer.vectors(d, "doc_id", "seq", 3), 64))
    e = v.select("doc", F.posexplode("payload").alias("k", "e"))
    return e.select("doc", F.col("k").cast("long").alias("k"), "e.code", r6("e.val").alias("val"))


@query
def img_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparator by name, on images of zero mean."""
    ncc = comparators.COMPARATORS["ncc"]
    prep = lambda img: img.select("img", X.kernel(lambda a: ncc.prepare(I.zero_mean(a)))("payload").alias("payload"))
    return _scores(engine.all_pairs(engine.Application(key="img", prep=prep, block=ncc.block(X.SIDE, X.SIDE, False)), X.images(spark, sf_dir), INCLUSIVE), "ncc")
