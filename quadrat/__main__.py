"""Command line: python -m quadrat {csi,genetics,microscopy,radio} INPUT OUTPUT [options]; initials do as well."""

from __future__ import annotations

import argparse
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import engine, metrics
from .functions import imaging
from .functions.comparators import COMPARATORS
from .operators import clouds, kmer, linkage, signals
from .options import Options
from .sinks import text as sinks
from .sources import fasta, files

APPS = ("csi", "genetics", "microscopy", "radio")


def csi(spark: SparkSession, a: argparse.Namespace) -> None:
    """Images to a similarity matrix, edge list, linkage and flat clusters."""
    img = files.read_images(spark, a.input)
    dims = img.select("h", "w").first()
    if dims is None:
        raise SystemExit(f"no images in {a.input}")
    h, w = dims.h, dims.w
    comparator = COMPARATORS[a.comparator]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def payload(data: pa.Array) -> pa.Array:
        return pa.array([comparator.prepare(imaging.pattern(imaging.grayscale(d, h, w, a.channels))).ravel() for d in data.to_pylist()], pa.list_(pa.float64()))

    def prep(items: DataFrame) -> DataFrame:
        return items.select(F.element_at(F.split("path", "/"), -1).alias("name"), payload("data").alias("payload"))

    app = engine.Application(key="name", prep=prep, block=comparator.block(h, w, a.compat))
    keys = img.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    pairs = _run(spark, a, app, img, lambda: files.read_images(spark, a.input), False).select("i", "j", F.col("result").alias("c"))
    sinks.edge_lines(pairs).write.mode("overwrite").text(f"{a.output}/edges")
    matrix = sinks.symmetric(pairs, keys)
    sinks.write_matrix_text(matrix, f"{a.output}/matrix")
    sinks.write_matrix_binary(matrix, f"{a.output}/matrix-binary")
    sinks.write_linkage(linkage.linkage_table(pairs, a.compat), f"{a.output}/linkage")
    sinks.write_flat_clusters(linkage.flat_lines(pairs, a.threshold, a.compat), f"{a.output}/clusters")
    keys.distinct().orderBy("name").write.mode("overwrite").text(f"{a.output}/names")


def genetics(spark: SparkSession, a: argparse.Namespace) -> None:
    """FASTA files to a JSON matrix of similarities; with --compat under the name of distances, otherwise 1 - similarity."""
    docs = fasta.read_fasta(spark, a.input).select(F.element_at(F.split("path", "/"), -1).alias("name"), "seq")

    def prep(d: DataFrame) -> DataFrame:
        vecs = kmer.vectors(d, "name", "seq", a.k, a.alphabet)
        return kmer.packed(d, "name", kmer.checked(vecs, a.most_entries) if a.most_entries else vecs)

    app = engine.Application(key="doc", prep=prep, block=kmer.cosine_block, decode=kmer.decode_sparse)
    c = F.col("result") if a.compat else 1 - F.col("result")
    pairs = _run(spark, a, app, docs, lambda: fasta.read_fasta(spark, a.input), True).select("i", "j", c.alias("c"))
    sinks.write_distance_json(pairs, docs.select("name"), f"{a.output}/distances")


def microscopy(spark: SparkSession, a: argparse.Namespace) -> None:
    """Particle files to the matchings of all pairs, as JSON."""
    points = files.read_particles(spark, a.input)
    out = _run(spark, a, clouds.registration(a.scale, a.tolerance, a.iterations), points, lambda: files.read_particles(spark, a.input), True)
    sinks.matching_rows(out).write.mode("overwrite").json(f"{a.output}/matchings")


def radio(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parquet samples (station, channel, t, xr, xi, yr, yi) to visibilities."""
    signals.visibilities(spark.read.parquet(files.opened(spark, a.input))).write.mode("overwrite").parquet(f"{a.output}/visibilities")


def _options(a: argparse.Namespace, diagonal: bool) -> Options:
    return Options(strategy="tile", tile=a.tile, include_diagonal=diagonal, hilbert=a.hilbert, fail_fast=a.fail_fast)


def _run(spark: SparkSession, a: argparse.Namespace, app: engine.Application, items: DataFrame, load: Callable[[], DataFrame], diagonal: bool) -> DataFrame:
    """The results, written once below the output and read back, with what was asked of metrics."""
    options, events = _options(a, diagonal), metrics.Events()
    if a.benchmark:
        with events.of("calibration", "benchmark"):
            for stage, seconds in metrics.calibrate_application(app, items, load, options).items():
                print(f"{stage}: {seconds:.6f} s a {'pair' if stage == 'compare' else 'item'}")
    n = items.select(app.key).distinct().count() if app.key in items.columns else items.count()
    total = n * (n + 1 if diagonal else n - 1) // 2
    path = f"{a.output}/results"
    with events.of("engine", "all pairs", items=n, pairs=total):
        write = engine.all_pairs(app, items, options).write.mode("overwrite")
        if a.progress:
            with metrics.watched(spark, total, a.progress):
                write.parquet(path)
        else:
            write.parquet(path)
    if a.profile_file:
        records = metrics.filtered(events.records(spark), a.profile_ops)
        log = spark.conf.get("spark.eventLog.dir", None) if spark.conf.get("spark.eventLog.enabled", "false") == "true" else None
        if log:
            records = records.unionByName(metrics.filtered(metrics.traced(spark, log), a.profile_ops))
        sinks.write_profile(metrics.aggregate(metrics.durations(records)) if a.profile_aggregate else records, a.profile_file)
    return spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrat", description=__doc__)
    p.add_argument("app", type=lambda s: next((x for x in APPS if x == s or x[0] == s), s), choices=APPS)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--tile", type=int)
    p.add_argument("--hilbert", action="store_true")
    p.add_argument("--compat", action="store_true", help="literal behaviour where the sound default differs")
    p.add_argument("--comparator", choices=tuple(COMPARATORS), default="ncc")
    p.add_argument("--threshold", type=float, default=60.0, help="least similarity of a merge that counts for flat clusters")
    p.add_argument("--most-entries", type=int, default=0, help="fail on composition vectors of more entries; 0 allows any number")
    p.add_argument("--fail-fast", action="store_true", help="end the run at the first comparison that fails")
    p.add_argument("--partitions", type=int, help="tasks of a shuffle")
    p.add_argument("--progress", type=float, default=0.0, metavar="SECONDS", help="print share, rate and time left so often")
    p.add_argument("--benchmark", action="store_true", help="time loading, preparing and comparing on a sample first")
    p.add_argument("--profile-file", default="", help="folder for profile records; tasks are among them if Spark's event log is on")
    p.add_argument("--profile-aggregate", action="store_true", help="counts and seconds by actor and operation only")
    p.add_argument("--profile-ops", help="regular expression of the operations to keep")
    p.add_argument("--channels", default="BGR", help="order of the bytes of a pixel")
    p.add_argument("--k", type=int, default=6)
    p.add_argument("--alphabet", choices=tuple(kmer.ALPHABETS), default="protein")
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--tolerance", type=float, default=1e-15)
    p.add_argument("--iterations", type=int, default=500)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"quadrat {a.app}").getOrCreate()
    if a.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.partitions))
    globals()[a.app](spark, a)


if __name__ == "__main__":
    main()
