"""Text, binary and JSON outputs of pair tables (i, j, c).

Rows whose score is null, of comparisons that failed, count as absent. Outputs are
folders of parts that tasks write; the parts in the order of their names are the file.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import positions


def symmetric(pairs: DataFrame, keys: DataFrame, fill: float = 0.0) -> DataFrame:
    """(i, j, c) of the whole matrix: both triangles, and `fill` on the diagonal. keys: one column."""
    p = pairs.where("i <> j and c is not null").select("i", "j", "c")
    k = keys.columns[0]
    diagonal = keys.select(F.col(k).alias("i"), F.col(k).alias("j"), F.lit(fill).alias("c"))
    return p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "c")).unionByName(diagonal)


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """(row, line): each row's cells as "%.6f, ", in column order."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("j", "c"))), lambda s: F.format_string("%.6f, ", s["c"]))
    return matrix.groupBy(F.col("i").alias("row")).agg(F.array_join(cells, "").alias("line"))


def edge_lines(pairs: DataFrame) -> DataFrame:
    """(line): the strict lower triangle as "row column score"."""
    return pairs.where("c is not null and i <> j").select(F.concat_ws(" ", F.col("j").cast("string"), F.col("i").cast("string"), F.format_string("%.6f", "c")).alias("line"))


def linkage_lines(linkage: DataFrame) -> DataFrame:
    """(step, line): "[n1,n2,similarity,size]"."""
    return linkage.select("step", F.format_string("[%d,%d,%f,%d]", "n1", "n2", "sim", "size").alias("line"))


def with_blank(lines: DataFrame, order: str) -> DataFrame:
    """(line) in order, and a blank line at the end."""
    end = lines.limit(0).groupBy().agg(F.lit("").alias("line"))
    both = lines.select(F.lit(0).alias("_last"), F.col(order).alias("_at"), "line").unionByName(end.select(F.lit(1).alias("_last"), "line"), allowMissingColumns=True)
    return both.orderBy("_last", "_at").select("line")


def write_matrix_text(matrix: DataFrame, path: str) -> None:
    """One line a row, rows in order, and a blank line."""
    with_blank(matrix_lines(matrix), "row").write.mode("overwrite").text(path)


def write_linkage(linkage: DataFrame, path: str) -> None:
    """One line a merge, merges in order, and a blank line."""
    with_blank(linkage_lines(linkage), "step").write.mode("overwrite").text(path)


def write_flat_clusters(lines: DataFrame, path: str) -> None:
    """lines: (pos, line) of operators.linkage.flat_lines()."""
    lines.orderBy("pos").select("line").write.mode("overwrite").text(path)


def matrix_bytes(matrix: DataFrame) -> DataFrame:
    """(row, data): each row as big-endian float64."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("j", "c"))), lambda s: s["c"])
    return matrix.groupBy(F.col("i").alias("row")).agg(cells.alias("cells")).select("row", _packer(">f8")("cells").alias("data"))


def _packer(kind: str):
    @F.arrow_udf(T.BinaryType())
    def pack(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else np.array(r, kind).tobytes() for r in rows.to_pylist()], pa.binary())

    return pack


def _write_blobs(blobs: DataFrame, folder: str, suffix: str, name: str | None = None) -> list[str]:
    """The files written below folder: one for each row if there is a column of names, otherwise one for each task, in order.

    blobs: data, and name. A task writes aside and renames, so a repeated or lost one leaves no half a file.
    """
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}"
    uri = re.sub("^file:/*", "file:///", uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base)
        task = TaskContext.get()
        aside = f"{base}/.{uuid.uuid4().hex}"
        if name is not None:
            for b in batches:
                for key, data in zip(b.column("name").to_pylist(), b.column("data").to_pylist()):
                    if data is not None:
                        with fs.open_output_stream(aside, compression=None) as f:
                            f.write(data)
                        fs.move(aside, f"{base}/{key}{suffix}")
                        yield pa.RecordBatch.from_arrays([pa.array([f"{key}{suffix}"])], ["file"])
            return
        stream = None
        for b in batches:
            for data in b.column("data").to_pylist():
                stream = stream or fs.open_output_stream(aside, compression=None)
                stream.write(data)
        if stream is not None:
            stream.close()
            part = f"part-{task.partitionId():05d}{suffix}"
            fs.move(aside, f"{base}/{part}")
            yield pa.RecordBatch.from_arrays([pa.array([part])], ["file"])

    return sorted(r.file for r in blobs.mapInArrow(run, "file string").collect())


def write_files(files: DataFrame, path: str, suffix: str = "") -> list[str]:
    """One file for each row (name, data); null data have none."""
    return _write_blobs(files.select("name", "data"), path, suffix, "name")


def write_matrix_binary(matrix: DataFrame, path: str) -> list[str]:
    """Big-endian float64, row-major, in parts; their names, whose order is that of the rows."""
    rows = matrix_bytes(matrix).repartitionByRange("row").sortWithinPartitions("row")
    return _write_blobs(rows.select("data"), path, ".bin")


def write_float_arrays(arrays: DataFrame, path: str) -> list[str]:
    """One file of big-endian float32 for each row (name, values), called name.dat; null values have none."""
    return write_files(arrays.select("name", _packer(">f4")("values").alias("data")), path, ".dat")


def distance_rows(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(i, r): each file's distances to all files in their order, -1 where there is no score; a task holds single rows."""
    k = keys.select(F.col(keys.columns[0]).alias("k"))
    p = pairs.where("c is not null").select("i", "j", "c")
    both = p.unionByName(p.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    grid = k.select(F.col("k").alias("i")).crossJoin(k.select(F.col("k").alias("j"))).join(both, ["i", "j"], "left")
    row = F.transform(F.sort_array(F.collect_list(F.struct("j", F.coalesce("c", F.lit(-1.0)).alias("c")))), lambda s: s["c"])
    return grid.groupBy("i").agg(row.alias("r"))


def distance_json(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(value): {"files": [...], "distance": [[...]]} as one string, for matrices that fit one; see write_distance_json."""
    rows = distance_rows(pairs, keys)
    all_rows = F.sort_array(F.collect_list(F.struct("i", "r")))
    whole = rows.agg(F.transform(all_rows, lambda s: s["i"]).alias("files"), F.transform(all_rows, lambda s: s["r"]).alias("distance"))
    return whole.select(F.to_json(F.struct("files", "distance")).alias("value"))


def write_distance_json(pairs: DataFrame, keys: DataFrame, path: str) -> list[str]:
    """The same document, a row of the matrix a line, in parts that make one JSON text in their order."""
    rows = distance_rows(pairs, keys)
    spark, total = rows.sparkSession, keys.count()
    line = rows.select("i", F.to_json("r").alias("t"))
    names = keys.select(F.col(keys.columns[0]).alias("i"))
    at = positions(names, "i").select("i", "pos")
    body = line.join(at, "i").select((F.col("pos") + total + 2).alias("at"), F.concat("t", F.when(F.col("pos") < total - 1, F.lit(",\n")).otherwise(F.lit("\n"))).alias("t"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("i").cast("string").alias("n"))), r"^\{\"n\":(.*)\}$", 1)
    files = at.select((F.col("pos") + 1).alias("at"), F.concat(quoted, F.when(F.col("pos") < total - 1, F.lit(",")).otherwise(F.lit(""))).alias("t"))
    frame = spark.createDataFrame([(0, '{"files":['), (total + 1, '],\n"distance":[\n'), (2 * total + 2, "]}\n")], "at long, t string")
    ordered = frame.unionByName(files).unionByName(body).repartitionByRange("at").sortWithinPartitions("at")
    return _write_blobs(ordered.select(F.encode("t", "utf-8").alias("data")), path, ".json")


def matching_rows(matchings: DataFrame) -> DataFrame:
    """Registrations as (model, scene, score, translate_x, translate_y, rotate), sorted; failed ones left out."""
    m = matchings.where("result is not null").orderBy("i", "j")
    return m.select(F.col("i").alias("model"), F.col("j").alias("scene"), "result.score", "result.translate_x", "result.translate_y", F.col("result.rotation").alias("rotate"))


def write_matching_json(matchings: DataFrame, path: str) -> None:
    matching_rows(matchings).write.json(path)


def write_profile(records: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated profile records; compression: none, gzip or bzip2."""
    records.write.csv(path, sep="\t", compression=compression)
