"""FASTA sequences: header lines begin with >, comments with # or ;."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened

SUFFIXES = "*.{faa,fasta,faa.gz,fasta.gz}"


def sequence(text: Column) -> Column:
    """Letters of a FASTA text, a newline for each header; comments and blanks are gone."""
    marked = F.regexp_replace(text, "(>)[^\n]*|[#;][^\n]*", "$1")
    return F.translate(F.regexp_replace(marked, "[ \t\n]", ""), ">", "\n")


def problem(text: Column, path: Column) -> Column:
    """Null, or what is wrong: the first character that is no upper-case letter, its line and the file.

    Lines are counted over the text without comments and headers' contents.
    """
    marked = F.regexp_replace(text, "(>)[^\n]*|[#;][^\n]*", "$1")
    before = F.regexp_extract(marked, "^([A-Z> \t\n]*)", 1)
    at = F.length(before)
    line = at - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    bad = marked.substr(at + 1, F.lit(1))
    return F.when(at < F.length(marked), F.format_string("invalid character '%s' in line %d of %s", bad, line, path))


def read_fasta(spark: SparkSession, folder: str, pattern: str = SUFFIXES, strict: bool = True) -> DataFrame:
    """(path, seq, error) of the files of a folder; gzip is recognised by content, not by name.

    With strict, an invalid file fails the query when its row is read; otherwise
    its seq is null and error says why.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(opened(spark, folder)).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c).decode("utf-8", "replace") for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "text"])

    text = files.mapInArrow(unpack, "path string, text string")
    error = problem(F.col("text"), F.col("path"))
    if strict:
        return text.select("path", F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(sequence(F.col("text"))).alias("seq"), F.lit(None).cast("string").alias("error"))
    return text.select("path", F.when(error.isNull(), sequence(F.col("text"))).alias("seq"), error.alias("error"))
