"""Token ids in seekable zstandard files.

Each task writes one file. Each document is an independent zstandard frame of
its token ids, little-endian and of 2 bytes if the vocabulary and its end-of-text
token fit those, otherwise of 4; the file's name says which (.u16.zst, .u32.zst). The
file ends with a seek table in a skippable frame, in the layout of the public
"Zstandard seekable format": compressed size, decompressed size and checksum of
each frame (the low 32 bits of XXH64 of the decompressed bytes), then the number
of frames, a flag byte and a magic number. So any zstandard tool can read the
whole file, and a reader that wants one document reads the table and one frame.

Every write() has a subfolder of its own, so it leaves other writes' files alone.
A task writes under a name that no other attempt uses, and only the successful
attempt's name is in the index, a Parquet table in that subfolder. Its commit is the
write's: committed() reads the indexes of finished writes only, and files of lost or
speculative attempts of this write are removed after it.

Defined results: a null text has no frame and isn't in the index; an empty text
has a frame of the end-of-text token alone; a very long text is one frame, held in
memory by its task; repeated rows and rows that share an id, or have none, have a
frame each; an empty table writes no file and has an empty index; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenization

INDEX = "doc_id long, file string, frame long, offset long, bytes long, tokens long, checksum long"
#: Ends of the names of files by the type of their ids.
SUFFIX = {"<u2": ".u16.zst", "<u4": ".u32.zst"}
_SKIPPABLE, _SEEKABLE, _CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


class FrameWriter:
    """Appends frames to a binary stream and ends it with the seek table."""

    def __init__(self, stream, dtype: str, level: int = 3) -> None:
        self.stream, self.dtype, self.at = stream, dtype, 0
        self.table: list[tuple[int, int, int]] = []
        self.packer = zstandard.ZstdCompressor(level=level)

    def append(self, ids: list[int]) -> tuple[int, int, int]:
        """Offset, size and checksum of the new frame."""
        raw = np.array(ids, self.dtype).tobytes()
        frame = self.packer.compress(raw)
        check = xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
        self.stream.write(frame)
        self.table.append((len(frame), len(raw), check))
        self.at += len(frame)
        return self.at - len(frame), len(frame), check

    def close(self) -> None:
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(body) + 9) + body + struct.pack("<IBI", len(self.table), _CHECKSUMS, _SEEKABLE))
        self.stream.close()


class FrameReader:
    """Random access to the frames of one file; reads only what is asked for."""

    def __init__(self, path: str) -> None:
        fs, name = pafs.FileSystem.from_uri(path)
        self.dtype = next((t for t, end in SUFFIX.items() if name.endswith(end)), None)
        if self.dtype is None:
            raise ValueError(f"{path} is of no known width of ids")
        self.file, self.path = fs.open_input_file(name), path
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE or not flags & _CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.checks = table[:, 0].astype(np.int64), table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, frame: int) -> np.ndarray:
        raw = self.unpacker.decompress(self.file.read_at(int(self.sizes[frame]), int(self.offsets[frame])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.checks[frame]):
            raise ValueError(f"frame {frame} of {self.path} fails its checksum")
        return np.frombuffer(raw, self.dtype)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _normal(uri: str) -> str:
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokenization.VOCABULARY, level: int = 3) -> DataFrame:
    """Write all documents below `folder`, a place that all executors share; returns the committed INDEX."""
    uri, own = _normal(_uri(folder)), f"write-{uuid.uuid4().hex}"
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenization.encoder(vocabulary).encode_ordinary, tokenization.end_of_text(vocabulary)
        dtype = "<u2" if max(end, tokenization.encoder(vocabulary).max_token_value) < 1 << 16 else "<u4"
        writer, name = None, f"{own}/part-{uuid.uuid4().hex}{SUFFIX[dtype]}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, path = pafs.FileSystem.from_uri(uri)
                fs.create_dir(f"{path}/{own}")
                writer = FrameWriter(fs.open_output_stream(f"{path}/{name}", compression=None), dtype, level)
            rows = []
            for t in batch.column(1).to_pylist():
                ids = [*encode(t), end]
                rows.append((len(writer.table), *writer.append(ids), len(ids)))
            frame, offset, size, check, tokens = (pa.array(x, pa.int64()) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(rows)), frame, offset, size, tokens, check], ["doc_id", "file", "frame", "offset", "bytes", "tokens", "checksum"])
        if writer is not None:
            writer.close()

    spark = docs.sparkSession
    base.mapInArrow(run, INDEX).write.parquet(f"{uri}/{own}/index")
    index = spark.read.schema(INDEX).parquet(f"{uri}/{own}/index")
    _remove_orphans(index, f"{uri}/{own}")
    return index


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all finished writes below folder."""
    uri = _normal(_uri(folder))
    fs, path = pafs.FileSystem.from_uri(uri)
    writes = [i.base_name for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.base_name.startswith("write-")]
    done = [w for w in sorted(writes) if fs.get_file_info(f"{path}/{w}/index/_SUCCESS").type == pafs.FileType.File]
    return spark.read.schema(INDEX).parquet(*[f"{uri}/{w}/index" for w in done]) if done else spark.createDataFrame([], INDEX)


def _remove_orphans(index: DataFrame, uri: str) -> None:
    """Delete files of this write that no successful task wrote."""
    fs, path = pafs.FileSystem.from_uri(uri)
    there = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    named = {r.file.rpartition("/")[2] for r in index.select("file").distinct().toLocalIterator()} if there else set()
    for info in there:
        if info.base_name.endswith(tuple(SUFFIX.values())) and info.base_name not in named:
            fs.delete_file(info.path)


def _frames(index: DataFrame, folder: str, convert: Callable[[list[np.ndarray]], pa.Array], kind: pa.DataType, schema: str) -> DataFrame:
    """What convert makes of the frames in the index, about 4 MB of compressed frames at a time."""
    uri = _normal(_uri(folder))

    def run(table: pa.Table) -> pa.Table:
        reader = FrameReader(f"{uri}/{table['file'][0].as_py()}")
        frames, sizes = table["frame"].to_pylist(), np.cumsum(table["bytes"].to_numpy()) >> 22
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(frames)]
        parts = [convert([reader[f] for f in frames[a:b]]) for a, b in zip(cuts, cuts[1:])]
        return pa.Table.from_arrays([table["doc_id"], pa.chunked_array(parts, kind)], schema.split()[::2])

    return index.select("doc_id", "file", "frame", "bytes").groupBy("file").applyInArrow(run, schema)


def read(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the documents in the index or any part of it, decompressing only their frames."""
    kind = pa.list_(pa.int32())
    return _frames(index, folder, lambda frames: pa.array([f.astype(np.int32) for f in frames], kind), kind, "doc_id long, ids array<int>")


def read_digests(index: DataFrame, folder: str, vocabulary: str = tokenization.VOCABULARY) -> DataFrame:
    """(doc_id, text_bytes, digest) of the texts that the frames decode to; digest: MD5 in hexadecimal."""
    kind = pa.struct([("text_bytes", pa.int64()), ("digest", pa.string())])

    def digests(frames: list[np.ndarray]) -> pa.Array:
        decode, end = tokenization.encoder(vocabulary).decode_bytes, tokenization.end_of_text(vocabulary)
        out = []
        for f in frames:
            if f[-1] != end:
                raise ValueError("a frame doesn't end with the end-of-text token")
            text = decode(f[:-1].tolist())
            out.append({"text_bytes": len(text), "digest": hashlib.md5(text).hexdigest()})
        return pa.array(out, kind)

    rows = _frames(index, folder, digests, kind, "doc_id long, r struct<text_bytes:bigint,digest:string>")
    return rows.select("doc_id", "r.text_bytes", "r.digest")
