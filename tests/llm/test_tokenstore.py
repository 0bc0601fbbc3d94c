import base64
import hashlib
import io

import numpy as np
import pytest
import zstandard

from quadrat.llm import tokenization, tokenstore

from .conftest import DOCS, prose


def _stored(df, folder):
    index = tokenstore.write(df, str(folder))
    return index, {(r.doc_id, r.frame, r.file): r for r in index.collect()}


def test_round_trip(spark, tmp_path, rng):
    docs = spark.createDataFrame([(k, prose(rng, int(n)), "en", "s", 0) for k, n in enumerate(rng.integers(1, 400, 60))], DOCS).repartition(3)
    index, rows = _stored(docs, tmp_path / "t")
    assert len(rows) == 60 and _files(tmp_path / "t") == {r.file for r in rows.values()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    coder = tokenization.encoder()
    got = {r.doc_id: r.ids for r in tokenstore.read(index, str(tmp_path / "t")).collect()}
    for k, ids in got.items():
        assert ids[-1] == tokenization.END_OF_TEXT and ids[:-1] == coder.encode_ordinary(texts[k]) and coder.decode(ids[:-1]) == texts[k]
    some = tokenstore.read(index.where("doc_id in (3, 44)"), str(tmp_path / "t")).collect()
    assert {r.doc_id for r in some} == {3, 44}


def test_any_zstandard_reader_reads_the_file_and_ours_reads_one_frame(spark, tmp_path, rng):
    docs = spark.createDataFrame([(k, prose(rng, 50), "en", "s", 0) for k in range(5)], DOCS).coalesce(1)
    _, rows = _stored(docs, tmp_path / "t")
    path = tmp_path / "t" / next(iter(rows.values())).file
    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    reader = tokenstore.FrameReader(f"file://{path}")
    assert len(reader) == 5 and whole == b"".join(reader[k].tobytes() for k in range(5))
    for r in rows.values():
        assert (reader.offsets[r.frame], reader.sizes[r.frame], reader.checks[r.frame], len(reader[r.frame])) == (r.offset, r.bytes, r.checksum, r.tokens)
    reads = []
    plain = reader.file
    reader.file = type("Counted", (), {"read_at": lambda self, n, at: reads.append(n) or plain.read_at(n, at)})()
    assert len(reader[3]) and reads == [int(reader.sizes[3])]


def test_damage_is_noticed(spark, tmp_path, rng):
    docs = spark.createDataFrame([(k, prose(rng, 50), "en", "s", 0) for k in range(3)], DOCS).coalesce(1)
    _, rows = _stored(docs, tmp_path / "t")
    path = tmp_path / "t" / next(iter(rows.values())).file
    data = bytearray(path.read_bytes())
    n = 3
    at = len(data) - 9 - 12 * n + 8  # the first frame's checksum
    data[at] ^= 1
    path.write_bytes(data)
    reader = tokenstore.FrameReader(f"file://{path}")
    assert len(reader[1])
    with pytest.raises(ValueError, match="checksum"):
        reader[0]
    path.write_bytes(data[:-1] + b"x")
    with pytest.raises(ValueError, match="seek table"):
        tokenstore.FrameReader(f"file://{path}")


def _files(folder):
    return {p.relative_to(folder).as_posix() for p in folder.rglob("*.zst")}


def test_orphans_of_lost_attempts_are_removed(spark, tmp_path, rng):
    docs = spark.createDataFrame([(1, prose(rng, 50), "en", "s", 0)], DOCS)
    index, rows = _stored(docs, tmp_path / "t")
    file = next(iter(rows.values())).file
    lost = tmp_path / "t" / file.split("/")[0] / "part-lost.u16.zst"
    lost.write_bytes(b"half a file")
    tokenstore._remove_orphans(index, f"file://{lost.parent}")
    assert _files(tmp_path / "t") == {file}


def test_a_second_write_keeps_the_first(spark, tmp_path, rng):
    docs = spark.createDataFrame([(k, prose(rng, 50), "en", "s", 0) for k in range(20)], DOCS).repartition(2)
    first, rows = _stored(docs.where("doc_id < 10"), tmp_path / "t")
    second, more = _stored(docs.where("doc_id >= 10"), tmp_path / "t")
    assert _files(tmp_path / "t") == {r.file for r in [*rows.values(), *more.values()]}
    (tmp_path / "t" / "write-unfinished" / "index").mkdir(parents=True)
    index = tokenstore.committed(spark, str(tmp_path / "t"))
    assert sorted(index.collect()) == sorted(first.unionByName(second).collect())
    assert tokenstore.committed(spark, str(tmp_path / "nothing")).count() == 0
    both = tokenstore.read(index, str(tmp_path / "t")).collect()
    coder, texts = tokenization.encoder(), {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: coder.decode(r.ids[:-1]) for r in both} == texts


def test_large_vocabulary(spark, tmp_path, rng):
    """Ids beyond 16 bits, and a vocabulary in which the usual end-of-text id is a token."""
    path = tmp_path / "v.tiktoken"
    names = [bytes([k]) for k in range(256)] + [b"%c%c%c" % (97 + k % 26, 97 + k // 26 % 26, 97 + k // 676) for k in range(17576)] + [b"\x00%d" % k for k in range(60_000)]
    path.write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for k, t in enumerate(names)))
    assert tokenization.end_of_text(str(path)) == len(names) and tokenization.end_of_text() == tokenization.END_OF_TEXT == 50256
    docs = spark.createDataFrame([(1, "\x007 abc"), (2, "")], "doc_id long, text string")
    index = tokenstore.write(docs, str(tmp_path / "t"), vocabulary=str(path))
    assert all(f.endswith(".u32.zst") for f in _files(tmp_path / "t"))
    got = {r.doc_id: r.ids for r in tokenstore.read(index, str(tmp_path / "t")).collect()}
    coder = tokenization.encoder(str(path))
    assert got == {1: [*coder.encode_ordinary("\x007 abc"), len(names)], 2: [len(names)]}
    with io.BytesIO() as f:
        tokenstore.FrameWriter(f, "<u4").append([65_536, 2**31])
    (tmp_path / "x.zst").write_bytes(b"")
    with pytest.raises(ValueError, match="width"):
        tokenstore.FrameReader(f"file://{tmp_path / 'x.zst'}")


def test_digests_of_what_is_read_back(spark, tmp_path, rng):
    docs = spark.createDataFrame([(k, prose(rng, 30) + " été \u0000 日本", "en", "s", 0) for k in range(12)] + [(None, "x", None, None, None), (7, "", None, None, None), (8, None, None, None, None)], DOCS)
    got = tokenstore.read_digests(tokenstore.write(docs, str(tmp_path / "t")), str(tmp_path / "t")).collect()
    want = [(r.doc_id, len(r.text.encode()), hashlib.md5(r.text.encode()).hexdigest()) for r in docs.collect() if r.text is not None]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_odd_rows(tmp_path, odd, none):
    index = tokenstore.write(odd, str(tmp_path / "t"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.tokens) for r in index.collect())
    assert len(got) == odd.where("text is not null").count() and (False, 3, 1) in got and [g[1] for g in got].count(1) == 2
    assert np.all([r.ids[-1] == tokenization.END_OF_TEXT for r in tokenstore.read(index, str(tmp_path / "t")).collect()])
    assert tokenstore.write(none, str(tmp_path / "u")).count() == 0
