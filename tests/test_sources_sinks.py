import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat import metrics
from quadrat.operators import clouds, kmer, linkage, signals
from quadrat.sinks import text as sinks
from quadrat.sources import fasta, files


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one # x\nACG\nT A\n;note\n>two\nGG")
    (tmp_path / "b.faa").write_bytes(gzip.compress(b">x\nAC"))
    (tmp_path / "c.txt").write_text("no")
    rows = fasta.read_fasta(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.seq for r in rows] == ["\nACGTA\nGG", "\nAC"]


def test_bad_fasta(spark, tmp_path):
    (tmp_path / "bad.fasta").write_text(">h\nAcG")
    row = fasta.read_fasta(spark, str(tmp_path), strict=False).first()
    assert row.seq is None and "'c'" in row.error and "line 2" in row.error and "bad.fasta" in row.error
    with pytest.raises(Exception, match="invalid character"):
        fasta.read_fasta(spark, str(tmp_path)).collect()


def test_kmers_by_hand(spark):
    d = spark.createDataFrame([("a", "ACG#ACG"), ("b", "###"), ("c", "ACACAC"), ("e", "")], "doc string, seq string")
    c = {(r.doc, r.n, r.code): r.cnt for r in kmer.counts(d, "doc", "seq", 3).collect()}
    assert c["a", 3, 0 * 16 + 1 * 4 + 2] == 2 and len([k for k in c if k[:2] == ("a", 3)]) == 1
    assert not [k for k in c if k[0] in "be"]
    v = {(r.doc, r.code): r.val for r in kmer.vectors(d, "doc", "seq", 3).collect()}
    norms = {}
    for (doc, _), x in v.items():
        norms[doc] = norms.get(doc, 0) + x * x
    assert all(n == pytest.approx(1) for n in norms.values())


def _python_vectors(seq, k, letters):
    def probs(n):
        mers = [seq[i : i + n] for i in range(len(seq) - n + 1)]
        mers = [m for m in mers if all(c in letters for c in m)]
        return {m: mers.count(m) / len(mers) for m in set(mers)}

    p, q, r = probs(k), probs(k - 1), probs(k - 2)
    out = {}
    for a in q:
        for b in q:
            if a[1:] == b[:-1] and a[1:] in r:
                p0 = q[a] * q[b] / r[a[1:]]
                alpha = (p.get(a + b[-1], 0) - p0) / p0
                if alpha:
                    out[a + b[-1]] = alpha
    norm = sum(x * x for x in out.values()) ** 0.5
    return {m: x / norm for m, x in out.items()}


def test_vectors_against_python(spark):
    rng = np.random.default_rng(5)
    for alphabet, k in (("dna", 3), ("dna", 5), ("protein", 3)):
        letters = kmer.ALPHABETS[alphabet]
        seq = "".join(rng.choice(list(letters + "*"), 300))
        want = _python_vectors(seq, k, letters)
        code = lambda m: sum(letters.index(c) * len(letters) ** (len(m) - 1 - i) for i, c in enumerate(m))
        d = spark.createDataFrame([(1, seq)], "doc long, seq string")
        got = {r.code: r.val for r in kmer.vectors(d, "doc", "seq", k, alphabet).collect()}
        want = {code(m): x for m, x in want.items()}
        assert set(want) - {c for c, x in want.items() if abs(x) < 1e-12} <= set(got)
        assert all(got[c] == pytest.approx(want.get(c, 0), abs=1e-9) for c in got)


def test_codes_need_64_bits(spark):
    assert kmer.most_k("protein") == 14 and kmer.most_k("dna") == 31
    got = spark.createDataFrame([("X" * 14,)], "m string").select(kmer.code(F.col("m"), "protein")).first()[0]
    assert got == 21**14 - 1
    with pytest.raises(ValueError):
        kmer.counts(spark.createDataFrame([(1, "A")], "d long, s string"), "d", "s", 2)


def test_images_and_listing(spark, tmp_path):
    jpeg = bytes.fromhex("ffd8ffe000104a46494600010100000100010000ffdb004300" + "01" * 64 + "ffc0000b080001000101011100ffc4001f0000010501010101010100000000000000000102030405060708090a0bffda0008010100003f00d2cf20ffd9")
    (tmp_path / "x.jpg").write_bytes(jpeg)
    (tmp_path / "a.JPG").write_bytes(jpeg)
    assert [r.name for r in files.listing(spark, str(tmp_path), "*.[jJ][pP][gG]").collect()] == ["a.JPG", "x.jpg"]


def test_addresses(tmp_path):
    assert files.address("/data/x") == "/data/x" and files.address("file:/x") == "file:/x"
    assert files.address("s3:/etc/cred.json:host/bucket/dir") == "s3a://bucket/dir"
    with pytest.raises(ValueError):
        files.address("ftp2:/x")


def test_particles_and_registration(spark, tmp_path):
    for name, shift in (("a.json", 0.0), ("b.json", 0.5)):
        pts = [{"x": x + shift, "y": x * x, "localization_uncertainty": 0.1} for x in (-1.0, -0.5, 0.0, 0.7, 1.2)]
        (tmp_path / name).write_text(json.dumps(pts))
    points = files.read_particles(spark, str(tmp_path))
    assert points.count() == 10 and {r.particle for r in points.collect()} == {"a.json", "b.json"}
    from quadrat import engine

    out = engine.all_pairs(clouds.registration(iterations=100), points)
    rows = sinks.matching_rows(out).collect()
    assert len(rows) == 1 and rows[0].model == "a.json" and rows[0].translate_x == pytest.approx(0.5, abs=1e-2)


def test_inputs_of_several_files(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"1")
    (tmp_path / "q").write_bytes(b"2")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p").write_bytes(b"3")
    keys = spark.createDataFrame([("k", ["q", "p"]), ("l", ["sub/p", "p"])], "key string, names array<string>")
    got = {r.key: [bytes(x) for x in r.inputs] for r in files.read_with_inputs(spark, keys, str(tmp_path)).collect()}
    assert got == {"k": [b"2", b"1"], "l": [b"3", b"1"]}


def _pairs(spark):
    return spark.createDataFrame([("a", "b", 0.5), ("a", "c", None), ("b", "c", -0.25)], "i string, j string, c double")


def test_matrix_sinks(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    m = sinks.symmetric(_pairs(spark).where("c is not null"), keys).unionByName(spark.createDataFrame([("a", "c", 0.0), ("c", "a", 0.0)], "i string, j string, c double"))
    lines = [r.line for r in sinks.matrix_lines(m).orderBy("row").collect()]
    assert lines[0] == "0.000000, 0.500000, 0.000000, "
    parts = sinks.write_matrix_binary(m, str(tmp_path / "m"))
    data = b"".join((tmp_path / "m" / x).read_bytes() for x in parts)
    assert np.array_equal(np.frombuffer(data, ">f8").reshape(3, 3), [[0, 0.5, 0], [0.5, 0, -0.25], [0, -0.25, 0]])
    sinks.write_matrix_text(m, str(tmp_path / "t"))
    assert _text(tmp_path / "t") == [*lines, ""]
    assert sorted(r.line for r in sinks.edge_lines(_pairs(spark)).collect()) == ["b a 0.500000", "c b -0.250000"]
    d = json.loads(sinks.distance_json(_pairs(spark), keys).first().value)
    assert d == {"files": ["a", "b", "c"], "distance": [[-1.0, 0.5, -1.0], [0.5, -1.0, -0.25], [-1.0, -0.25, -1.0]]}
    for n, k in enumerate((keys, keys.select(F.concat(F.lit('q"'), "k").alias("k")))):
        parts = sinks.write_distance_json(_pairs(spark), k, str(tmp_path / f"d{n}"))
        e = json.loads("".join((tmp_path / f"d{n}" / x).read_text() for x in parts))
        assert e["files"] == [('q"' if n else "") + x for x in "abc"] and (n or e["distance"] == d["distance"])


def _text(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


def test_float_arrays_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.5, -2.0]), ("b", []), ("c", None)], "name string, values array<float>")
    assert sinks.write_float_arrays(df, str(tmp_path / "f")) == ["a.dat", "b.dat"]
    assert (tmp_path / "f" / "a.dat").read_bytes() == np.array([1.5, -2.0], ">f4").tobytes()
    assert {r.name: r["values"] for r in files.read_float_arrays(spark, str(tmp_path / "f")).collect()} == {"a.dat": [1.5, -2.0]}


def test_flat_cluster_text(spark, tmp_path):
    p = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.2)], "i long, j long, c double")
    sinks.write_flat_clusters(linkage.flat_lines(p, 0.5), str(tmp_path / "c"))
    assert _text(tmp_path / "c") == ["flat clustering:", "2=[2]", "3=[0, 1]", "", "labels:", "[2 2 1 ]", ""]
    sinks.write_linkage(linkage.linkage_table(p), str(tmp_path / "l"))
    assert _text(tmp_path / "l") == ["[0,1,0.900000,2]", "[3,2,0.150000,3]", ""]
    grouped = p.withColumn("g", F.lit("x")).unionByName(p.withColumns({"g": F.lit("y"), "c": -F.col("c")}))
    assert {(r.g, r.step) for r in linkage.linkage_table(grouped, group="g").collect()} == {("x", 0), ("x", 1)}
    assert {(r.g, r.item, r.label) for r in linkage.flat_table(grouped, 0.5, group="g").collect()} == {("x", 0, 1), ("x", 1, 1), ("x", 2, 2), ("y", 0, 1), ("y", 1, 2), ("y", 2, 3)}


def test_symbolic_links(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.faa").write_text(">x\nAC")
    (tmp_path / "link").symlink_to(tmp_path / "data")
    (tmp_path / "data" / "b.faa").symlink_to(tmp_path / "data" / "a.faa")
    assert files.link_target(str(tmp_path / "link")) == str(tmp_path / "data") and files.link_target(str(tmp_path / "data")) is None
    assert files.resolve(str(tmp_path / "link")) == str(tmp_path / "data") == files.resolve(f"file://{tmp_path}/link")
    assert files.resolve("s3a://b/x") == "s3a://b/x"
    assert [r.seq for r in fasta.read_fasta(spark, str(tmp_path / "link")).collect()] == ["\nAC"] * 2
    assert [(r.name, r.length) for r in files.listing(spark, str(tmp_path / "link")).collect()] == [("a.faa", 5), ("b.faa", 5)]


def test_credentials_are_set_where_a_key_is_opened(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"hosts": {"h": {"url": "http://u", "accessKey": "k", "secretKey": "s"}}}))
    assert files.opened(spark, f"s3:{tmp_path}/c.json:h/bucket/x") == "s3a://bucket/x"
    assert spark._jsc.hadoopConfiguration().get("fs.s3a.access.key") == "k"
    with pytest.raises(ValueError, match="no host"):
        files.opened(spark, f"s3:{tmp_path}/c.json:other/bucket/x")


def test_command_line_on_sequences(spark, tmp_path, capsys):
    from quadrat import __main__ as cli

    for name, seq in (("a.faa", "ACDEFGHIKACDEFG"), ("b.faa", "ACDEFGHIKACDEFGH"), ("c.faa", "KLMNPQRSTVWYKLM")):
        (tmp_path / name).write_text(f">x\n{seq}")
    a = cli.parser().parse_args(["g", str(tmp_path), str(tmp_path / "out"), "--k", "3", "--progress", "0.2", "--profile-file", str(tmp_path / "profile"), "--profile-ops", "pairs", "--most-entries", "50"])
    cli.genetics(spark, a)
    d = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out" / "distances").glob("part-*"))))
    assert d["files"] == ["a.faa", "b.faa", "c.faa"] and d["distance"][0][1] < d["distance"][0][2] and abs(d["distance"][1][1]) < 1e-9
    assert "100.0% of 6 pairs" in capsys.readouterr().out
    assert "all pairs" in spark.read.csv(str(tmp_path / "profile"), sep="\t").first()[2]


def test_size_check(spark):
    v = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.5), ("b", 1, 1.0)], "doc string, code long, val double")
    assert [(r.doc, r.code) for r in kmer.checked(v, 2).collect()] == [("a", 1), ("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="vector of a"):
        kmer.checked(v, 1).collect()


@pytest.mark.parametrize("cells", [kmer.CELLS, 8])
def test_sparse_blocks_against_dense(monkeypatch, cells):
    """Common and rare codes, in one or many steps."""
    monkeypatch.setattr(kmer, "CELLS", cells)
    monkeypatch.setattr(kmer, "PRODUCTS", cells)
    rng = np.random.default_rng(0)
    for n, m, codes, share in ((7, 5, 40, 0.5), (30, 20, 2000, 0.01), (3, 3, 5, 0.0), (0, 4, 9, 0.5), (12, 12, 300, 0.1)):
        dense = [rng.random((r, codes)) * (rng.random((r, codes)) < share) for r in (n, m)]
        sides = []
        for d in dense:
            row, code = np.nonzero(d)
            off = np.searchsorted(row, np.arange(len(d) + 1))
            sides.append(kmer.Sparse(off, code.astype(np.int64) * 10**12, d[row, code]))
        assert np.allclose(kmer.cosine_block(*sides), dense[0] @ dense[1].T)
        if n > 3:
            assert np.allclose(kmer.cosine_block(sides[0][2:3], sides[1]), dense[0][2:3] @ dense[1].T)


def test_linkage_tables(spark):
    p = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.1), (1, 2, 0.2)], "i long, j long, c double")
    rows = linkage.linkage_table(p).orderBy("step").collect()
    assert (rows[0].n1, rows[0].n2, rows[0].size) == (0, 1, 2)
    assert {r.item: r.label for r in linkage.flat_table(p, 0.5).collect()} == {0: 1, 1: 1, 2: 2}
    assert sinks.linkage_lines(linkage.linkage_table(p)).orderBy("step").first().line == "[0,1,0.900000,2]"
    negative = p.withColumn("c", F.lit(-1.0))
    assert linkage.linkage_table(negative).count() == 0 and linkage.flat_table(negative, 0.5).count() == 3


def test_visibilities_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = (rng.random((3, 2, 5)) + 1j * rng.random((3, 2, 5)) for _ in "xy")
    rows = [(s, c, t, *(float(v) for v in (x[s, c, t].real, x[s, c, t].imag, y[s, c, t].real, y[s, c, t].imag))) for s in range(3) for c in range(2) for t in range(5)]
    df = spark.createDataFrame(rows, "station long, channel long, t long, xr double, xi double, yr double, yi double")
    out = signals.visibilities(df).collect()
    assert len(out) == 12
    for r in out:
        assert complex(r.xy_re, r.xy_im) == pytest.approx((x[r.i, r.channel] * np.conj(y[r.j, r.channel])).sum())


def test_metrics(spark, tmp_path):
    rec = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 5.0)], "actor string, op string, amount double")
    assert {(r.actor, r.n, r.total) for r in metrics.aggregate(rec).collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}
    sinks.write_profile(rec, str(tmp_path / "p"), "gzip")
    assert spark.read.csv(str(tmp_path / "p"), sep="\t").count() == 3
    runs = []
    assert metrics.calibrate({"s": lambda: runs.append(1)}, least_seconds=0.0, least_runs=3)["s"] >= 0 and len(runs) == 4
    assert "50.0%" in metrics.progress(5, 10, 1.0)


def test_traces_and_filters(spark, tmp_path):
    events = metrics.Events()
    with events.of("engine", "compare", pairs=3):
        pass
    with pytest.raises(ZeroDivisionError), events.of("engine", "load"):
        1 / 0
    rec = events.records(spark)
    assert [r.op for r in metrics.filtered(rec, ops="^comp").collect()] == ["compare"] and metrics.filtered(rec, actors="x").count() == 0
    assert metrics.aggregate(metrics.durations(rec)).count() == 2
    task = {"Event": "SparkListenerTaskEnd", "Stage ID": 4, "Task Info": {"Host": "h", "Executor ID": "1", "Task ID": 9, "Launch Time": 5, "Finish Time": 8}}
    (tmp_path / "log").write_text(json.dumps({"Event": "SparkListenerJobStart"}) + "\n" + json.dumps(task) + "\n")
    assert [tuple(r) for r in metrics.traced(spark, str(tmp_path / "log")).collect()] == [("h", "executor 1", "stage 4", 5_000_000, 8_000_000, "task 9")]


def test_calibration_of_an_application(spark):
    from quadrat import engine

    items = spark.createDataFrame([(k, float(k)) for k in range(30)], "k long, payload double")
    app = engine.Application(key="k", prep=lambda d: d.withColumn("payload", F.col("payload") + 1), pair=lambda a, b: a * b)
    took = metrics.calibrate_application(app, items, lambda: items, sample=6, least_seconds=0.0, least_runs=1)
    assert set(took) == {"load", "prepare", "compare"} and all(v > 0 for v in took.values())
