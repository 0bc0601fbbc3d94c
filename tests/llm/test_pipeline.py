import pathlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quadrat.llm import common, decontam, tokenization, toxicity

from .conftest import DOCS, prose
from .test_decontam import ITEMS
from .test_decontam import _brute as brute_leaks
from .test_dedup import _brute as brute_groups
from .test_dedup import _edited
from .test_toxicity import LABELS, _corpus


def _write(spark, folder, rows, labels, items):
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def case(spark, tmp_path, rng):
    rows, labels = _corpus(rng, 300)
    items = [(k, prose(rng, 25)) for k in range(8)]
    texts = [r[1] for r in rows]
    for k in range(40):
        texts.append(texts[int(rng.integers(300))])
    for k in range(40):
        texts.append(_edited(rng, texts[int(rng.integers(300))], 0.03))
    for k in range(20):
        texts.append(prose(rng, 30) + " " + items[int(rng.integers(8))][1] + " " + prose(rng, 30))
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    where = {int(old): new for new, old in enumerate(order)}
    labels = [(where[d], q, t) for d, q, t in labels]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    return _write(spark, tmp_path / "data", rows, labels, items), texts, labels, items


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_a_brute_force_pipeline(spark, case):
    folder, texts, labels, items = case
    kind = {d: t for d, _, t in labels}
    ids = sorted(kind)
    model = toxicity.fit(pa.array([texts[d] for d in ids]), np.array([kind[d] for d in ids]))
    score = toxicity.score(pa.array(texts), model)
    left = [d for d in range(len(texts)) if score[d] < 0.5]
    assert np.mean([(score[d] >= 0.5) == bool(kind[d]) for d in ids]) > 0.97
    first = {}
    for d in left:
        first.setdefault(texts[d], d)
    left = sorted(first.values())
    gone = brute_groups([texts[d] for d in left], 0.5)
    left = [d for k, d in enumerate(left) if k not in {x for x, _ in gone}]
    bad = {d for d, _ in brute_leaks([(d, texts[d]) for d in left], items, decontam.THRESHOLD)}
    assert len(bad) >= 15 and len(gone) >= 20
    left = [d for d in left if d not in bad]
    encode = tokenization.encoder().encode_ordinary
    shared = pathlib.Path(common.shared_folder(spark).removeprefix("file://"))
    there = set(shared.iterdir())
    rows = corpus_pipeline.run(spark, folder).collect()
    remains = set(shared.iterdir()) - there
    assert len(remains) == 1 and [p.name for p in remains.pop().iterdir()] == ["4_packing"]
    got = {}
    for r in rows:
        assert r.used == sum(r.lengths) <= 4096 and r.used + r.waste == 4096
        for i, n in zip(r.doc_ids, r.lengths):
            got[i] = got.get(i, 0) + n
    want = {d: len(encode(texts[d])) + 1 for d in left}
    assert got == want
    assert len(rows) == -(-sum(want.values()) // 4096)


def test_odd_rows_pass_every_stage(spark, tmp_path, odd, rng):
    rows, labels = _corpus(rng, 120)
    folder = _write(spark, tmp_path / "d", [(d + 100, *r) for d, *r in rows], [(d + 100, q, t) for d, q, t in labels], [(0, prose(rng, 20)), (1, None)])
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == odd.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    packed = {i for r in docs.collect() for i in r.doc_ids}
    assert packed == {1, 3, 4, 5, 6, 7, 8, 9, None}


def test_empty_tables(spark, tmp_path):
    folder = _write(spark, tmp_path / "d", [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda f: None))

    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
        assert common.shared_folder(session(master, "hdfs://a/b/")) == "hdfs://a/b"
    assert common.shared_folder(session("local[2]"))
