import pytest
from pyspark.sql import functions as F

from quadrat.llm import shards
from quadrat.llm.shards import Conflict, SchemaChange, ShardStore

from .conftest import DOCS, prose


@pytest.fixture
def docs(spark, rng):
    return spark.createDataFrame([(k, prose(rng, 50), "en", "s", k) for k in range(400)], DOCS)


def test_appends_and_compaction_keep_all_rows(spark, tmp_path, docs):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=40_000)
    for k in range(4):
        store.append(docs.where(F.col("doc_id") % 4 == k).repartition(3))
    before = store.manifest()
    assert before["version"] == 4 and len(before["shards"]) == 12 and sum(s["rows"] for s in before["shards"]) == 400
    after = store.compact()
    assert after["version"] > 4 and len(after["shards"]) < 12 and sum(s["rows"] for s in after["shards"]) == 400
    want = sorted(docs.collect())
    assert sorted(store.read().collect()) == want and sorted(store.read(4).collect()) == want
    assert store.read(2).count() == 200
    small = [s for s in after["shards"] if s["bytes"] < 30_000]
    tiers = [store.tier(s["bytes"]) for s in small]
    assert all(tiers.count(t) < store.fan_in for t in tiers) or store.compact() == after


def test_compaction_leaves_large_shards_and_few_small_ones(spark, tmp_path, docs):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20)
    first = store.append(docs.coalesce(1))
    assert store.compact() == first
    paths = {s["path"] for s in first["shards"]}
    big = ShardStore(spark, str(tmp_path / "store"), target_bytes=1000)
    for _ in range(4):
        big.append(docs.coalesce(1))
    assert paths <= {s["path"] for s in big.compact()["shards"]}


def test_commits_are_atomic(spark, tmp_path, docs):
    store = ShardStore(spark, str(tmp_path / "store"))
    base = store.manifest()
    store.append(docs.limit(5))
    with pytest.raises(Conflict):
        store._commit(base, docs.schema.json(), [])
    assert store.versions() == [1] and store.read().count() == 5
    assert not [p for p in (tmp_path / "store" / "manifests").iterdir() if p.suffix == ".tmp" and not p.name.startswith("..")]


def test_vacuum_keeps_what_is_live(spark, tmp_path, docs):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20)
    for k in range(5):
        store.append(docs.where(F.col("doc_id") % 5 == k).coalesce(1))
    store.compact()
    docs.limit(3).write.parquet(str(tmp_path / "store" / "shards" / "lost-job"))
    assert store.vacuum() == 0 and len(store.versions()) > 5  # all is younger than a day
    assert store.vacuum(older_than=0) > 5 and len(store.versions()) == 1 and store.read().count() == 400


def test_vacuum_spares_writers_in_progress_and_readers(spark, tmp_path, docs):
    """A job that has written but not committed, and a reader of the version before a merge."""
    store, other = (ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20) for _ in range(2))
    for k in range(4):
        store.append(docs.where(F.col("doc_id") % 8 == k).coalesce(1))
    reader, change = store.read(), other._change

    def vacuumed_between(f):
        assert store.vacuum(older_than=0) == 0
        return change(f)

    other._change = vacuumed_between
    other.append(docs.where(F.col("doc_id") % 8 == 4).coalesce(1))
    assert other.read().count() == 250 and store.compact()["version"] == 6
    assert store.vacuum() == 0 and reader.count() == 200
    assert not list((tmp_path / "store" / "pending").iterdir())
    store._fs.create(store._path(f"{store.folder}/pending/lost"), False).close()
    assert store.vacuum(older_than=0) == 5 and (tmp_path / "store" / "pending" / "lost").exists()
    store.vacuum(abandoned=0)
    assert not (tmp_path / "store" / "pending" / "lost").exists() and store.read().count() == 250


def test_schema_grows_and_contradictions_raise(spark, tmp_path, docs):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20)
    store.append(docs.where("doc_id < 100").select("doc_id", "text").coalesce(1))
    for k in range(4):
        store.append(docs.where(f"doc_id >= 100 and doc_id % 4 = {k}").select("lang", "doc_id", F.lit(k).alias("k")).coalesce(1))
    want = docs.select("doc_id", F.when(F.col("doc_id") < 100, F.col("text")).alias("text"), F.when(F.col("doc_id") >= 100, F.col("lang")).alias("lang"), F.when(F.col("doc_id") >= 100, (F.col("doc_id") % 4).cast("int")).alias("k")).collect()
    for _ in range(2):
        assert store.read().columns == ["doc_id", "text", "lang", "k"] and sorted(store.read().collect(), key=str) == sorted(want, key=str)
        store.compact()
        store.vacuum(older_than=0)
    for bad in (docs.select(F.col("doc_id").cast("string")), docs.select(F.col("doc_id").alias("DOC_ID"))):
        with pytest.raises(SchemaChange):
            store.append(bad)
    assert store.read().count() == 400


def test_two_writers_both_commit_and_a_lost_merge_leaves_nothing(spark, tmp_path, docs):
    store, other = (ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20) for _ in range(2))
    for k in range(4):
        store.append(docs.where(F.col("doc_id") % 8 == k).coalesce(1))
    write = store._write

    def late(df, level, batch):
        made = write(df, level, batch)
        other.append(docs.where(F.col("doc_id") % 8 == 4).coalesce(1))
        return made

    store._write = late
    store.append(docs.where(F.col("doc_id") % 8 == 5).coalesce(1))
    assert store.read().count() == 300 and store.versions() == [1, 2, 3, 4, 5, 6]

    def beaten(df, level, batch):
        made = write(df, level, batch)
        other.compact()
        return made

    store._write = beaten
    before = {p.name for p in (tmp_path / "store" / "shards").iterdir()}
    with pytest.raises(Conflict):
        store.compact()
    after = {p.name for p in (tmp_path / "store" / "shards").iterdir()}
    assert len(after - before) == 1 and store.read().count() == 300


def test_each_tier_merges_by_itself(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 24)
    shard = lambda k, size: {"path": f"p{k}", "bytes": size, "rows": 1, "level": 0}
    shards = [shard(k, 1000) for k in range(5)] + [shard(10 + k, 5 << 20) for k in range(4)] + [shard(20, 300_000)]
    assert [[s["path"] for s in run] for run in store.due(shards)] == [["p0", "p1", "p2", "p3", "p4"], ["p10", "p11", "p12", "p13"]]
    assert store.due([shard(k, (1 << 24) * 2 // 3) for k in range(8)]) == []


def test_stores_without_atomic_renames_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "NOT_ATOMIC", frozenset(["file"]))
    with pytest.raises(ValueError, match="atomic"):
        ShardStore(spark, str(tmp_path / "s"))
    assert ShardStore(spark, str(tmp_path / "s"), only_writer=True).versions() == []


def test_odd_rows(spark, tmp_path, odd, none):
    store = ShardStore(spark, str(tmp_path / "a"))
    assert store.read().count() == 0
    store.append(odd.coalesce(1))
    store.append(odd.limit(0))
    assert store.compact()["version"] == 2
    assert store.read().columns == odd.columns and store.read().exceptAll(odd).isEmpty() and odd.exceptAll(store.read()).isEmpty()
    clash = odd.withColumns({"_metadata": F.lit("m"), "shard": F.lit(1), "version": F.lit(None).cast("int"), "path": F.lit("p")})
    kept = shards.sharded(clash, str(tmp_path / "b")).read()
    assert kept.columns == clash.columns and kept.exceptAll(clash).isEmpty() and clash.exceptAll(kept).isEmpty()
    empty = shards.sharded(none, str(tmp_path / "c")).read()
    assert empty.count() == 0 and empty.columns == none.columns
