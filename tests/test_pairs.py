import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat import engine
from quadrat.operators import pairs as P
from quadrat.options import Options


def _items(spark, n):
    return spark.createDataFrame([(k,) for k in range(n)][::-1], "k long")


def _set(df):
    return sorted((r.i.k, r.j.k) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 4, 25])
@pytest.mark.parametrize("diagonal", [False, True])
def test_each_pair_once_by_theta_and_by_tiles(spark, n, diagonal):
    items = P.positions(_items(spark, n), "k")
    want = sorted(itertools.combinations_with_replacement(range(n), 2) if diagonal else itertools.combinations(range(n), 2))
    assert _set(P.theta_pairs(items, diagonal)) == want
    assert _set(P.tile_pairs(items, 3, diagonal)) == want
    assert (P.tiles(items, 3, diagonal).agg(F.sum("pairs")).first()[0] or 0) == len(want)


def test_positions_are_dense_and_ordered(spark):
    rows = P.positions(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7), "k").orderBy("k").collect()
    assert [r.pos for r in rows] == list(range(1000))


def test_closed_forms(spark):
    n = spark.createDataFrame([(0,), (1,), (46341,), (10**9,), (3 * 10**9,)], "n long")
    got = n.select(P.triangle_size(F.col("n")).alias("s"), P.triangle_size(F.col("n"), True).alias("d")).collect()
    assert [tuple(r) for r in got] == [(m * (m - 1) // 2, m * (m + 1) // 2) for m in (0, 1, 46341, 10**9, 3 * 10**9)]
    cases = [(a, b, c, d) for a in (0, 2, 5) for b in (0, 1, 4) for c in (0, 2, 6) for d in (0, 3)]
    df = spark.createDataFrame(cases, "a long, b long, c long, d long")
    for diagonal in (False, True):
        got = df.select("a", "b", "c", "d", P.rectangle_size(F.col("a"), F.col("b"), F.col("c"), F.col("d"), diagonal).alias("n")).collect()
        for r in got:
            want = sum(i <= j if diagonal else i < j for i in range(r.a, r.a + r.b) for j in range(r.c, r.c + r.d))
            assert r.n == want, r


def test_hilbert_order_of_four(spark):
    items = P.positions(_items(spark, 4), "k")
    rows = P.theta_pairs(items, True).select("i.k", F.col("j.k").alias("l"), P.hilbert_rank(F.col("i.pos"), F.col("j.pos"), 2).alias("h")).orderBy("h").collect()
    assert [(r.k, r.l) for r in rows] == [(0, 0), (1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (2, 2), (2, 3), (3, 3)]


@pytest.mark.parametrize("options", [Options(tile=3), Options(tile=100), Options(tile=3, hilbert=True, include_diagonal=True), Options(strategy="theta", include_diagonal=True)])
def test_strategies_agree(spark, options):
    v = np.random.default_rng(0).random((11, 5))
    items = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "k long, payload array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    app = engine.Application(key="k", expression=dot, block=lambda x, y: np.array(x) @ np.array(y).T)
    got = {(r.i, r.j): r.result for r in engine.all_pairs(app, items, options).collect()}
    assert len(got) == (66 if options.include_diagonal else 55)
    for (i, j), r in got.items():
        assert abs(r - v[i] @ v[j]) < 1e-12


@pytest.mark.parametrize("options", [Options(strategy="tile", tile=3), Options(strategy="tile"), Options()])
def test_expressions_by_tile(spark, options, monkeypatch):
    monkeypatch.setattr(engine, "THETA_ITEMS", 5)
    items = spark.createDataFrame([(k, float(k)) for k in range(11)], "k long, payload double")
    app = engine.Application(key="k", expression=lambda a, b: a - 2 * b)
    out = engine.all_pairs(app, items, options)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.i, r.j): (r.result, r.error) for r in out.collect()} == {(i, j): (float(i - 2 * j), None) for i in range(11) for j in range(i + 1, 11)}
    with pytest.raises(ValueError, match="expression"):
        engine.all_pairs(engine.Application(key="k", pair=lambda a, b: a), items, Options(strategy="theta"))


@pytest.mark.parametrize("kind", ["expression", "pair", "block"])
@pytest.mark.parametrize("tile", [1, 3, None])
def test_arrivals_are_compared_as_in_a_batch(spark, kind, tile):
    """A comparison that isn't symmetric, with arrivals on both sides of the old keys."""
    f = {"expression": lambda a, b: a - 2 * b, "pair": lambda a, b: a - 2 * b, "block": lambda x, y: np.subtract.outer(np.array(x), 2 * np.array(y))}[kind]
    app = engine.Application(key="k", **{kind: f})
    rows = [(k, float(k * k)) for k in (3, 8, 1, 9, 5, 7, 2)]
    df = lambda r: spark.createDataFrame(r, "k long, payload double")
    want = {tuple(r)[:3] for r in engine.all_pairs(app, df(rows)).collect()}
    old = {tuple(r)[:3] for r in engine.all_pairs(app, df(rows[:4])).collect()}
    parts = engine.new_pairs(app, df(rows[:4]), df(rows[4:]), Options(tile=tile))
    got = [tuple(r)[:3] for p in parts for r in p.collect()]
    assert len(got) == len(set(got)) == 21 - 6 and old | set(got) == want


def _shuffled(spark, run):
    """Records that run() writes to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    run()
    return written() - before


@pytest.mark.parametrize("tile", [1, 4, 60])
def test_tile_pairs_shuffle_each_item_once_a_side(spark, tile):
    items = P.positions(_items(spark, 240), "k")
    assert items.count() == 240
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more items
    try:
        n = _shuffled(spark, lambda: P.tile_pairs(items, tile).agg(F.sum("j.k")).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert n < 3 * 240


@pytest.mark.parametrize("name", ["emb_cosine", "emb_dot", "emb_ncc"])
def test_a_comparison_shuffles_no_copies_of_its_vectors(spark, name):
    from quadrat.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert _shuffled(spark, lambda: QUERIES[name](spark, data).agg(F.count("*")).collect()) < 4 * n


@pytest.mark.parametrize("name", ["emb_cosine", "emb_dot"])
def test_a_comparison_shuffles_each_vector_once(spark, name):
    from quadrat.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert _shuffled(spark, lambda: QUERIES[name](spark, data).agg(F.count("*")).collect()) < 1.5 * n


def _sizes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("name", ["emb_cosine", "emb_dot", "emb_ncc"])
def test_vectors_are_shuffled_as_short_as_they_are_stored(spark, name):
    """64 numbers of 4 bytes a vector, once, and what a row has besides."""
    from quadrat.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    n, before = spark.read.parquet(f"{data}/embeddings.parquet").count(), _sizes(spark)
    QUERIES[name](spark, data).agg(F.count("*")).collect()
    assert _sizes(spark) - before < 400 * n


def test_ncc_of_odd_vectors(spark, tmp_path):
    from quadrat.plans.queries import QUERIES

    v = [[1.0, 2.0, 3.0], [2.0, 4.0, 7.0], None, [1.0, None, 2.0], [5.0, 5.0, 5.0], [1.0, 2.0], [3.0, -1.0, 0.0]]
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.i, r.j): r.ncc for r in QUERIES["emb_ncc"](spark, str(tmp_path)).collect()}
    assert len(got) == 21
    for (i, j), r in got.items():
        if {i, j} & {2, 5}:
            assert r is None
        elif {i, j} & {3, 4}:
            assert np.isnan(r)
        else:
            a, b = (np.array(v[k]) - np.mean(v[k]) for k in (i, j))
            assert abs(r - a @ b / np.sqrt(a @ a * (b @ b))) < 1e-6


@pytest.mark.parametrize("n, edge, parts", [(0, 3, 1), (1, 3, 2), (50, 1, 3), (50, 7, 4), (50, 80, 2)])
def test_ranged_blocks_are_in_order(spark, n, edge, parts):
    items = _items(spark, n).select((F.col("k") % 20).alias("k"), F.array("k").alias("payload"))
    packed, count = P.ranged_blocks(items, edge, parts, "k")
    rows = packed.orderBy("block").collect()
    assert [r.block for r in rows] == list(range(count)) and all(0 < len(r["items"]) <= edge for r in rows)
    flat = [x for r in rows for x in r["items"]]
    assert [x.k for x in flat] == sorted(k % 20 for k in range(n)) and sorted(x.payload[0] for x in flat) == list(range(n))
    assert all(a.pos < b.pos for a, b in zip(flat, flat[1:]))


def test_failed_pairs_have_a_null_result_and_an_error(spark):
    items = spark.createDataFrame([(0, [1.0]), (1, None), (2, [3.0])], "k long, payload array<double>")
    app = engine.Application(key="k", pair=lambda a, b: a[0] * b[0])
    rows = {(r.i, r.j): r for r in engine.all_pairs(app, items).collect()}
    assert rows[0, 2].result == 3.0 and rows[0, 2].error is None
    assert rows[0, 1].result is None and "TypeError" in rows[0, 1].error and rows[1, 2].error
    with pytest.raises(Exception, match="TypeError"):
        engine.all_pairs(app, items, Options(fail_fast=True)).collect()


def test_block_failure_falls_back_to_single_pairs(spark):
    items = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0]), (2, [3.0])], "k long, payload array<double>")
    app = engine.Application(key="k", block=lambda a, b: np.array(a, float) @ np.array(b, float).T)
    rows = {(r.i, r.j): r for r in engine.all_pairs(app, items, Options(tile=8)).collect()}
    assert rows[0, 2].result == 3.0 and rows[0, 1].result is None and rows[0, 1].error


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(strategy="other")
    with pytest.raises(ValueError):
        Options(tile=0)


def test_pair_sample(spark):
    items = P.positions(_items(spark, 10), "k")
    s = P.pair_sample(P.theta_pairs(items), 7)
    assert s.count() == 7 and s.distinct().count() == 7


def test_stream_completes_the_pair_table(spark, tmp_path):
    from quadrat.streaming import incremental_pairs

    dot = lambda a, b: a * b
    app = engine.Application(key="k", expression=dot)
    schema = "k long, payload double"
    source = tmp_path / "in"
    for b, rows in enumerate([[(0, 1.0), (1, 2.0)], [(2, 3.0)], [(3, 4.0), (4, 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = incremental_pairs(spark, app, spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "items"), str(tmp_path / "pairs"), str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.i, r.j): r.result for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert got == {(i, j): float((i + 1) * (j + 1)) for i in range(5) for j in range(i + 1, 5)}
