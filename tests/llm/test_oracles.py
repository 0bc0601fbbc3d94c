"""The SQL of the dealt operators against their queries, on small tables with planted cases."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import decontam, exact, neardup, queries, threads

from .conftest import DOCS, prose
from .test_decontam import ITEMS, _case
from .test_dedup import _edited
from .test_threads import MESSAGES, _conversation


def _same(df, sql, **tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t.toPandas())
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, 0 if x is None else x) for x in r])
    assert order(got) == order(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_threads(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [r for conv in range(5) for r in _conversation(rng, conv, int(rng.integers(1, 9)))[0]]
    rows += [(9, 0, "u", "a. b! c?"), (9, 1, "a", ">a.\n> > zz\n>\n\n> c?\nown"), (9, 1, "a", "other"), (9, 2, "u", "> b"), (9, 3, None, "A wrote:\nno quote\nX wrote:\n> a"), (9, 4, "u", "")]
    df = spark.createDataFrame(rows, MESSAGES)
    out = threads.conversations(df)
    out = out.withColumns({"replies": F.col("reply_to").isNotNull(), "reply_to": F.coalesce("reply_to", "turn")})
    _same(out, queries.ORACLE_SQL["op3_chat_formatting"], conversations=df)


def test_exact_dedup(spark, rng):
    texts = [prose(rng, 20) for _ in range(6)] + [""]
    df = spark.createDataFrame([(k, texts[k % 7], "en", "s", 0) for k in range(40)], DOCS)
    _same(exact.duplicates(df), queries.ORACLE_SQL["op8_exact_dedup"], documents=df)


def test_near_dedup(spark, rng):
    texts = []
    for n in rng.integers(5, 200, 25):
        first = prose(rng, n)
        texts += [first] + [_edited(rng, first, s) for s in rng.uniform(0.005, 0.05, 2)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate([*texts, "", "a", "A.", None])], DOCS)
    _same(neardup.duplicates(df), queries.ORACLE_SQL["op4_minhash_near_dedup"], documents=df)


def test_decontamination(spark, rng):
    docs, items = _case(rng, 0.05)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs] + [(900, "", "en", "s", 0), (901, None, "en", "s", 0)], DOCS)
    b = spark.createDataFrame([*items, (90, ""), (91, None), (92, "one"), (93, items[0][1])], ITEMS)
    out = decontam.leaks(df, b).withColumn("similarity", F.round("similarity", 6))
    _same(out, queries.ORACLE_SQL["op1_decontamination"], documents=df, benchmark=b)
