"""Run metrics: profile records, progress of a run, and calibration of its stages on a sample of pairs."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Application, all_pairs
from .operators.pairs import positions
from .options import Options

#: A profile record: who did what, when (in nanoseconds), and details.
RECORD = "host string, actor string, op string, start long, end long, args string"


def aggregate(records: DataFrame) -> DataFrame:
    """(actor, op, n, total) of records (actor, op, amount)."""
    return records.groupBy("actor", "op").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def traced(spark: SparkSession, event_log: str) -> DataFrame:
    """RECORD of every task in Spark's event log (spark.eventLog.enabled): the trace of a run."""
    info = "struct<`Stage ID`: long, `Task Info`: struct<Host: string, `Executor ID`: string, `Task ID`: long, `Launch Time`: long, `Finish Time`: long>, `Task Metrics`: string>"
    e = spark.read.text(event_log).where(F.col("value").contains('"SparkListenerTaskEnd"')).select(F.from_json("value", info).alias("e"))
    task = "e.`Task Info`."
    return e.select(F.col(f"{task}Host").alias("host"), F.concat(F.lit("executor "), f"{task}`Executor ID`").alias("actor"), F.concat(F.lit("stage "), "e.`Stage ID`").alias("op"),
                    (F.col(f"{task}`Launch Time`") * 1_000_000).alias("start"), (F.col(f"{task}`Finish Time`") * 1_000_000).alias("end"), F.concat(F.lit("task "), f"{task}`Task ID`").alias("args"))


def filtered(records: DataFrame, ops: str | None = None, actors: str | None = None) -> DataFrame:
    """The records whose operation and actor match the regular expressions."""
    for column, pattern in (("op", ops), ("actor", actors)):
        records = records if pattern is None else records.where(F.col(column).rlike(pattern))
    return records


def durations(records: DataFrame) -> DataFrame:
    """Records as (actor, op, amount) in seconds, for aggregate()."""
    return records.select("actor", "op", ((F.col("end") - F.col("start")) / 1e9).alias("amount"))


class Events:
    """Records of what the driver does: with events.of(actor, op): ..."""

    def __init__(self, host: str = "driver") -> None:
        self.host, self.rows = host, []

    @contextmanager
    def of(self, actor: str, op: str, **args: object) -> Iterator[None]:
        began = time.time_ns()
        try:
            yield
        finally:
            self.rows.append((self.host, actor, op, began, time.time_ns(), json.dumps(args) if args else None))

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RECORD)


def calibrate(stages: dict[str, Callable[[], object]], least_seconds: float = 5.0, least_runs: int = 5) -> dict[str, float]:
    """Mean seconds of each stage over at least so many seconds and runs, after one run that isn't counted."""
    out = {}
    for name, run in stages.items():
        run()
        began, n = time.perf_counter(), 0
        while n < least_runs or time.perf_counter() - began < least_seconds:
            run()
            n += 1
        out[name] = (time.perf_counter() - began) / n
    return out


def calibrate_application(app: Application, items: DataFrame, load: Callable[[], DataFrame] | None = None, options: Options = Options(), sample: int = 45, least_seconds: float = 5.0, least_runs: int = 5) -> dict[str, float]:
    """Mean seconds of loading and preparing an item and of comparing a pair, on the pairs of at most `sample` items.

    Each stage runs over what the one before has stored, so a stage's time holds
    none of another's.
    """
    spark = items.sparkSession
    few = spark.createDataFrame(positions(items, app.key).where(F.col("pos") < sample).drop("pos").collect(), items.schema)
    n = max(few.count(), 1)
    made = app.prep(few) if app.prep else few
    prepared = spark.createDataFrame(made.collect(), made.schema)
    bare = Application(**{**app.__dict__, "prep": None})
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    stages = {"load": lambda: noop(load())} if load else {}
    stages |= {"prepare": lambda: noop(app.prep(few) if app.prep else few), "compare": lambda: noop(all_pairs(bare, prepared, options))}
    took = calibrate(stages, least_seconds, least_runs)
    units = {"load": max(load().count(), 1) if load else 1, "prepare": n, "compare": max(n * (n + 1 if options.include_diagonal else n - 1) // 2, 1)}
    return {k: v / units[k] for k, v in took.items()}


def progress(done: int, total: int, seconds: float) -> str:
    """Share, rate and time left, as it is logged during a run."""
    rate = done / seconds if seconds > 0 else 0.0
    left = (total - done) / rate if rate else float("inf")
    return f"{100 * done / max(total, 1):.1f}% of {total} pairs, {rate:.1f} a second, {left:.0f} s left"


@contextmanager
def watched(spark: SparkSession, total: int, every: float = 5.0, say: Callable[[str], object] = print) -> Iterator[None]:
    """Say progress() every few seconds while the block's jobs run; done is the finished share of the running stages' tasks."""
    context, group, over = spark.sparkContext, f"watched-{time.time_ns()}", threading.Event()
    tracker, began = context.statusTracker(), time.perf_counter()

    def report() -> None:
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        stages = [s for s in stages if s is not None and s.numTasks]
        if stages:
            share = sum(s.numCompletedTasks for s in stages) / sum(s.numTasks for s in stages)
            say(progress(round(share * total), total, time.perf_counter() - began))

    def watch() -> None:
        while not over.wait(every):
            report()

    context.setJobGroup(group, "all pairs")
    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        say(progress(total, total, time.perf_counter() - began))
