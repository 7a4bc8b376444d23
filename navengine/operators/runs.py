"""Runs of stages whose outputs are committed one by one and published together, behind guards.

A table under ``root`` is what its last commit names. A stage writes its rows to a folder of their own and reads them back; its guard
sees the rows as written. Only then one row is appended to the log of stages. When all stages of a run are ok, one more
row, in one file, names the folders that readers see from then on; that file is there or it is not, so readers
see the old tables or the new ones. A run that was killed is started again under its own name and goes on after its last committed stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, read_or_none

OK, REVIEW, FAILED, WAITING = "ok", "needs review", "failed", "not run"
LOG = "run string, position int, stage string, state string, n_rows long, note string, path string, at timestamp"
COMMITS = "number long, run string, paths map<string,string>, at timestamp"

#: (rows as written, the tables before it by stage name) to what a person must look at, or None.
Guard = Callable[[DataFrame, dict[str, DataFrame]], str | None]


@dataclass
class Stage:
    """make: the tables of earlier stages by name to the rows of this one. Each guard speaks for the rows as written."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    guards: list[Guard] = field(default_factory=list)


def same_counts(other: str, *columns: str) -> Guard:
    """Rows, and distinct values of each column, must be those of stage ``other``."""

    def guard(rows: DataFrame, before: dict[str, DataFrame]) -> str | None:
        count = lambda df: df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_distinct(c).alias(c) for c in columns)).first().asDict()
        was, is_ = count(before[other]), count(rows)
        wrong = [f"{k} {was[k]} -> {is_[k]}" for k in was if was[k] != is_[k]]
        return ", ".join(wrong) or None

    return guard


def none_of(review: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], what: str) -> Guard:
    """There must be no row that a person has to look at."""

    def guard(rows: DataFrame, before: dict[str, DataFrame]) -> str | None:
        n = review(rows, before).count()
        return f"{n} {what}" if n else None

    return guard


def _append(spark: SparkSession, values: list, schema: str, path: str) -> None:
    rows = spark.createDataFrame([v + [None] for v in values], schema).withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(path)  # one file: seen whole or not at all


def log(spark: SparkSession, root: str) -> DataFrame:
    """What stages did, each attempt a row."""
    found = read_or_none(spark, f"{root}/log", LOG)
    return spark.createDataFrame([], LOG) if found is None else found


def commits(spark: SparkSession, root: str) -> DataFrame:
    found = read_or_none(spark, f"{root}/commits", COMMITS)
    return spark.createDataFrame([], COMMITS) if found is None else found


def published(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last commit (or of an earlier one) by name; none if nothing was published."""
    rows = commits(spark, root)
    rows = rows if number is None else rows.where(F.col("number") == number)
    last = rows.orderBy(F.desc("number")).first()
    return {} if last is None else {name: spark.read.parquet(path) for name, path in last["paths"].items()}


def run(spark: SparkSession, root: str, name: str, stages: list[Stage]) -> DataFrame:
    """Runs the stages in order, publishes if all are ok, and returns (position, stage, state, n_rows, note), a row for each stage.

    A stage that was ok in an earlier attempt of the run of this name is not run again: its committed rows are read. A guard
    that speaks gives "needs review", an exception "failed"; either ends the run, later stages are "not run", and what is published stays.
    A run that was published is not published again. One run at a time may write under ``root``.
    """
    attempts = log(spark, root).where((F.col("run") == name) & (F.col("state") == OK))
    done = {r["stage"]: r for r in attempts.collect()}  # one row a stage
    tables: dict[str, DataFrame] = {}
    out, ended = [], False
    for position, stage in enumerate(stages, 1):
        if ended:
            out.append((position, stage.name, WAITING, None, None))
            continue
        if stage.name in done:
            r = done[stage.name]
            tables[stage.name] = spark.read.parquet(r["path"])
            out.append((position, stage.name, OK, r["n_rows"], r["note"]))
            continue
        tried = log(spark, root).where((F.col("run") == name) & (F.col("stage") == stage.name)).count()
        path = f"{root}/data/{name}/{stage.name}/{tried}"
        n, state = None, OK
        try:
            stage.make(dict(tables)).write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path)
            n = rows.count()
            notes = [s for g in stage.guards if (s := g(rows, tables))]
            note = "; ".join(notes) or None
            state = REVIEW if notes else OK
            tables[stage.name] = rows
        except Exception as e:  # noqa: BLE001  the state of a stage is the result
            state, note = FAILED, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
        _append(spark, [[name, position, stage.name, state, n, note, path]], LOG, f"{root}/log")
        out.append((position, stage.name, state, n, note))
        ended = state != OK
    if not ended and commits(spark, root).where(F.col("run") == name).isEmpty():
        publish(spark, root, name, {r["stage"]: r["path"] for r in log(spark, root).where((F.col("run") == name) & (F.col("state") == OK)).collect()})
    return spark.createDataFrame(out, "position int, stage string, state string, n_rows long, note string")


def publish(spark: SparkSession, root: str, name: str, paths: dict[str, str]) -> None:
    """The swap: from this one row on, readers see these folders."""
    last = commits(spark, root).agg(F.max("number")).first()[0]
    _append(spark, [[0 if last is None else last + 1, name, paths]], COMMITS, f"{root}/commits")


def roll_back(spark: SparkSession, root: str, number: int) -> None:
    """Publishes an earlier commit again, as a new one."""
    old = commits(spark, root).where(F.col("number") == number).first()
    if old is None:
        raise ValueError(f"no commit {number}")
    publish(spark, root, f"roll back to {number}", old["paths"])


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the rows that neither one of the last ``keep`` commits nor an open run names; how many folders went."""
    kept = {p for r in commits(spark, root).orderBy(F.desc("number")).limit(keep).collect() for p in r["paths"].values()}
    closed = {r["run"] for r in commits(spark, root).select("run").distinct().collect()}
    # A row for each stage of a run.
    old = {r["path"] for r in log(spark, root).collect() if r["path"] not in kept and (r["run"] in closed or r["state"] != OK)}
    gone = 0
    for path in old:
        if read_or_none(spark, path, "x int") is not None:
            delete(path)
            gone += 1
    return gone
