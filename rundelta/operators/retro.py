"""A retrospective: every task (cohort and date) fitted, failures fitted again by the next stage.

The state is a table of attempts on shared storage, a folder a stage.  A stage reads the tasks whose last attempt
did not pass its gates, and only their cells; a task's row is its last attempt.  A folder that was written whole
(Spark marks it) is not made again, so a study that was cut off goes on where it stopped, and one that ended is
read back.  A task that no stage can fit is a row with its reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.functions.storage import shared_folder
from rundelta.operators.backtest import Candidate, candidates_frame, fit_candidates, snapshots
from rundelta.operators.mack import mack_totals

RESULT = ["latest", "estimate", "se", "reason"]
#: A stage: cells of several tasks and their keys to a row a task with the columns of ``RESULT``.
Fit = Callable[[DataFrame, list[str]], DataFrame]


@dataclass(frozen=True)
class Gates:
    """What a result has to meet: no reason, a finite estimate, an error if ``need_se``, and at most ``max_cv`` of it."""

    need_se: bool = False
    max_cv: float | None = None

    def passes(self) -> Column:
        ok = F.col("reason").isNull() & F.col("estimate").isNotNull() & ~F.isnan("estimate") & (F.abs("estimate") < float("inf"))
        if self.need_se or self.max_cv is not None:
            ok = ok & F.col("se").isNotNull() & ~F.isnan("se") & (F.col("se") > 0)
        if self.max_cv is not None:
            ok = ok & (F.col("se") <= self.max_cv * F.abs("estimate"))
        return F.coalesce(ok, F.lit(False))


def candidate_stage(premium: DataFrame, candidate: Candidate, step: int, horizon: int | None = None) -> Fit:
    """The cohort's total by a conventional candidate; it gives no error."""

    def fit(cells: DataFrame, keys: list[str]) -> DataFrame:
        rows = fit_candidates(cells, premium, candidates_frame(cells.sparkSession, [candidate]), keys, step, horizon)
        out = rows.groupBy(*keys).agg(F.sum("latest").alias("latest"), F.sum("ultimate").alias("estimate"), F.max("reason").alias("reason"))
        return out.select(*keys, "latest", "estimate", F.lit(None).cast("double").alias("se"), "reason")

    return fit


def mack_stage(step: int, **options) -> Fit:
    """The cohort's total and its error by Mack's model."""

    def fit(cells: DataFrame, keys: list[str]) -> DataFrame:
        rows = mack_totals(cells, keys, step, **options)
        reason = F.when(F.col("mack_se").isNull(), "variance_not_estimable")
        return rows.select(*keys, "latest", F.col("ultimate").alias("estimate"), F.col("mack_se").alias("se"), reason.alias("reason"))

    return fit


def _written(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def run_retro(cells: DataFrame, keys: list[str], days: list[str], stages: Sequence[Fit], gates: Gates | None = None, folder: str | None = None) -> DataFrame:
    """keys, snapshot, stage, latest, estimate, se, reason, passed: a row a task, that of its last attempt.

    Tasks are the cohorts that show a cell on a day.  ``folder`` on shared storage makes a study resumable; it
    belongs to one study (cells, days, stages).  A stage that returns no row for a task leaves it the reason
    ``not_identified``.  Empty tables give no tasks.
    """
    if not stages:
        raise Refusal("invalid_option", "a retrospective needs a stage")
    spark, gates = cells.sparkSession, gates or Gates()
    folder = folder or shared_folder(spark, "retro")
    task = [*keys, "snapshot"]
    at = snapshots(cells, keys, days)
    at = at.select(*task, "origin_period", "dev_lag", "eval_date", "value")
    attempts = None
    for n, stage in enumerate(stages, 1):
        place = f"{folder}/stage-{n}"
        if not _written(spark, place):
            open_tasks = at.select(*task).distinct() if attempts is None else attempts.where("not passed").select(*task)
            todo = at if attempts is None else at.join(open_tasks, task, "left_semi")
            found = open_tasks.join(stage(todo, task).withColumn("met", F.lit(True)), task, "left")
            reason = F.when(F.col("met").isNull(), "not_identified").otherwise(F.col("reason"))
            rows = found.select(*task, F.lit(n).alias("stage"), "latest", "estimate", "se", reason.alias("reason"))
            rows.withColumn("passed", gates.passes()).write.mode("overwrite").parquet(place)
        last = spark.read.parquet(place)
        attempts = last if attempts is None else attempts.join(last.select(*task), task, "left_anti").unionByName(last)
    return attempts


def with_outcomes(results: DataFrame, cells: DataFrame, keys: list[str], terminal: int) -> DataFrame:
    """``results`` with ``outcome``: what the origins known on the day came to at the age ``terminal``; null if one is not yet known."""
    days = results.select("snapshot").distinct()
    known = cells.select(*keys, "origin_period", "eval_date").join(days, F.col("eval_date") <= F.col("snapshot")).select(*keys, "snapshot", "origin_period").distinct()
    came = cells.where(F.col("dev_lag") == terminal).select(*keys, "origin_period", F.col("value").alias("came"))
    sums = known.join(came, [*keys, "origin_period"], "left").groupBy(*keys, "snapshot").agg(F.when(F.count("came") == F.count(F.lit(1)), F.sum("came")).alias("outcome"))
    return results.join(sums, [*keys, "snapshot"], "left")
