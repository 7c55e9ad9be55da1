"""Random search over the settings of conventional methods, all trials in one plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.errors import Refusal
from rundelta.operators.backtest import Candidate, candidates_frame, replay_intervals, score_replay

#: A setting's distribution: a function of a random generator.
Draw = Callable[[np.random.Generator], object]


def choice(*values) -> Draw:
    """One of the values, each as likely, as the object that was given."""
    if not values:
        raise Refusal("invalid_option", "no values to choose from")
    return lambda rng: values[int(rng.integers(len(values)))]


def uniform(low: float, high: float) -> Draw:
    if not low < high:
        raise Refusal("invalid_option", f"{low} to {high}")
    return lambda rng: float(rng.uniform(low, high))


def log_uniform(low: float, high: float) -> Draw:
    if not 0 < low < high:
        raise Refusal("invalid_option", f"{low} to {high}")
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def int_log_uniform(low: int, high: int) -> Draw:
    inner = log_uniform(low, high)
    return lambda rng: min(high, max(low, round(inner(rng))))


def trials(space: Mapping[str, Draw], n_trials: int, seed: int) -> list[dict]:
    """Settings of each trial: a function of the seed and the order of the space alone."""
    if n_trials < 1:
        raise Refusal("invalid_option", f"{n_trials} trials")
    rng = np.random.default_rng(seed)
    return [{k: draw(rng) for k, draw in space.items()} for _ in range(n_trials)]


def tune(cells: DataFrame, premium: DataFrame, space: Mapping[str, Draw], n_trials: int, seed: int, days: list[str], keys: list[str], step: int, horizon: int, metric: str = "ave", keep_top: int | None = None) -> DataFrame:
    """trial, method, history, high, low, elr, decay, score, n_scored, place: best first by mean error over replays.

    ``space`` draws fields of ``Candidate``.  A trial is scored by all its diagonals or not at all and then comes last; ties go to
    the earlier trial.  ``keep_top`` limits the report.
    """
    drawn = trials(space, n_trials, seed)
    made = [Candidate(f"{n:06d}", **{"method": "cl"} | d) for n, d in enumerate(drawn)]
    frame = candidates_frame(cells.sparkSession, made)
    scored = score_replay(replay_intervals(cells, premium, frame, days, keys, step, horizon), metric).where("status = 'scored'")
    means = scored.groupBy("candidate").agg(F.avg("rmse").alias("mean"), F.count(F.lit(1)).alias("n_scored"))
    means = means.select("candidate", F.when(F.col("n_scored") == len(days) - 1, F.col("mean")).alias("score"), "n_scored")
    out = frame.join(means, "candidate", "left")
    # A row per trial: this order is over the report, not over data.
    rows = out.orderBy(F.col("score").asc_nulls_last(), "candidate").limit(keep_top or n_trials)
    return rows.select(F.col("candidate").cast("int").alias("trial"), "method", "history", "high", "low", "elr", "decay", "score", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))
