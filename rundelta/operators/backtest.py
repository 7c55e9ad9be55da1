"""Backtests: the next diagonal as a holdout, replays of candidates over dates, scores, selection."""

from __future__ import annotations

from dataclasses import astuple, dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.functions.sizes import small
from rundelta.operators.links import all_links
from rundelta.operators.methods import latest
from rundelta.operators.triangle import month_number

# --- holdout ----------------------------------------------------------------------------------


def known_at(cells: DataFrame, keys: list[str], day) -> DataFrame:
    w = Window.partitionBy(*keys, "origin_period", "dev_lag").orderBy(F.col("eval_date").desc())
    return cells.where(F.col("eval_date") <= F.lit(day).cast("date")).withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def next_diagonal(cells: DataFrame, keys: list[str], step: int, day, premium: DataFrame | None = None) -> DataFrame:
    """The cells that the first evaluation date after ``day`` with a new cell brings, per cohort.

    Columns: keys, origin_period, dev_lag, eval_date, value, prev_value (from what was known on ``day``;
    0 at the first age), premium, excluded (``new_origin``, ``dev_beyond_trained``, ``no_predecessor``
    in this order, or null) and scored.
    """
    train = known_at(cells, keys, day)
    cell = [*keys, "origin_period", "dev_lag"]
    fresh = cells.where(F.col("eval_date") > F.lit(day).cast("date")).join(train.select(*cell), cell, "left_anti")
    fresh = fresh.withColumn("__first", F.min("eval_date").over(Window.partitionBy(*keys))).where("eval_date = __first").drop("__first")
    before = train.select(*keys, "origin_period", (F.col("dev_lag") + step).alias("dev_lag"), F.col("value").alias("prev_value"))
    origins = train.select(*keys, "origin_period").distinct().withColumn("known_origin", F.lit(True))
    depth = train.groupBy(*keys).agg(F.max("dev_lag").alias("deepest"))
    out = fresh.join(before, cell, "left").join(origins, [*keys, "origin_period"], "left").join(depth, keys, "left")
    if premium is not None:
        out = out.join(premium.select(*keys, "origin_period", "premium"), [*keys, "origin_period"], "left")
    out = out.withColumn("prev_value", F.when(F.col("dev_lag") == step, F.lit(0.0)).otherwise(F.col("prev_value")))
    excluded = F.when(F.col("known_origin").isNull(), "new_origin").when(F.col("dev_lag") > F.col("deepest"), "dev_beyond_trained").when(F.col("prev_value").isNull(), "no_predecessor")
    return out.withColumn("excluded", excluded).withColumn("scored", F.col("excluded").isNull()).drop("known_origin", "deepest")


def realized_values(cells: DataFrame, origins: DataFrame, keys: list[str], dev_lag: int) -> DataFrame:
    """Each origin's value at an age of the full triangle, null where it is not observed."""
    at = cells.where(F.col("dev_lag") == dev_lag).select(*keys, "origin_period", F.col("value").alias("realized"))
    return origins.join(at, [*keys, "origin_period"], "left")


# --- point scores -----------------------------------------------------------------------------


def point_metrics(predicted: Column, actual: Column) -> list[Column]:
    """mae, rmse, wrmse, mape, medape, pool_ape, pool_pe, prop_over as aggregate columns."""
    e, size = predicted - actual, F.abs(actual)
    ape = F.try_divide(F.abs(e), size)
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.sum(size * e * e) / F.sum(size)).alias("wrmse"),
        F.avg(ape).alias("mape"),
        F.median(ape).alias("medape"),
        (F.sum(F.abs(e)) / F.sum(actual)).alias("pool_ape"),
        (F.sum(e) / F.sum(actual)).alias("pool_pe"),
        F.avg((predicted > actual).cast("double")).alias("prop_over"),
    ]


def level_errors(df: DataFrame, level: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Errors of sums: amounts are added within a level before the difference is taken."""
    sums = df.groupBy(*level).agg(F.sum(predicted).alias("predicted"), F.sum(actual).alias("actual"))
    e = F.col("predicted") - F.col("actual")
    return sums.withColumns({"error": e, "abs_error": F.abs(e), "pct_error": F.try_divide(e, F.col("actual"))})


def shrink_toward(point: Column, baseline: Column, alpha: float) -> Column:
    return baseline + alpha * (point - baseline)


# --- candidates -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    """A frozen setting of a conventional method.

    ``exhausted`` says what trims that would leave fewer than ``preserve`` links do (``raise``: the fit fails,
    ``keep``: they are skipped), ``unsupported`` what an age without a usable factor does (``raise`` or ``unity``).
    """

    name: str
    method: str
    history_periods: int = 1_000_000
    drop_high: int = 0
    drop_low: int = 0
    expected_loss_ratio: float = 0.0
    decay: float = 1.0
    average: str = "volume"
    zero_cells: str = "observed"
    ties: str = "origin"
    preserve: int = 1
    exhausted: str = "raise"
    unsupported: str = "raise"

    def __post_init__(self):
        ok = self.method in ("cl", "bf", "gcc") and self.average in ("volume", "simple", "regression") and self.zero_cells in ("observed", "missing") and self.ties in ("origin", "volume")
        ok &= self.exhausted in ("raise", "keep") and self.unsupported in ("raise", "unity") and self.history_periods >= 1 and min(self.drop_high, self.drop_low, self.preserve) >= 0
        if not ok:
            raise Refusal("invalid_option", str(self))


def conventional_grid(history: tuple[int, ...] = (3, 1_000_000), drop_high: tuple[int, ...] = (0, 1), drop_low: tuple[int, ...] = (0,), elrs: tuple[float, ...] = (0.6,), decays: tuple[float, ...] = (1.0,), **options) -> list[Candidate]:
    """Chain ladder, Bornhuetter-Ferguson by loss ratio and Cape Cod by decay, times the link settings."""
    out = []
    for h, hi, lo in product(history, drop_high, drop_low):
        tag = f"h{'all' if h >= 1_000_000 else h}_hi{hi}_lo{lo}"
        out.append(Candidate(f"cl_{tag}", "cl", h, hi, lo, **options))
        out += [Candidate(f"bf{e:g}_{tag}", "bf", h, hi, lo, e, **options) for e in elrs]
        out += [Candidate(f"gcc{d:g}_{tag}", "gcc", h, hi, lo, 0.0, d, **options) for d in decays]
    return out


SETTINGS = ["candidate", "method", "history", "high", "low", "elr", "decay", "average", "zero_cells", "ties", "preserve", "exhausted", "unsupported"]


def candidates_frame(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    kinds = dict.fromkeys(("history", "high", "low", "preserve"), "int") | dict.fromkeys(("elr", "decay"), "double")
    return spark.createDataFrame([astuple(c) for c in candidates], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in SETTINGS))


def _triangles(cells: DataFrame, premium: DataFrame, keys: list[str], step: int, horizon: int | None) -> DataFrame:
    """A row per cohort: ``origins`` and ``links`` by age as arrays, and ``end``, the last age.  A cohort is one triangle."""
    cut = cells if horizon is None else cells.where(F.col("dev_lag") <= horizon)
    links = all_links(cut, keys, step).groupBy(*keys).agg(F.collect_list(F.struct("dev_lag", "origin_period", "previous", "following", "ratio")).alias("links"))
    on = [k for k in keys if k in premium.columns]
    base = latest(cut, keys).join(premium.select(*on, "origin_period", "premium"), [*on, "origin_period"], "left")
    origins = base.groupBy(*keys).agg(F.collect_list(F.struct("origin_period", "latest_dev", "latest", "premium", month_number(F.col("origin_period")).cast("double").alias("m"))).alias("origins"))
    if horizon is None:
        origins = origins.withColumn("end", F.array_max(F.transform("origins", lambda o: o["latest_dev"])))
    else:
        origins = origins.withColumn("end", F.lit(horizon).cast("bigint"))
    return origins.join(links, keys, "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<dev_lag: bigint, origin_period: date, previous: double, following: double, ratio: double>>")))


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def _age_factor(links: Column) -> Column:
    """(factor, exhausted) of the links of one age under the row's settings; the rules run in the order of ``links``."""
    seen = F.reverse(F.array_sort(F.transform(links, lambda x: F.struct(x["origin_period"].alias("o"), x["previous"].alias("p"), x["following"].alias("f"), x["ratio"].alias("r")))))
    observed = F.filter(seen, lambda x: (x["p"] != 0) & x["r"].isNotNull())
    missing = F.filter(F.slice(seen, F.lit(1), F.col("history")), lambda x: (x["p"] != 0) & (x["f"] != 0))
    live = F.when(F.col("zero_cells") == "observed", F.slice(observed, F.lit(1), F.col("history"))).otherwise(missing)
    by_origin = F.array_sort(F.transform(live, lambda x: F.struct(x["r"].alias("r"), F.lit(0.0).alias("t"), x["o"].alias("o"), x["p"].alias("p"), x["f"].alias("f"))))
    by_volume = F.array_sort(F.transform(live, lambda x: F.struct(x["r"].alias("r"), x["p"].alias("t"), x["o"].alias("o"), x["p"].alias("p"), x["f"].alias("f"))))
    ranked = F.when(F.col("ties") == "origin", by_origin).otherwise(by_volume)
    left = F.size(live) - F.col("high") - F.col("low")
    enough = left >= F.col("preserve")
    kept = F.when(enough, F.slice(ranked, F.col("low") + 1, F.greatest(left, F.lit(0)))).otherwise(ranked)
    volume = F.try_divide(_sum(kept, lambda x: x["f"]), _sum(kept, lambda x: x["p"]))
    simple = F.try_divide(_sum(kept, lambda x: x["r"]), F.size(kept))
    regression = F.try_divide(_sum(kept, lambda x: x["p"] * x["f"]), _sum(kept, lambda x: x["p"] * x["p"]))
    factor = F.when(F.col("average") == "volume", volume).when(F.col("average") == "simple", simple).otherwise(regression)
    return F.struct(factor.alias("factor"), (~enough & (F.col("high") + F.col("low") > 0) & (F.size(live) > 0)).alias("exhausted"))


def fit_candidates(cells: DataFrame, premium: DataFrame, candidates: DataFrame, keys: list[str], step: int, horizon: int | None = None) -> DataFrame:
    """candidate, keys, origin_period, latest_dev, latest, ultimate, next_value, reason for all candidates in one plan.

    ``cells`` may hold several snapshots: name the snapshot among ``keys``.  Ultimates are at ``horizon`` (the
    cohort's last age without one), and every age before it needs a factor.  A fit that fails has null values and
    a ``reason`` on all its origins: ``premium_missing``, ``exclusions_exhausted`` or ``no_link_ratio``.

    A cohort's triangle travels as one row, built once whatever the number of candidates, which then only widen
    rows: no candidate shuffles a link.
    """
    rows = _triangles(cells, premium, keys, step, horizon).crossJoin(small(candidates.select(*SETTINGS), 200))
    ages = F.filter(F.transform(F.sequence(F.lit(1), F.greatest((F.col("end") / step).cast("int"), F.lit(1))), lambda i: (i * step).cast("bigint")), lambda d: d < F.col("end"))
    pattern = F.transform(ages, lambda d: F.struct(d.alias("d"), _age_factor(F.filter("links", lambda x: x["dev_lag"] == d)).alias("x")))
    rows = rows.withColumn("pattern", pattern)
    good = lambda f: f.isNotNull() & (f > 0)
    reason = (
        F.when((F.col("method") != "cl") & F.exists("origins", lambda o: o["premium"].isNull()), "premium_missing")
        .when((F.col("exhausted") == "raise") & F.exists("pattern", lambda p: p["x"]["exhausted"]), "exclusions_exhausted")
        .when((F.col("unsupported") == "raise") & F.exists("pattern", lambda p: ~good(p["x"]["factor"])), "no_link_ratio")
    )
    rows = rows.withColumns({"reason": reason, "pattern": F.transform("pattern", lambda p: F.struct(p["d"].alias("d"), F.when(good(p["x"]["factor"]), p["x"]["factor"]).otherwise(F.lit(1.0)).alias("f")))})

    def developed(o: Column) -> Column:
        cdf = F.aggregate(F.filter("pattern", lambda p: p["d"] >= o["latest_dev"]), F.lit(1.0), lambda a, p: a * p["f"])
        ahead = F.aggregate(F.filter("pattern", lambda p: p["d"] == o["latest_dev"]), F.lit(1.0), lambda a, p: a * p["f"])
        return F.struct(*[o[c].alias(c) for c in ("origin_period", "latest_dev", "latest", "premium", "m")], cdf.alias("cdf"), ahead.alias("ahead"))

    def expected(o: Column) -> Column:
        # Cape Cod weighs every origin of the cohort for each: origins squared, no more.
        weight = lambda x: F.pow(F.col("decay"), F.abs(x["m"] - o["m"]) / 12)
        ratio = F.try_divide(_sum(F.col("origins"), lambda x: weight(x) * x["latest"]), _sum(F.col("origins"), lambda x: weight(x) * x["premium"] / x["cdf"]))
        return F.when(F.col("method") == "bf", F.col("elr") * o["premium"]).when(F.col("method") == "gcc", ratio * o["premium"])

    rows = rows.withColumn("origins", F.transform("origins", developed))
    rows = rows.select("candidate", "method", "reason", *keys, F.explode(F.transform("origins", lambda o: F.struct(o.alias("o"), expected(o).alias("expected")))).alias("x"))
    o, e, cl = F.col("x.o"), F.col("x.expected"), F.col("method") == "cl"
    ultimate = F.when(cl, o["latest"] * o["cdf"]).otherwise(o["latest"] + (1 - 1 / o["cdf"]) * e)
    # One step ahead: chain ladder by its factor, the others by the pattern's share of expected losses.
    ahead = F.when(cl, o["latest"] * o["ahead"]).otherwise(o["latest"] + (o["ahead"] - 1) / o["cdf"] * e)
    fine = F.col("reason").isNull()
    return rows.select("candidate", *keys, o["origin_period"].alias("origin_period"), o["latest_dev"].alias("latest_dev"), o["latest"].alias("latest"), F.when(fine, ultimate).alias("ultimate"), F.when(fine, ahead).alias("next_value"), "reason")


def snapshots(cells: DataFrame, keys: list[str], days: list[str]) -> DataFrame:
    """The cells known on each of a few days, stacked, with the day as ``snapshot``."""
    spark = cells.sparkSession
    dates = F.broadcast(spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date").alias("snapshot")))
    w = Window.partitionBy("snapshot", *keys, "origin_period", "dev_lag").orderBy(F.col("eval_date").desc())
    return cells.join(dates, F.col("eval_date") <= F.col("snapshot")).withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


#: Why an interval has no outcome, in order: the worst one of its origins is reported.
INTERVAL_REASONS = ("fit_before", "missing_origin", "fit_after", "not_next_age", "result_not_finite")


def replay_intervals(cells: DataFrame, premium: DataFrame, candidates: DataFrame, days: list[str], keys: list[str], step: int, horizon: int) -> DataFrame:
    """Every candidate refitted at every date, against what the next date showed, failures included.

    candidate, snapshot, keys, origin_period, dev_lag, expected and actual increments (``ave`` actual less
    expected), cdr (adverse positive: next ultimate less this one), remaining_revision (cdr less ave), failed.
    Every origin known on a date has a row.  An interval (candidate, snapshot, cohort) counts whole or not at
    all: ``failed`` is set on all its rows if one origin has no outcome (see ``INTERVAL_REASONS``; of a failed
    fit its own reason follows), so no subset of origins is ever scored.  Origins at the horizon stay there and
    move by their restatements only.
    """
    at = snapshots(cells, keys, days)
    fits = fit_candidates(at, premium, candidates, ["snapshot", *keys], step, horizon)
    order = {d: n for d, n in zip(days[:-1], days[1:], strict=True)}
    follow = F.create_map(*[x for d, n in order.items() for x in (F.lit(d), F.lit(n))]) if order else F.lit(None)
    # One pass over the fits: an origin's next fit is its row at the next date.
    mine = Window.partitionBy("candidate", *keys, "origin_period").orderBy("snapshot")
    nexts = {c: F.lead(c).over(mine) for c in ("snapshot", "latest_dev", "latest", "ultimate", "reason")}
    both = fits.withColumns({f"then_{c}": x for c, x in nexts.items()}).withColumn("due", F.try_element_at(follow, F.col("snapshot").cast("string")).cast("date")).where("due is not null")
    found = F.col("then_snapshot") == F.col("due")
    there = {c: F.when(found, F.col(f"then_{c}")) for c in nexts}
    to = F.least(F.col("latest_dev") + step, F.lit(horizon).cast("bigint"))
    both = both.withColumns({f"then_{c}": x for c, x in there.items() if c != "snapshot"}).withColumns({"dev_lag": to, "found": F.coalesce(found, F.lit(False))})
    both = both.withColumn("next_value", F.when(F.col("latest_dev") >= horizon, F.col("latest")).otherwise(F.col("next_value")))
    both = both.withColumns({"expected": F.col("next_value") - F.col("latest"), "actual": F.col("then_latest") - F.col("latest"), "cdr": F.col("then_ultimate") - F.col("ultimate")})
    both = both.withColumn("ave", F.col("actual") - F.col("expected")).withColumn("remaining_revision", F.col("cdr") - F.col("ave"))
    finite = F.lit(True)
    for c in ("expected", "actual", "ave", "cdr"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    code = F.when(F.col("reason").isNotNull(), 0).when(~F.col("found"), 1).when(F.col("then_reason").isNotNull(), 2).when(F.col("then_latest_dev") != F.col("dev_lag"), 3).when(~finite, 4)
    interval = Window.partitionBy("candidate", "snapshot", *keys)
    both = both.withColumn("worst", F.min(F.when(code.isNotNull(), F.struct(code.alias("code"), F.coalesce("reason", "then_reason").alias("why")))).over(interval))
    label = F.element_at(F.array(*[F.lit(r) for r in INTERVAL_REASONS]), F.col("worst.code") + 1)
    failed = F.when(F.col("worst.code").isin(0, 2), F.concat(label, F.lit(": "), F.col("worst.why"))).when(F.col("worst.code").isNotNull(), label)
    return both.select("candidate", "snapshot", *keys, "origin_period", "dev_lag", "expected", "actual", "ave", "cdr", "remaining_revision", failed.alias("failed"))


def replay(cells: DataFrame, premium: DataFrame, candidates: DataFrame, days: list[str], keys: list[str], step: int, horizon: int) -> DataFrame:
    """The intervals that have an outcome; see ``replay_intervals``."""
    return replay_intervals(cells, premium, candidates, days, keys, step, horizon).where("failed is null").drop("failed")


def replay_failures(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """candidate, snapshot, keys, reason, n_origins of the intervals without an outcome."""
    return intervals.where("failed is not null").groupBy("candidate", "snapshot", *keys).agg(F.first("failed").alias("reason"), F.count(F.lit(1)).alias("n_origins"))


def score_replay(intervals: DataFrame, metric: str = "ave") -> DataFrame:
    """candidate, snapshot, n, rmse, status: the error of a diagonal weighted by the size of its movements.

    ``intervals`` with failures: one failed interval fails the diagonal of its candidate (``failed``), which is
    never scored on what is left.
    """
    e, w = F.col(metric), F.abs("actual")
    lost = F.count_if(F.col("failed").isNotNull()) if "failed" in intervals.columns else F.lit(0)
    out = intervals.groupBy("candidate", "snapshot").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * e * e).alias("se"), F.count_if(e.isNull() | F.isnan(e)).alias("bad"), lost.alias("lost"))
    status = F.when(F.col("lost") > 0, "failed").when(F.col("bad") > 0, "nonfinite").when(F.col("w") == 0, "zero_weight").otherwise("scored")
    return out.select("candidate", "snapshot", "n", F.when(status == "scored", F.sqrt(F.try_divide("se", "w"))).alias("rmse"), status.alias("status"))


def select_conventional(scores: DataFrame, n_snapshots: int) -> DataFrame:
    """candidate, n_scored, mean_rmse, eligible, place: all diagonals are needed, ties go by name."""
    out = scores.groupBy("candidate").agg(F.count_if(F.col("status") == "scored").alias("n_scored"), F.avg("rmse").alias("mean_rmse")).withColumn("eligible", F.col("n_scored") == n_snapshots)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("eligible").desc(), F.col("mean_rmse").asc_nulls_last(), "candidate")))


def evaluate_conventional(cells: DataFrame, premium: DataFrame, candidates: DataFrame, day: str, terminal: int, keys: list[str], step: int) -> DataFrame:
    """Ultimates at the age ``terminal`` fitted on ``day`` against what it later showed: n, rmse, bias, n_failed per candidate.

    ``n_failed`` counts origins whose fit failed: they have a realized value and no forecast.
    """
    fits = fit_candidates(known_at(cells, keys, day), premium, candidates, keys, step, terminal)
    both = realized_values(cells, fits, keys, terminal).where("realized is not null")
    e = F.col("ultimate") - F.col("realized")
    return both.groupBy("candidate").agg(F.count("ultimate").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count_if(F.col("reason").isNotNull()).alias("n_failed"))
