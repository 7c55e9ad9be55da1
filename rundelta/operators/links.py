"""Link ratios, the rules that leave some out, and development factors, for every cohort at once.

A link is one origin's step from an age to the next.  All rules are windows over (cohort, age), so one
shuffle serves them; each excluded link carries the reason of the first rule that removed it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from rundelta.errors import Refusal, require_none
from rundelta.operators.triangle import any_of

AVERAGES = ("volume", "simple", "regression", "median")


@dataclass(frozen=True)
class LinkRules:
    """Which links count.  ``exclude`` has (origin date, from age), ``exclude_valuations`` dates of the later cell."""

    zero_cells: str = "missing"
    history_periods: int | None = None
    exclude: tuple[tuple[str, int], ...] = ()
    exclude_valuations: tuple[str, ...] = ()
    drop_above: float | None = None
    drop_below: float | None = None
    drop_high: int = 0
    drop_low: int = 0
    preserve: int = 1
    ties: str = "volume"
    exhausted_exclusions: str = "keep"

    def __post_init__(self):
        ok = self.zero_cells in ("missing", "observed") and self.ties in ("volume", "origin") and self.exhausted_exclusions in ("keep", "raise")
        ok &= (self.history_periods is None or self.history_periods >= 1) and min(self.drop_high, self.drop_low, self.preserve) >= 0
        if not ok:
            raise Refusal("invalid_option", str(self))

    @property
    def trims(self) -> bool:
        return self.drop_high > 0 or self.drop_low > 0

    def by_position(self) -> LinkRules:
        """Without the rules that look at sizes: what a bootstrap refit may keep."""
        return LinkRules(self.zero_cells, self.history_periods, self.exclude, self.exclude_valuations, preserve=self.preserve)


def all_links(cells: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, origin_period, dev_lag (from), eval_date (of the later cell), previous, following, ratio."""
    w = Window.partitionBy(*keys, "origin_period").orderBy("dev_lag").rangeBetween(step, step)
    out = cells.select(*keys, "origin_period", "dev_lag", F.max("eval_date").over(w).alias("eval_date"), F.col("value").alias("previous"), F.max("value").over(w).alias("following"))
    return out.where("following is not null").withColumn("ratio", F.try_divide("following", "previous"))


def select_links(cells: DataFrame, keys: list[str], step: int, rules: LinkRules | None = None) -> DataFrame:
    """All links with ``reason`` (null if included), ``included`` and the flags of rules that were skipped."""
    r = rules or LinkRules()
    links = all_links(cells, keys, step)
    age = Window.partitionBy(*keys, "dev_lag")
    live = F.col("reason").isNull()

    def mark(df: DataFrame, condition: Column, reason: str) -> DataFrame:
        return df.withColumn("reason", F.when(live & condition, F.lit(reason)).otherwise(F.col("reason")))

    links = links.withColumn("reason", F.lit(None).cast("string"))
    if r.zero_cells == "missing":
        links = mark(links, (F.col("previous") == 0) | (F.col("following") == 0), "zero_cell")
    else:
        links = mark(links, F.col("previous") == 0, "undefined_ratio")
    if r.history_periods:
        order = [F.col("origin_period").desc()] if r.zero_cells == "missing" else [live.desc(), F.col("origin_period").desc()]
        links = links.withColumn("turn", F.row_number().over(age.orderBy(*order)))
        links = mark(links, F.col("turn") > r.history_periods, "history_window").drop("turn")
    # Named exclusions hold whatever they leave; an emptied age goes to the fallback of the factors.
    links = mark(links, any_of((F.col("origin_period") == F.lit(o).cast("date")) & (F.col("dev_lag") == a) for o, a in r.exclude), "explicit_exclusion")
    if r.exclude_valuations:
        links = mark(links, F.col("eval_date").cast("string").isin(*r.exclude_valuations), "valuation_exclusion")
    high = F.lit(False) if r.drop_above is None else F.col("ratio") > r.drop_above
    low = F.lit(False) if r.drop_below is None else F.col("ratio") < r.drop_below
    out_of_bounds = high | low
    links = links.withColumn("enough", F.count_if(live & ~out_of_bounds).over(age) >= r.preserve)
    links = links.withColumn("bounds_skipped", ~F.col("enough") & (F.count_if(live & out_of_bounds).over(age) > 0))
    links = mark(mark(links, high & F.col("enough"), "drop_above"), low & F.col("enough"), "drop_below").drop("enough")
    if r.trims:
        tie = ["ratio", "previous", "origin_period"] if r.ties == "volume" else ["ratio", "origin_period"]
        links = links.withColumn("enough", F.count_if(live).over(age) - r.drop_high - r.drop_low >= r.preserve)
        links = links.withColumns({"from_low": F.row_number().over(age.orderBy(live.desc(), *tie)), "from_high": F.row_number().over(age.orderBy(live.desc(), *[F.col(t).desc() for t in tie]))})
        # An age without any live link is no exhausted rule.
        links = links.withColumn("trimming_skipped", ~F.col("enough") & (F.count_if(live).over(age) > 0))
        links = mark(mark(links, F.col("enough") & (F.col("from_low") <= r.drop_low), "drop_low"), F.col("enough") & (F.col("from_high") <= r.drop_high), "drop_high")
        links = links.drop("enough", "from_low", "from_high")
    else:
        links = links.withColumn("trimming_skipped", F.lit(False))
    links = links.withColumn("included", live)
    if r.exhausted_exclusions == "raise":
        require_none(exhausted(links, keys))
    return links


def exhausted(links: DataFrame, keys: list[str]) -> DataFrame:
    """Ages at which bounds or trims were not applied, as they would leave fewer links than ``preserve``.

    ``exhausted_exclusions='raise'`` turns the first of these down, which runs a job when links are selected.
    """
    found = links.where("bounds_skipped or trimming_skipped").groupBy(*keys, "dev_lag").agg(F.bool_or("bounds_skipped").alias("bounds"), F.count_if("included").alias("n_left"))
    return found.select(*keys, "dev_lag", F.when(F.col("bounds"), "bounds").otherwise("trims").alias("rule"), "n_left", F.lit("exclusions_exhausted").alias("reason"))


def factor_of(average: str, window: WindowSpec | None = None) -> Column:
    """The average as an aggregate, or over a window."""
    if average not in AVERAGES:
        raise Refusal("invalid_option", f"average {average!r}")
    p, f, r = F.col("previous"), F.col("following"), F.col("ratio")
    over = (lambda x: x) if window is None else (lambda x: x.over(window))
    if average == "simple":
        return over(F.avg(r))
    if average == "median":
        return over(F.median(r))
    top, below = (f, p) if average == "volume" else (p * f, p * p)
    return F.try_divide(over(F.sum(top)), over(F.sum(below)))


def usable(factor: Column) -> Column:
    """Whether a factor can develop anything."""
    return factor.isNotNull() & (factor > 0)


def link_factors(links: DataFrame, keys: list[str], average: str = "volume", unsupported: str = "unity") -> DataFrame:
    """keys, dev_lag, factor, n_selected and flags: one aggregate over the included links.

    An age without a usable factor (none left, or not positive) takes 1 and ``unity_fallback`` with
    ``unsupported='unity'``; its factor is null with ``null``; ``raise`` turns it down, which runs a job.
    """
    if unsupported not in ("unity", "null", "raise"):
        raise Refusal("invalid_option", f"unsupported {unsupported!r}")
    on = F.col("included")
    kept = links.withColumns({c: F.when(on, F.col(c)) for c in ("previous", "following", "ratio")})
    out = kept.groupBy(*keys, "dev_lag").agg(factor_of(average).alias("factor"), F.count_if(on).alias("n_selected"), F.bool_or("bounds_skipped").alias("bounds_skipped"), F.bool_or("trimming_skipped").alias("trimming_skipped"))
    bad = ~usable(F.col("factor"))
    fallback = F.lit(1.0) if unsupported == "unity" else F.lit(None).cast("double")
    out = out.withColumns({"unity_fallback": bad, "factor": F.when(bad, fallback).otherwise(F.col("factor"))})
    if unsupported == "raise":
        require_none(factor_refusals(out, keys))
    return out


def factor_refusals(factors: DataFrame, keys: list[str]) -> DataFrame:
    """Ages that ``unsupported='raise'`` turns down."""
    return factors.where("unity_fallback").select(*keys, "dev_lag", F.lit("no_link_ratio").alias("reason"))
