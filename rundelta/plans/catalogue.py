"""Every query of the engine over the star-schema tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rundelta.functions import scalars
from rundelta.functions.storage import shared_folder
from rundelta.operators import backtest as bt
from rundelta.operators import calibration, development, features, fits, glm, holdout, methods, multiline, posterior, predictive, retro, simulate
from rundelta.operators import mack as mk
from rundelta.operators import sur as sur_lines
from rundelta.operators.links import LinkRules, exhausted, link_factors, select_links
from rundelta.operators.triangle import Triangle, run_off_violations
from rundelta.operators.triangle import grid_findings as triangle_grid_findings
from rundelta.operators.triangle import inferred_step as triangle_inferred_step
from rundelta.operators.tuning import choice, tune, uniform
from rundelta.plans.oracle import CL_OUT, MACK_OUT, mack_ctes, q, rules_sql
from rundelta.sources import artifacts, marts

LOB, STEP = ["lob"], 12
CELL_KEYS = ["lob", "origin_period", "dev_lag"]
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        CATALOGUE[name or f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def cl_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("lob", "origin_period", "latest_dev", "latest", "ultimate", "ibnr"), latest=2, ultimate=2, ibnr=2)


def as_triangle(cells: DataFrame, **meta) -> Triangle:
    return Triangle(cells.withColumn("field", F.lit("paid_loss")), **meta)


# --- triangle layer -----------------------------------------------------------------------------


@query(q("SELECT lob, origin_period, dev_lag, 'paid_loss' AS field, round(CAST(paid AS DOUBLE), 4) AS value FROM inc UNION ALL SELECT lob, origin_period, dev_lag, 'claim_count', round(CAST(qty AS DOUBLE), 4) FROM inc"))
def from_long_unpivot(spark, d):
    t = marts.increments(spark, d, fields=("paid_loss", "claim_count"))
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "field", "value"), value=4)


@query(q("SELECT lob, origin_period, dev_lag, eval_date, round(value, 4) AS value FROM cells"))
def to_cumulative(spark, d):
    return rounded(marts.cells(spark, d), value=4)


@query(q("SELECT lob, origin_period, dev_lag, round(CAST(paid AS DOUBLE), 4) AS value FROM inc"))
def to_incremental(spark, d):
    t = as_triangle(marts.cells(spark, d)).to_incremental()
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "value"), value=4)


@query(q("SELECT lob, count(*) AS n, 0 AS n_off FROM cells GROUP BY lob"))
def cum_incr_round_trip(spark, d):
    t = as_triangle(marts.cells(spark, d))
    again = t.to_incremental().to_cumulative().df.select("lob", "origin_period", "dev_lag", F.col("value").alias("again"))
    both = t.df.join(again, ["lob", "origin_period", "dev_lag"], "left")
    return both.groupBy("lob").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("value") - F.coalesce("again", F.lit(0.0))) > 1e-3).cast("int").alias("n_off"))


@query(q("SELECT lob, origin_period, dev_lag, eval_date, round(value, 4) AS value FROM (SELECT *, rank() OVER (PARTITION BY lob, origin_period, dev_lag ORDER BY eval_date DESC) AS r FROM rest WHERE eval_date <= DATE '1998-12-31') WHERE r = 1"))
def as_of_restated(spark, d):
    return rounded(marts.restated(spark, d).as_of("1998-12-31").df.select("lob", "origin_period", "dev_lag", "eval_date", "value"), value=4)


@query(q("SELECT lob, origin_period, dev_lag, eval_date, round(value, 4) AS value FROM (SELECT *, rank() OVER (PARTITION BY lob, origin_period ORDER BY dev_lag DESC, eval_date DESC) AS r FROM rest) WHERE r = 1"))
def latest_diagonal(spark, d):
    return rounded(marts.restated(spark, d).latest_diagonal().df.select("lob", "origin_period", "dev_lag", "eval_date", "value"), value=4)


_QUARTERS = "qi AS (SELECT lob, make_date(year(od), 1, 1) AS origin_period, (year(sd) - year(od)) * 12 + quarter(sd) * 3 AS dev_lag, last_day(make_date(year(sd), quarter(sd) * 3, 1)) AS eval_date, sum(paid) AS paid FROM pay GROUP BY 1, 2, 3, 4)"
_BEHIND = "qb AS (SELECT *, CAST(sum(paid) OVER (PARTITION BY lob, origin_period ORDER BY dev_lag) AS DOUBLE) AS cum, (SELECT max(year(eval_date) * 12 + month(eval_date)) FROM qi) - (year(eval_date) * 12 + month(eval_date)) AS behind FROM qi)"


@query(q("SELECT lob, origin_period, CAST(dev_lag AS BIGINT) AS dev_lag, round(cum, 4) AS value FROM qb WHERE behind % 12 = 0", _QUARTERS, _BEHIND))
def dev_grain_cum(spark, d):
    t = marts.increments(spark, d, grain="Q", origin_grain="Y").to_cumulative().with_dev_grain("Y")
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "value"), value=4)


@query(q("SELECT lob, origin_period, CAST(max(dev_lag) AS BIGINT) AS dev_lag, round(CAST(sum(paid) AS DOUBLE), 4) AS value FROM qb GROUP BY lob, origin_period, behind // 12", _QUARTERS, _BEHIND))
def dev_grain_incr(spark, d):
    t = marts.increments(spark, d, grain="Q", origin_grain="Y").with_dev_grain("Y")
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "value"), value=4)


@query(q("SELECT lob, make_date(year(od), 1, 1) AS origin_period, CAST((year(sd) - year(od)) * 12 + quarter(sd) * 3 AS BIGINT) AS dev_lag, round(CAST(sum(paid) AS DOUBLE), 4) AS value FROM pay WHERE (year(sd) * 4 + quarter(sd)) >= (year(od) * 4 + quarter(od)) GROUP BY 1, 2, 3"))
def origin_grain(spark, d):
    t = marts.increments(spark, d, grain="Q").with_origin_grain("Y")
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "value"), value=4)


@query(q('SELECT origin_period, round(sum(value) FILTER (dev_lag = 12), 4) AS "12", round(sum(value) FILTER (dev_lag = 24), 4) AS "24", round(sum(value) FILTER (dev_lag = 36), 4) AS "36" FROM cells GROUP BY 1'))
def to_wide(spark, d):
    wide = as_triangle(marts.cells(spark, d)).to_wide("paid_loss", [12, 24, 36])
    return rounded(wide, **{"12": 4, "24": 4, "36": 4})


@query(q('SELECT lob, origin_period, dev_lag, eval_date, round(value, 4) AS value FROM cells WHERE dev_lag <= 36'))
def from_wide(spark, d):
    """A column per age and back."""
    c = marts.cells(spark, d)
    wide = c.groupBy("lob", "origin_period").pivot("dev_lag", [12, 24, 36]).agg(F.sum("value"))
    return rounded(Triangle.from_wide(wide, segments=LOB).df.select("lob", "origin_period", "dev_lag", "eval_date", "value"), value=4)


@query(q("SELECT 'paid_loss' AS field, count(*) AS n_cells, count(DISTINCT lob) AS n_cohorts, count(DISTINCT origin_period) AS n_origins, count(DISTINCT dev_lag) AS n_ages, min(origin_period) AS first_origin_period, max(origin_period) AS last_origin_period, min(dev_lag) AS first_dev_lag, max(dev_lag) AS last_dev_lag, min(eval_date) AS first_eval_date, max(eval_date) AS last_eval_date FROM cells"))
def triangle_summary(spark, d):
    return as_triangle(marts.cells(spark, d)).summary()


@query(q("SELECT lob, min(gap) AS step FROM (SELECT lob, dev_lag - lag(dev_lag) OVER (PARTITION BY lob ORDER BY dev_lag) AS gap FROM (SELECT DISTINCT lob, dev_lag FROM cells)) GROUP BY lob"))
def inferred_step(spark, d):
    return triangle_inferred_step(marts.cells(spark, d), LOB)


@query(q("SELECT lob, origin_period, dev_lag, round(greatest(value - 5000000, 0), 4) AS clamped, round(greatest(value / 1e6 - 5, 0) + ln(1 + exp(-abs(value / 1e6 - 5))), 6) AS soft, last_day(origin_period + to_months(CAST(dev_lag - 1 AS INTEGER))) AS ends, round(pow(dev_lag - 6, 1.5) / (pow(dev_lag - 6, 1.5) + pow(24, 1.5)), 6) AS loglogistic, round(1 - exp(-pow((dev_lag - 6) / 24.0, 1.5)), 6) AS weibull FROM cells"))
def scalar_functions(spark, d):
    v, age = F.col("value"), F.col("dev_lag") - 6
    out = marts.cells(spark, d).select(*CELL_KEYS, F.greatest(v - 5000000, F.lit(0.0)).alias("clamped"), scalars.softplus(v / 1e6 - 5).alias("soft"), scalars.month_end(F.col("origin_period"), F.col("dev_lag")).alias("ends"), scalars.growth_share(age, 1.5, 24, "loglogistic").alias("loglogistic"), scalars.growth_share(age, 1.5, 24, "weibull").alias("weibull"))
    return rounded(out, clamped=4, soft=6, loglogistic=6, weibull=6)


@query(q("SELECT lob, origin_period, dev_lag, 'claim_count' AS field, round(CAST(qty AS DOUBLE), 4) AS value FROM inc"))
def select_fields(spark, d):
    t = marts.increments(spark, d, fields=("paid_loss", "claim_count")).select_fields("claim_count")
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "field", "value"), value=4)


@query(q("SELECT lob, origin_period, dev_lag, round(value, 4) AS value FROM cells WHERE lob = 'BUILDING' AND dev_lag <= 36"))
def filter_segment(spark, d):
    t = as_triangle(marts.cells(spark, d)).filter(F.col("lob") == "BUILDING", "dev_lag <= 36")
    return rounded(t.df.select("lob", "origin_period", "dev_lag", "value"), value=4)


@query("SELECT 'claim_count' AS field UNION ALL SELECT 'paid_loss'")
def fields_distinct(spark, d):
    return marts.increments(spark, d, fields=("paid_loss", "claim_count")).distinct("field")


_SPOILT = """bad AS (
  SELECT CASE WHEN year(origin_period) = 1998 AND dev_lag = 12 THEN NULL ELSE lob END AS lob, origin_period,
         CASE WHEN year(origin_period) = 1999 AND dev_lag = 12 THEN 13 ELSE dev_lag END AS dev_lag, eval_date, value FROM cells
  UNION ALL SELECT lob, origin_period, dev_lag, eval_date, value FROM cells WHERE year(origin_period) = 1996 AND dev_lag = 24
  UNION ALL SELECT lob, origin_period, dev_lag, make_date(year(eval_date) + 1, 12, 31), value FROM cells WHERE year(origin_period) = 1997 AND dev_lag = 12)"""


@query(
    q(
        """SELECT 'null_values' AS "check", count(*) FILTER (value IS NULL OR origin_period IS NULL OR dev_lag IS NULL OR eval_date IS NULL) AS n FROM bad
UNION ALL SELECT 'null_segments', count(*) FILTER (lob IS NULL) FROM bad
UNION ALL SELECT 'duplicate_cells', count(*) FROM (SELECT 1 FROM bad GROUP BY lob, origin_period, dev_lag, eval_date HAVING count(*) > 1)
UNION ALL SELECT 'restated_cells', count(*) FROM (SELECT 1 FROM bad GROUP BY lob, origin_period, dev_lag HAVING count(DISTINCT eval_date) > 1)
UNION ALL SELECT 'eval_alignment', count(*) FILTER ((year(eval_date) - year(origin_period)) * 12 + month(eval_date) - month(origin_period) + 1 <> dev_lag) FROM bad
UNION ALL SELECT 'dev_lag_on_grain', count(*) FILTER (dev_lag <= 0 OR dev_lag % 12 <> 0) FROM bad""",
        _SPOILT,
    )
)
def validate_findings(spark, d):
    c = marts.cells(spark, d)
    y = F.year("origin_period")
    bad = c.withColumns({"lob": F.when((y == 1998) & (F.col("dev_lag") == 12), F.lit(None)).otherwise(F.col("lob")), "dev_lag": F.when((y == 1999) & (F.col("dev_lag") == 12), 13).otherwise(F.col("dev_lag"))})
    twice = c.where((y == 1996) & (F.col("dev_lag") == 24))
    later = c.where((y == 1997) & (F.col("dev_lag") == 12)).withColumn("eval_date", F.add_months("eval_date", 12))
    return as_triangle(bad.unionByName(twice).unionByName(later)).findings_frame()


@query(q("SELECT lob, 0 AS violations FROM cells GROUP BY lob"))
def run_off_check(spark, d):
    c = marts.cells(spark, d)
    found = run_off_violations(c, LOB, STEP).groupBy("lob").agg(F.count(F.lit(1)).alias("v"))
    return c.select("lob").distinct().join(found, "lob", "left").select("lob", F.coalesce("v", F.lit(0)).cast("int").alias("violations"))


_GRID_SPOILT = "gs AS (SELECT lob, CASE WHEN year(origin_period) = 1997 THEN origin_period + INTERVAL 14 DAY ELSE origin_period END::DATE AS origin_period, dev_lag, eval_date, CASE WHEN dev_lag = 12 AND year(origin_period) = 1996 THEN 'nan'::DOUBLE ELSE value END AS value FROM cells WHERE NOT (year(origin_period) = 1998 AND dev_lag = 24))"


@query(
    q(
        """SELECT lob, 'not_finite' AS reason, count(*) AS n FROM gs WHERE isnan(value) GROUP BY 1
UNION ALL SELECT lob, 'unreadable_label', count(DISTINCT origin_period) FROM gs WHERE day(origin_period) <> 1 GROUP BY 1
UNION ALL SELECT lob, 'not_run_off', count(*) FROM (SELECT lob, origin_period, count(*) AS n, max(dev_lag) // 12 AS k FROM gs GROUP BY 1, 2) WHERE n <> k GROUP BY 1""",
        _GRID_SPOILT,
    )
)
def grid_findings(spark, d):
    c, y = marts.cells(spark, d), F.year("origin_period")
    bad = c.where(~((y == 1998) & (F.col("dev_lag") == 24))).withColumn("value", F.when((y == 1996) & (F.col("dev_lag") == 12), float("nan")).otherwise(F.col("value")))
    bad = bad.withColumn("origin_period", F.when(F.year("origin_period") == 1997, F.date_add("origin_period", 14)).otherwise(F.col("origin_period")))
    return triangle_grid_findings(bad, LOB, STEP)


@query(q("SELECT lob, origin_period, round(premium, 2) AS premium FROM prem"))
def premium_by_origin(spark, d):
    return rounded(marts.premiums(spark, d), premium=2)


@query(q("SELECT l.lob, l.origin_period, round(c.value, 4) AS realized FROM lat l LEFT JOIN cells c ON l.lob = c.lob AND l.origin_period = c.origin_period AND c.dev_lag = 48"))
def realized_values(spark, d):
    c = marts.cells(spark, d)
    return rounded(bt.realized_values(c, c.select("lob", "origin_period").distinct(), LOB, 48), realized=4)


# --- links --------------------------------------------------------------------------------------


@query(q("SELECT lob, origin_period, dev_lag, eval_date, round(previous, 4) AS previous, round(following, 4) AS following, round(ratio, 6) AS ratio FROM links"))
def link_ratios(spark, d):
    out = select_links(marts.cells(spark, d), LOB, STEP)
    return rounded(out.select("lob", "origin_period", "dev_lag", "eval_date", "previous", "following", "ratio"), previous=4, following=4, ratio=6)


def reasons(spark, d, rules, cells=None):
    out = select_links(marts.cells(spark, d) if cells is None else cells, LOB, STEP, rules)
    return rounded(out.select("lob", "origin_period", "dev_lag", "ratio", "included", "reason"), ratio=6)


@query(q(rules_sql("SELECT *, CASE WHEN row_number() OVER (PARTITION BY lob, dev_lag ORDER BY origin_period DESC) > 3 THEN 'history_window' END AS reason FROM links")))
def link_reasons_history(spark, d):
    return reasons(spark, d, LinkRules(history_periods=3))


@query(
    q(
        rules_sql(
            """SELECT *, CASE WHEN n - 2 < 1 THEN NULL WHEN lo <= 1 THEN 'drop_low' WHEN hi <= 1 THEN 'drop_high' END AS reason FROM (
  SELECT *, count(*) OVER (PARTITION BY lob, dev_lag) AS n, row_number() OVER (PARTITION BY lob, dev_lag ORDER BY ratio, previous, origin_period) AS lo,
         row_number() OVER (PARTITION BY lob, dev_lag ORDER BY ratio DESC, previous DESC, origin_period DESC) AS hi FROM links)"""
        )
    )
)
def link_reasons_trim(spark, d):
    return reasons(spark, d, LinkRules(drop_high=1, drop_low=1))


@query(
    q(
        rules_sql(
            """SELECT *, CASE WHEN ok < 2 THEN NULL WHEN ratio > 1.5 THEN 'drop_above' WHEN ratio < 1.1 THEN 'drop_below' END AS reason FROM (
  SELECT *, count(*) FILTER (ratio <= 1.5 AND ratio >= 1.1) OVER (PARTITION BY lob, dev_lag) AS ok FROM links)"""
        )
    )
)
def link_reasons_bounds(spark, d):
    return reasons(spark, d, LinkRules(drop_above=1.5, drop_below=1.1, preserve=2))


@query(
    q(
        rules_sql(
            """SELECT *, CASE WHEN (origin_period = DATE '1996-01-01' AND dev_lag = 12) OR (origin_period = DATE '1995-01-01' AND dev_lag = 72) THEN 'explicit_exclusion' WHEN eval_date = DATE '1999-12-31' THEN 'valuation_exclusion' END AS reason FROM links"""
        )
    )
)
def link_reasons_exclude(spark, d):
    """Named exclusions, one of which leaves the last age without a link."""
    return reasons(spark, d, _EXCLUDE)


_EXCLUDE = LinkRules(exclude=(("1996-01-01", 12), ("1995-01-01", 72)), exclude_valuations=("1999-12-31",))


@query(
    q(
        "SELECT lob, dev_lag, round(coalesce(sum(following) FILTER (kept) / sum(previous) FILTER (kept), 1.0), 6) AS factor, count(*) FILTER (kept) AS n_selected, count(*) FILTER (kept) = 0 AS unity_fallback FROM (SELECT *, NOT ((origin_period = DATE '1996-01-01' AND dev_lag = 12) OR (origin_period = DATE '1995-01-01' AND dev_lag = 72) OR eval_date = DATE '1999-12-31') AS kept FROM links) GROUP BY 1, 2"
    )
)
def factors_of_emptied_ages(spark, d):
    out = link_factors(select_links(marts.cells(spark, d), LOB, STEP, _EXCLUDE), LOB)
    return rounded(out.select("lob", "dev_lag", "factor", "n_selected", "unity_fallback"), factor=6)


_ZERO = "CASE WHEN origin_period = DATE '1997-01-01' AND dev_lag = 12 THEN 0.0 ELSE {0} END"


@query(
    q(
        rules_sql("SELECT lob, origin_period, dev_lag, following / nullif(previous, 0) AS ratio, CASE WHEN previous = 0 OR following = 0 THEN 'zero_cell' END AS reason FROM zl"),
        "zl AS (SELECT lob, origin_period, dev_lag, following, " + _ZERO.format("previous") + " AS previous FROM links)",
    )
)
def link_reasons_zero(spark, d):
    c = marts.cells(spark, d)
    zero = (F.col("origin_period") == F.lit("1997-01-01").cast("date")) & (F.col("dev_lag") == 12)
    return reasons(spark, d, LinkRules(zero_cells="missing"), c.withColumn("value", F.when(zero, 0.0).otherwise(F.col("value"))))


@query(q("SELECT lob, dev_lag, 'trims' AS rule, count(*) AS n_left, 'exclusions_exhausted' AS reason FROM links GROUP BY lob, dev_lag HAVING count(*) - 3 < 2"))
def links_exhausted(spark, d):
    """Ages that ``exhausted_exclusions='raise'`` turns down: two links have to stay after three are trimmed."""
    return exhausted(select_links(marts.cells(spark, d), LOB, STEP, LinkRules(drop_high=2, drop_low=1, preserve=2)), LOB)


def factors(average):
    def run(spark, d):
        out = link_factors(select_links(marts.cells(spark, d), LOB, STEP), LOB, average)
        return rounded(out.select("lob", "dev_lag", "factor", "n_selected"), factor=6)

    return run


for _name, _sql in (("volume", "sum(following) / sum(previous)"), ("simple", "avg(ratio)"), ("regression", "sum(previous * following) / sum(previous * previous)"), ("median", "median(ratio)")):
    query(q(f"SELECT lob, dev_lag, round({_sql}, 6) AS factor, count(*) AS n_selected FROM links GROUP BY 1, 2"), f"factors_{_name}")(factors(_name))


# --- methods ------------------------------------------------------------------------------------


@query(q("SELECT lob, dev_lag, round(factor, 6) AS factor, round(cdf, 6) AS cdf, round(1 / cdf, 6) AS pct_reported FROM pat"))
def development_pattern(spark, d):
    f = link_factors(select_links(marts.cells(spark, d), LOB, STEP), LOB)
    return rounded(methods.pattern(f, LOB).select("lob", "dev_lag", "factor", "cdf", "pct_reported"), factor=6, cdf=6, pct_reported=6)


@query(q(f"SELECT {CL_OUT.format(u='ultimate')} FROM cl"))
def chain_ladder(spark, d):
    return cl_out(methods.chain_ladder(marts.cells(spark, d), LOB, STEP))


@query(q("SELECT lob, round(sum(latest), 2) AS latest, round(sum(ultimate), 2) AS ultimate, round(sum(ibnr), 2) AS ibnr FROM cl GROUP BY ROLLUP (lob)"))
def chain_ladder_totals(spark, d):
    return rounded(methods.totals(methods.chain_ladder(marts.cells(spark, d), LOB, STEP), LOB), latest=2, ultimate=2, ibnr=2)


@query(q(f"SELECT {CL_OUT.format(u='ultimate')} FROM (SELECT *, latest + (1 - beta) * premium * 0.6 AS ultimate FROM dp)"))
def bornhuetter_ferguson(spark, d):
    return cl_out(methods.bornhuetter_ferguson(marts.cells(spark, d), marts.premiums(spark, d), LOB, STEP, 0.6))


@query(q(f"SELECT {CL_OUT.format(u='ultimate')} FROM (SELECT *, latest + (1 - beta) * (latest + (1 - beta) * (latest + (1 - beta) * premium * 0.6)) AS ultimate FROM dp)"))
def benktander(spark, d):
    return cl_out(methods.benktander(marts.cells(spark, d), marts.premiums(spark, d), LOB, STEP, 0.6, n_iters=3))


def _cape_cod(decay: float, trend: float) -> str:
    ratio = f"""tr AS (SELECT *, pow({1 + trend}, (max(m + latest_dev) OVER (PARTITION BY lob) - m - 12) / 12.0) AS t FROM dp),
er AS (SELECT a.lob, a.origin_period, sum(pow({decay}, abs(a.m - b.m) / 12.0) * b.latest * b.t) / sum(pow({decay}, abs(a.m - b.m) / 12.0) * b.premium * b.beta) / a.t AS elr
       FROM tr a JOIN tr b ON a.lob = b.lob GROUP BY a.lob, a.origin_period, a.t)"""
    return q(f"SELECT {CL_OUT.format(u='ultimate')}, round(elr, 6) AS elr FROM (SELECT d.*, e.elr, latest + (1 - beta) * premium * elr AS ultimate FROM dp d JOIN er e ON d.lob = e.lob AND d.origin_period = e.origin_period)", ratio)


def _run_cape_cod(spark, d, decay, trend):
    out = methods.cape_cod(marts.cells(spark, d), marts.premiums(spark, d), LOB, STEP, decay, trend)
    return rounded(out.select("lob", "origin_period", "latest_dev", "latest", "ultimate", "ibnr", F.col("expected_loss_ratio").alias("elr")), latest=2, ultimate=2, ibnr=2, elr=6)


@query(_cape_cod(0.75, 0.0))
def cape_cod(spark, d):
    return _run_cape_cod(spark, d, 0.75, 0.0)


@query(_cape_cod(1.0, 0.03))
def cape_cod_trend(spark, d):
    return _run_cape_cod(spark, d, 1.0, 0.03)


@query(q(f"SELECT {CL_OUT.format(u='ultimate')} FROM (SELECT *, latest * cdf * 1.05 AS ultimate FROM dvl)"))
def tail_constant(spark, d):
    c = marts.cells(spark, d)
    return cl_out(methods.chain_ladder(c, LOB, STEP, tail=methods.constant_tail(c, LOB, 1.05)))


_CURVES = {
    "exponential": ("ln(factor - 1)", "dev_lag / 12.0", "slope < 0", "exp(intercept + slope * t)"),
    "inverse_power": ("ln(factor - 1)", "ln(dev_lag / 12.0)", "slope < -1", "exp(intercept) * pow(t, slope)"),
    "weibull": ("ln(ln(factor / (factor - 1)))", "ln(dev_lag / 12.0)", "slope > 0", "1 / (exp(exp(intercept) * pow(t, slope)) - 1)"),
}


def _curve(curve):
    def run(spark, d):
        f = link_factors(select_links(marts.cells(spark, d), LOB, STEP), LOB)
        return rounded(methods.curve_tail(f, LOB, STEP, curve), intercept=6, slope=6, tail_factor=6)

    return run


for _name, (_y, _x, _ok, _term) in _CURVES.items():
    query(
        q(
            f"""SELECT lob, round(intercept, 6) AS intercept, round(slope, 6) AS slope, n_fit,
  round(CASE WHEN n_fit >= 2 AND {_ok} THEN (SELECT exp(sum(ln(1 + {_term}))) FROM (SELECT CAST(unnest(generate_series(n + 1, n + 100)) AS DOUBLE) AS t)) END, 6) AS tail_factor,
  CASE WHEN n_fit < 2 THEN 'not_identified' WHEN NOT coalesce({_ok}, false) THEN 'tail_not_decaying' END AS reason FROM tf""",
            f"tf AS (SELECT lob, CAST(max(dev_lag) // 12 AS BIGINT) AS n, count(*) FILTER (factor > 1.00001) AS n_fit, regr_slope({_y}, {_x}) FILTER (factor > 1.00001) AS slope, regr_intercept({_y}, {_x}) FILTER (factor > 1.00001) AS intercept FROM fac GROUP BY lob)",
        ),
        f"tail_{_name}",
    )(_curve(_name))


# --- uncertainty --------------------------------------------------------------------------------


@query(q("SELECT lob, dev_lag, round(f, 6) AS factor, n, round(v, 2) AS sigma2, extrapolated AS sigma_extrapolated FROM mg", *mack_ctes("volume")))
def mack_sigma(spark, d):
    out = mk.mack_factors(marts.cells(spark, d), LOB, STEP, sigma_rule="mack")
    return rounded(out.select("lob", "dev_lag", "factor", "n", "sigma2", "sigma_extrapolated"), factor=6, sigma2=2)


def _mack(average):
    def run(spark, d):
        out = mk.mack(marts.cells(spark, d), LOB, STEP, average, "mack").drop("ibnr")
        return rounded(out, latest=2, ultimate=2, process_se=3, parameter_se=3, mack_se=3)

    return run


for _name, _average in (("mack_se", "volume"), ("mack_simple", "simple"), ("mack_regression", "regression")):
    query(q(MACK_OUT, *mack_ctes(_average)), _name)(_mack(_average))


@query(
    q(
        """SELECT a.lob, round(sum(a.latest), 2) AS latest, round(sum(a.ultimate), 2) AS ultimate,
  round(sqrt(sum(a.ultimate * a.ultimate * (a.process + a.parameter) + 2 * a.ultimate * a.later * coalesce(s.shared, 0))), 3) AS mack_se FROM (
  SELECT *, coalesce(sum(ultimate) OVER (PARTITION BY lob ORDER BY origin_period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM mo) a
  LEFT JOIN (SELECT lob, dev_lag, sum(v / (f * f) / s) OVER (PARTITION BY lob ORDER BY dev_lag DESC) AS shared FROM mg) s ON a.lob = s.lob AND a.latest_dev = s.dev_lag GROUP BY a.lob""",
        *mack_ctes("volume"),
    )
)
def mack_total(spark, d):
    out = mk.mack_totals(marts.cells(spark, d), LOB, STEP, sigma_rule="mack").drop("ibnr")
    return rounded(out, latest=2, ultimate=2, mack_se=3)


_TAIL = 1.05
_TAIL_CTES = [
    *mack_ctes("volume"),
    "tl AS (SELECT lob, regr_slope(ln(f - 1), dev_lag / 12.0) FILTER (f > 1) AS fs, regr_intercept(ln(f - 1), dev_lag / 12.0) FILTER (f > 1) AS fb, regr_slope(ln(v) / 2, dev_lag / 12.0) FILTER (v > 0) AS ss, regr_intercept(ln(v) / 2, dev_lag / 12.0) FILTER (v > 0) AS sb, regr_slope(ln(v / s) / 2, dev_lag / 12.0) FILTER (v > 0) AS es, regr_intercept(ln(v / s) / 2, dev_lag / 12.0) FILTER (v > 0) AS eb FROM mg GROUP BY lob)",
    f"tp AS (SELECT *, (ln({_TAIL} - 1) - fb) / fs AS p FROM tl)",
    "tv AS (SELECT lob, p, exp(2 * (sb + ss * p)) AS ts, exp(2 * (eb + es * p)) AS te FROM tp)",
    f"tm AS (SELECT o.lob, o.origin_period, o.latest, o.ultimate * {_TAIL} AS ultimate, o.process + v.ts / ({_TAIL} * {_TAIL}) / o.ultimate AS process, o.parameter + v.te / ({_TAIL} * {_TAIL}) AS parameter FROM mo o JOIN tv v ON o.lob = v.lob)",
]


@query(q(f"SELECT lob, {_TAIL} AS tail_factor, round(p, 6) AS position, round(ts, 4) AS tail_sigma2, round(te, 12) AS tail_se2, CAST(NULL AS VARCHAR) AS reason FROM tv", *_TAIL_CTES))
def mack_tail_variance(spark, d):
    c = marts.cells(spark, d)
    out = mk.tail_variance(mk.mack_factors(c, LOB, STEP, sigma_rule="mack"), LOB, STEP, methods.constant_tail(c, LOB, _TAIL))
    return rounded(out, position=6, tail_sigma2=4, tail_se2=12)


@query(q("SELECT lob, origin_period, round(latest, 2) AS latest, round(ultimate, 2) AS ultimate, round(ultimate * sqrt(process), 3) AS process_se, round(ultimate * sqrt(parameter), 3) AS parameter_se, round(ultimate * sqrt(process + parameter), 3) AS mack_se FROM tm", *_TAIL_CTES))
def mack_tail(spark, d):
    c = marts.cells(spark, d)
    out = mk.mack(c, LOB, STEP, sigma_rule="mack", tail=methods.constant_tail(c, LOB, _TAIL))
    return rounded(out.drop("ibnr", "latest_dev"), latest=2, ultimate=2, process_se=3, parameter_se=3, mack_se=3)


@query(q("SELECT lob, round(sum(ultimate), 2) AS ultimate, round(sqrt(sum(ultimate * ultimate * (process + parameter) + 2 * ultimate * later * parameter)), 3) AS mack_se FROM (SELECT *, coalesce(sum(ultimate) OVER (PARTITION BY lob ORDER BY origin_period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM tm) GROUP BY lob", *_TAIL_CTES))
def mack_tail_total(spark, d):
    c = marts.cells(spark, d)
    out = mk.mack_totals(c, LOB, STEP, sigma_rule="mack", tail=methods.constant_tail(c, LOB, _TAIL))
    return rounded(out.select("lob", "ultimate", "mack_se"), ultimate=2, mack_se=3)


@query(q("SELECT l.lob, l.origin_period, l.latest_dev + 12 AS dev_lag, round(l.latest, 2) AS latest, round(l.latest * f, 2) AS mean, round(sqrt(v * l.latest), 3) AS process_sd, round(l.latest * sqrt(v / s), 3) AS parameter_sd FROM lat l JOIN mg ON l.lob = mg.lob AND l.latest_dev = mg.dev_lag", *mack_ctes("volume")))
def mack_next_cells(spark, d):
    return rounded(mk.next_cells(marts.cells(spark, d), LOB, STEP, sigma_rule="mack"), latest=2, mean=2, process_sd=3, parameter_sd=3)


_CDR = [
    *mack_ctes("volume"),
    "ca AS (SELECT g.*, g.v / (g.f * g.f) AS ratio, l.latest AS c FROM mg g LEFT JOIN lat l ON g.lob = l.lob AND g.dev_lag = l.latest_dev)",
    "cb AS (SELECT *, coalesce(sum(coalesce(c / (s + c) * ratio / s, 0)) OVER (PARTITION BY lob ORDER BY dev_lag DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beyond FROM ca)",
    "cr AS (SELECT o.lob, o.origin_period, o.latest, o.ultimate, coalesce(b.ratio / b.c + b.ratio / b.s + b.beyond, 0) AS own, coalesce(b.ratio / b.s + b.beyond, 0) AS tied, coalesce(sum(o.ultimate) OVER (PARTITION BY o.lob ORDER BY o.origin_period DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM mo o LEFT JOIN cb b ON o.lob = b.lob AND o.latest_dev = b.dev_lag)",
]


@query(q("SELECT lob, origin_period, round(latest, 2) AS latest, round(ultimate, 2) AS ultimate, round(ultimate * sqrt(own), 3) AS cdr_se FROM cr", *_CDR))
def one_year_cdr(spark, d):
    out, _ = mk.one_year_cdr(marts.cells(spark, d), LOB, STEP)
    return rounded(out.drop("ibnr"), latest=2, ultimate=2, cdr_se=3)


@query(q("SELECT lob, round(sqrt(sum(ultimate * ultimate * own + 2 * ultimate * later * tied)), 3) AS cdr_se FROM cr GROUP BY lob", *_CDR))
def one_year_cdr_total(spark, d):
    _, out = mk.one_year_cdr(marts.cells(spark, d), LOB, STEP)
    return rounded(out.drop("ibnr"), cdr_se=3)


_ODP = [
    "oa AS (SELECT c.lob, c.origin_period, c.dev_lag, c.value, cl.ultimate / coalesce(p.cdf, 1.0) AS fit FROM cells c JOIN cl ON c.lob = cl.lob AND c.origin_period = cl.origin_period LEFT JOIN pat p ON c.lob = p.lob AND c.dev_lag = p.dev_lag)",
    "ob AS (SELECT lob, origin_period, dev_lag, value - coalesce(lag(value) OVER w, 0) AS x, fit - coalesce(lag(fit) OVER w, 0) AS m FROM oa WINDOW w AS (PARTITION BY lob, origin_period ORDER BY dev_lag))",
]


@query(q("SELECT lob, origin_period, dev_lag, round(x, 4) AS increment, round(m, 2) AS fitted, round((x - m) / sqrt(abs(m)), 4) + 0.0 AS pearson FROM ob", *_ODP))
def odp_residuals(spark, d):
    out = rounded(simulate.odp_residuals(marts.cells(spark, d), LOB, STEP), increment=4, fitted=2, pearson=4)
    return out.withColumn("pearson", F.col("pearson") + 0.0)


@query(q("SELECT lob, count(*) AS n, count(DISTINCT origin_period) + count(DISTINCT dev_lag) - 1 AS p, round(sum(pow(x - m, 2) / abs(m)) / (count(*) - (count(DISTINCT origin_period) + count(DISTINCT dev_lag) - 1)), 2) AS phi FROM ob GROUP BY lob", *_ODP))
def odp_phi(spark, d):
    return rounded(simulate.odp_phi(simulate.odp_residuals(marts.cells(spark, d), LOB, STEP), LOB), phi=2)


# --- backtests ----------------------------------------------------------------------------------

_DAY = "1999-12-31"
_HOLD = [
    f"tr0 AS (SELECT * FROM cells WHERE eval_date <= DATE '{_DAY}')",
    f"fr0 AS (SELECT c.*, min(c.eval_date) OVER (PARTITION BY c.lob) AS first FROM cells c LEFT JOIN tr0 t ON c.lob = t.lob AND c.origin_period = t.origin_period AND c.dev_lag = t.dev_lag WHERE c.eval_date > DATE '{_DAY}' AND t.lob IS NULL)",
    """ho AS (SELECT f.lob, f.origin_period, f.dev_lag, f.eval_date, f.value, CASE WHEN f.dev_lag = 12 THEN 0.0 ELSE t.value END AS prev_value,
  CASE WHEN NOT EXISTS (SELECT 1 FROM tr0 o WHERE o.lob = f.lob AND o.origin_period = f.origin_period) THEN 'new_origin'
       WHEN f.dev_lag > (SELECT max(dev_lag) FROM tr0 o WHERE o.lob = f.lob) THEN 'dev_beyond_trained'
       WHEN f.dev_lag <> 12 AND t.value IS NULL THEN 'no_predecessor' END AS excluded
  FROM fr0 f LEFT JOIN tr0 t ON f.lob = t.lob AND f.origin_period = t.origin_period AND f.dev_lag = t.dev_lag + 12 WHERE f.eval_date = f.first)""",
]


@query(q("SELECT lob, origin_period, dev_lag, eval_date, round(value, 4) AS value, round(prev_value, 4) AS prev_value, excluded, excluded IS NULL AS scored FROM ho", *_HOLD))
def next_diagonal(spark, d):
    return rounded(bt.next_diagonal(marts.cells(spark, d), LOB, STEP, _DAY), value=4, prev_value=4).select("lob", "origin_period", "dev_lag", "eval_date", "value", "prev_value", "excluded", "scored")


@query(q("SELECT lob, coalesce(excluded, 'scored') AS outcome, count(*) AS n FROM ho GROUP BY 1, 2", *_HOLD))
def holdout_exclusions(spark, d):
    out = bt.next_diagonal(marts.cells(spark, d), LOB, STEP, _DAY)
    return out.groupBy("lob", F.coalesce("excluded", F.lit("scored")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_PRED = [
    *_HOLD,
    "tf0 AS (SELECT a.lob, a.dev_lag, sum(b.value) / sum(a.value) AS f FROM tr0 a JOIN tr0 b ON a.lob = b.lob AND a.origin_period = b.origin_period AND b.dev_lag = a.dev_lag + 12 GROUP BY 1, 2)",
    "pr AS (SELECT h.lob, h.origin_period, h.dev_lag, h.prev_value * t.f AS predicted, h.value AS actual, h.prev_value FROM ho h JOIN tf0 t ON h.lob = t.lob AND h.dev_lag = t.dev_lag + 12 WHERE h.excluded IS NULL)",
]


def predictions(spark, d):
    """One step ahead by chain ladder from what was known, against the next diagonal."""
    c = marts.cells(spark, d)
    f = link_factors(select_links(bt.known_at(c, LOB, _DAY), LOB, STEP), LOB).select("lob", (F.col("dev_lag") + STEP).alias("dev_lag"), "factor")
    held = bt.next_diagonal(c, LOB, STEP, _DAY).where("scored").join(f, ["lob", "dev_lag"])
    return held.select("lob", "origin_period", "dev_lag", (F.col("prev_value") * F.col("factor")).alias("predicted"), F.col("value").alias("actual"), "prev_value")


@query(q("SELECT lob, round(avg(abs(predicted - actual)), 2) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 2) AS rmse, round(sqrt(sum(abs(actual) * pow(predicted - actual, 2)) / sum(abs(actual))), 2) AS wrmse, round(avg(abs(predicted - actual) / abs(actual)), 6) AS mape, round(median(abs(predicted - actual) / abs(actual)), 6) AS medape, round(sum(abs(predicted - actual)) / sum(actual), 6) AS pool_ape, round(sum(predicted - actual) / sum(actual), 6) AS pool_pe, round(avg(CASE WHEN predicted > actual THEN 1.0 ELSE 0.0 END), 6) AS prop_over FROM pr GROUP BY lob", *_PRED))
def point_metrics(spark, d):
    out = predictions(spark, d).groupBy("lob").agg(*bt.point_metrics(F.col("predicted"), F.col("actual")))
    return rounded(out, mae=2, rmse=2, wrmse=2, mape=6, medape=6, pool_ape=6, pool_pe=6, prop_over=6)


@query(q("SELECT dev_lag, round(sum(predicted), 2) AS predicted, round(sum(actual), 4) AS actual, round(abs(sum(predicted) - sum(actual)), 2) AS abs_error FROM pr GROUP BY 1", *_PRED))
def level_errors(spark, d):
    out = bt.level_errors(predictions(spark, d), ["dev_lag"]).select("dev_lag", "predicted", "actual", "abs_error")
    return rounded(out, predicted=2, actual=4, abs_error=2)


@query(q("SELECT lob, origin_period, round(prev_value + 0.7 * (predicted - prev_value), 2) AS blend FROM pr", *_PRED))
def shrink_toward(spark, d):
    return rounded(predictions(spark, d).select("lob", "origin_period", bt.shrink_toward(F.col("predicted"), F.col("prev_value"), 0.7).alias("blend")), blend=2)


_DAYS = ["1998-12-31", "1999-12-31", "2000-12-31", "2001-12-31"]
_HORIZON = 48
_GRID = [
    bt.Candidate("cl_all", "cl"),
    bt.Candidate("cl_h3", "cl", 3),
    bt.Candidate("cl_hi1", "cl", drop_high=1, exhausted="keep"),
    bt.Candidate("cl_strict", "cl", drop_high=1, drop_low=1),
    bt.Candidate("bf06", "bf", expected_loss_ratio=0.6),
    bt.Candidate("gcc075", "gcc", decay=0.75),
]


def _fit_ctes(cells: str, snap: str) -> list[str]:
    rows = ", ".join(f"('{c.name}', '{c.method}', {c.history_periods}, {c.drop_high}, {c.drop_low}, {c.expected_loss_ratio:f}, {c.decay:f}, '{c.exhausted}')" for c in _GRID)
    return [
        f"grid(candidate, method, history, high, low, elr, decay, exhausted) AS (VALUES {rows})",
        f"hc AS (SELECT * FROM {cells} WHERE dev_lag <= {_HORIZON})",
        f"sl AS (SELECT g.candidate, g.history, g.high, g.low, a.{snap}, a.lob, a.origin_period, a.dev_lag, a.value AS previous, b.value AS following, b.value / a.value AS ratio FROM hc a JOIN hc b ON a.{snap} = b.{snap} AND a.lob = b.lob AND a.origin_period = b.origin_period AND b.dev_lag = a.dev_lag + 12 CROSS JOIN grid g WHERE a.value > 0)",
        f"sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, {snap}, lob, dev_lag ORDER BY origin_period DESC) AS turn FROM sl) WHERE turn <= history)",
        f"sk AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY candidate, {snap}, lob, dev_lag ORDER BY ratio, origin_period) AS lo, row_number() OVER (PARTITION BY candidate, {snap}, lob, dev_lag ORDER BY ratio DESC, origin_period DESC) AS hi FROM sh WINDOW p AS (PARTITION BY candidate, {snap}, lob, dev_lag))",
        f"sf AS (SELECT candidate, {snap}, lob, dev_lag, sum(following) FILTER (n - high - low < 1 OR (lo > low AND hi > high)) / sum(previous) FILTER (n - high - low < 1 OR (lo > low AND hi > high)) AS f, bool_or(n - high - low < 1 AND high + low > 0) AS spent FROM sk GROUP BY 1, 2, 3, 4)",
        f"sa AS (SELECT {snap}, lob, origin_period, max(dev_lag) AS latest_dev, arg_max(value, dev_lag) AS latest FROM hc GROUP BY 1, 2, 3)",
        f"need AS (SELECT g.candidate, g.exhausted, s.{snap}, s.lob, unnest([{', '.join(str(x) for x in range(12, _HORIZON, 12))}]) AS dev_lag FROM grid g CROSS JOIN (SELECT DISTINCT {snap}, lob FROM sa) s)",
        f"why AS (SELECT n.candidate, n.{snap}, n.lob, CASE WHEN bool_or(coalesce(spent, false) AND exhausted = 'raise') THEN 'exclusions_exhausted' WHEN bool_or(f IS NULL OR f <= 0) THEN 'no_link_ratio' END AS reason FROM need n LEFT JOIN sf USING (candidate, {snap}, lob, dev_lag) GROUP BY 1, 2, 3)",
        f"sp AS (SELECT *, exp(sum(ln(f)) OVER (PARTITION BY candidate, {snap}, lob ORDER BY dev_lag DESC)) AS cdf FROM sf)",
        f"sb AS (SELECT g.candidate, g.method, g.elr, g.decay, a.*, coalesce(p.cdf, 1.0) AS cdf, 1 / coalesce(p.cdf, 1.0) AS beta, coalesce(p.f, 1.0) AS nf, r.premium, year(a.origin_period) * 12 AS m, w.reason FROM sa a CROSS JOIN grid g JOIN why w ON w.candidate = g.candidate AND w.{snap} = a.{snap} AND w.lob = a.lob LEFT JOIN sp p ON p.candidate = g.candidate AND p.{snap} = a.{snap} AND p.lob = a.lob AND p.dev_lag = a.latest_dev LEFT JOIN prem r ON r.lob = a.lob AND r.origin_period = a.origin_period)",
        f"sr AS (SELECT a.candidate, a.{snap}, a.lob, a.m, sum(pow(a.decay, abs(a.m - b.m) / 12.0) * b.latest) / sum(pow(a.decay, abs(a.m - b.m) / 12.0) * b.premium * b.beta) AS er FROM sb a JOIN sb b ON a.candidate = b.candidate AND a.{snap} = b.{snap} AND a.lob = b.lob WHERE a.method = 'gcc' GROUP BY 1, 2, 3, 4)",
        f"se AS (SELECT b.*, CASE WHEN method = 'bf' THEN elr ELSE er END * premium AS ex FROM sb b LEFT JOIN sr ON b.candidate = sr.candidate AND b.{snap} = sr.{snap} AND b.lob = sr.lob AND b.m = sr.m)",
        "sx AS (SELECT *, CASE WHEN method = 'cl' THEN latest * cdf ELSE latest + (1 - beta) * ex END AS ultimate, CASE WHEN method = 'cl' THEN latest * nf ELSE latest + (beta * nf - beta) * ex END AS next_value FROM se)",
    ]


def _snaps(days: list[str]) -> str:
    return "sc AS (SELECT d.snapshot, c.* FROM cells c JOIN (" + " UNION ALL ".join(f"SELECT DATE '{x}' AS snapshot" for x in days) + ") d ON c.eval_date <= d.snapshot)"


def _replay_ctes(days: list[str]) -> list[str]:
    return [
        _snaps(days),
        *_fit_ctes("sc", "snapshot"),
        f"""ri AS (SELECT n.candidate, n.snapshot, n.lob, n.origin_period, least(n.latest_dev + 12, {_HORIZON}) AS dev_lag, n.next_value - n.latest AS expected, l.latest - n.latest AS actual, l.ultimate - n.ultimate AS cdr,
    CASE WHEN n.reason IS NOT NULL THEN 'fit_before: ' || n.reason WHEN l.reason IS NOT NULL THEN 'fit_after: ' || l.reason END AS failed
  FROM sx n JOIN sx l ON l.candidate = n.candidate AND l.snapshot = make_date(year(n.snapshot) + 1, 12, 31) AND l.lob = n.lob AND l.origin_period = n.origin_period)""",
        "rp AS (SELECT * FROM ri WHERE failed IS NULL)",
    ]


_REPLAY = _replay_ctes(_DAYS)
_LONGER = ["1997-12-31", *_DAYS]


def _intervals(spark, d, days=None):
    return bt.replay_intervals(marts.cells(spark, d), marts.premiums(spark, d), bt.candidates_frame(spark, _GRID), days or _DAYS, LOB, STEP, _HORIZON)


@query(q("SELECT candidate, snapshot, lob, origin_period, dev_lag, round(expected, 2) AS expected, round(actual, 4) AS actual, round(actual - expected, 2) AS ave, round(cdr, 2) AS cdr FROM rp", *_REPLAY))
def replay_ave_cdr(spark, d):
    found = bt.replay(marts.cells(spark, d), marts.premiums(spark, d), bt.candidates_frame(spark, _GRID), _DAYS, LOB, STEP, _HORIZON)
    return rounded(found.drop("remaining_revision"), expected=2, actual=4, ave=2, cdr=2)


@query(q("SELECT candidate, snapshot, lob, any_value(failed) AS reason, count(*) AS n_origins FROM ri WHERE failed IS NOT NULL GROUP BY 1, 2, 3", *_replay_ctes(_LONGER)))
def replay_failures(spark, d):
    """Intervals without an outcome: too few dates for every age, or trims that leave no link."""
    return bt.replay_failures(_intervals(spark, d, _LONGER), LOB)


_SCORES = "SELECT candidate, snapshot, count(*) AS n, CASE WHEN count(failed) = 0 THEN sqrt(sum(abs(actual) * pow(actual - expected, 2)) / sum(abs(actual))) END AS rmse, CASE WHEN count(failed) > 0 THEN 'failed' ELSE 'scored' END AS status FROM ri GROUP BY 1, 2"


@query(q(f"SELECT * REPLACE (round(rmse, 2) AS rmse) FROM ({_SCORES})", *_REPLAY))
def score_replay(spark, d):
    return rounded(bt.score_replay(_intervals(spark, d)), rmse=2)


@query(q(f"SELECT candidate, count(rmse) AS n_scored, round(avg(rmse), 2) AS mean_rmse, count(rmse) = 3 AS eligible, row_number() OVER (ORDER BY count(rmse) = 3 DESC, avg(rmse) NULLS LAST, candidate) AS place FROM ({_SCORES}) GROUP BY 1", *_REPLAY))
def select_conventional(spark, d):
    out = bt.select_conventional(bt.score_replay(_intervals(spark, d)), len(_DAYS) - 1)
    return rounded(out.withColumn("place", F.col("place").cast("bigint")), mean_rmse=2)


@query(q(f"SELECT x.candidate, count(*) FILTER (reason IS NULL) AS n, round(sqrt(avg(pow(x.ultimate - c.value, 2)) FILTER (reason IS NULL)), 2) AS rmse, round(avg(x.ultimate - c.value) FILTER (reason IS NULL), 2) AS bias, count(reason) AS n_failed FROM sx x JOIN cells c ON c.lob = x.lob AND c.origin_period = x.origin_period AND c.dev_lag = {_HORIZON} WHERE x.snapshot = DATE '1999-12-31' GROUP BY 1", _snaps(_DAYS), *_fit_ctes("sc", "snapshot")))
def evaluate_conventional(spark, d):
    out = bt.evaluate_conventional(marts.cells(spark, d), marts.premiums(spark, d), bt.candidates_frame(spark, _GRID), "1999-12-31", _HORIZON, LOB, STEP)
    return rounded(out, rmse=2, bias=2)


@query(
    q(
        """SELECT lob, snapshot, CAST(stage AS INTEGER) AS stage, round(latest, 2) AS latest, CASE WHEN reason IS NULL THEN round(estimate, 2) END AS estimate, reason, reason IS NULL AS passed FROM rt QUALIFY row_number() OVER (PARTITION BY lob, snapshot ORDER BY CASE WHEN reason IS NULL THEN stage ELSE 9 - stage END) = 1""",
        *_replay_ctes(_LONGER)[:-2],
        "rt AS (SELECT CASE candidate WHEN 'cl_strict' THEN 1 ELSE 2 END AS stage, snapshot, lob, sum(latest) AS latest, sum(ultimate) AS estimate, any_value(reason) AS reason FROM sx WHERE candidate IN ('cl_strict', 'cl_all') GROUP BY 1, 2, 3)",
    )
)
def retrospective(spark, d):
    """Every segment on every date by a strict candidate, those that fail by a plain one; what neither fits says why."""
    premium = marts.premiums(spark, d)
    stages = [retro.candidate_stage(premium, c, STEP, _HORIZON) for name in ("cl_strict", "cl_all") for c in _GRID if c.name == name]
    return rounded(retro.run_retro(marts.cells(spark, d), LOB, _LONGER, stages).drop("se"), latest=2, estimate=2)


_SPACE = {"method": choice("cl", "bf", "gcc"), "history_periods": choice(3, 4, 1_000_000), "drop_high": choice(0, 1), "expected_loss_ratio": uniform(0.4, 0.9), "decay": uniform(0.5, 1.0)}


@query()
def tuning_trials(spark, d):
    """The five best of twenty settings drawn at random."""
    return tune(marts.cells(spark, d), marts.premiums(spark, d), _SPACE, 20, 7, _DAYS, LOB, STEP, _HORIZON, keep_top=5)


# --- predictive scores --------------------------------------------------------------------------

_DRAWS = "dr AS (SELECT c_mktsegment AS lob, l_orderkey * 10 + l_linenumber AS draw, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 45)"
_SEEN = "ob0 AS (SELECT lob, quantile_cont(value, 0.3) AS observed FROM dr GROUP BY 1)"


def pseudo_draws(spark, d):
    """Deterministic stand-ins for simulated draws: prices of large line items by segment."""
    lines, orders, customers = (marts.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.where("l_quantity >= 45").join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(F.col("c_mktsegment").alias("lob"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("draw"), F.col("l_extendedprice").cast("double").alias("value"))


def seen(draws):
    return draws.groupBy("lob").agg(F.percentile("value", 0.3).alias("observed"))


@query(q("SELECT lob, round(avg(abs(value - observed)) - sum((2 * i - n - 1) * value) / max(n * n), 2) AS crps FROM (SELECT d.lob, d.value, o.observed, CAST(row_number() OVER (PARTITION BY d.lob ORDER BY d.value) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY d.lob) AS DOUBLE) AS n FROM dr d JOIN ob0 o ON d.lob = o.lob) GROUP BY 1", _DRAWS, _SEEN))
def crps(spark, d):
    draws = pseudo_draws(spark, d)
    return rounded(predictive.crps(draws, seen(draws), LOB), crps=2)


@query(q("SELECT d.lob, round(avg(CASE WHEN value <= observed THEN 1.0 ELSE 0.0 END), 6) AS pit FROM dr d JOIN ob0 o ON d.lob = o.lob GROUP BY 1", _DRAWS, _SEEN))
def pit(spark, d):
    draws = pseudo_draws(spark, d)
    return rounded(predictive.pit(draws, seen(draws), LOB), pit=6)


_PITS = "pi AS (SELECT lob, draw, CAST(draw * 7919 % 100003 AS DOUBLE) / 100003 AS pit FROM dr)"


def pseudo_pits(spark, d):
    return pseudo_draws(spark, d).select("lob", "draw", ((F.col("draw") * 7919 % 100003).cast("double") / 100003).alias("pit"))


@query(q("SELECT lob, n, round(d, 6) AS d, round(greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * n * d * d))))), 6) AS p_value, round(1.36 / sqrt(n), 6) AS critical_5pct, d > 1.36 / sqrt(n) AS reject_5pct FROM (SELECT lob, max(n) AS n, max(greatest(i / n - pit, pit - (i - 1) / n)) AS d FROM (SELECT lob, pit, CAST(row_number() OVER (PARTITION BY lob ORDER BY pit) AS DOUBLE) AS i, count(*) OVER (PARTITION BY lob) AS n FROM pi) GROUP BY 1)", _DRAWS, _PITS))
def ks_uniformity(spark, d):
    return rounded(predictive.ks_uniformity(pseudo_pits(spark, d), LOB), d=6, p_value=6, critical_5pct=6)


@query(q("SELECT lob, i, round(pit, 6) AS observed_p, round(CAST(i AS DOUBLE) / (n + 1), 6) AS expected_p FROM (SELECT lob, pit, CAST(row_number() OVER (PARTITION BY lob ORDER BY pit) AS BIGINT) AS i, count(*) OVER (PARTITION BY lob) AS n FROM pi)", _DRAWS, _PITS))
def pp_points(spark, d):
    out = predictive.pp_points(pseudo_pits(spark, d), LOB).drop("n").withColumn("i", F.col("i").cast("bigint"))
    return rounded(out, observed_p=6, expected_p=6)


@query(q("SELECT d.lob, round(k.quantile, 2) AS quantile, round(avg(d.value), 2) AS tvar FROM dr d JOIN (SELECT lob, quantile_cont(value, 0.95) AS quantile FROM dr GROUP BY 1) k ON d.lob = k.lob AND d.value >= k.quantile GROUP BY d.lob, k.quantile", _DRAWS))
def quantile_tvar(spark, d):
    return rounded(predictive.quantile_tvar(pseudo_draws(spark, d), LOB, 0.95), quantile=2, tvar=2)


@query(q("SELECT lob, count(*) AS n_draws, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(quantile_cont(value, 0.25), 3) AS q25, round(median(value), 3) AS q50, round(quantile_cont(value, 0.75), 3) AS q75, round(stddev_samp(value) / avg(value), 6) AS cv FROM dr GROUP BY 1", _DRAWS))
def predictive_summary(spark, d):
    return rounded(predictive.summary(pseudo_draws(spark, d), LOB), mean=4, sd=4, q25=3, q50=3, q75=3, cv=6)


@query(q("SELECT d.lob, round(any_value(top) + ln(avg(exp(-value / 1000 - top))), 6) AS log_mean_exp FROM dr d JOIN (SELECT lob, max(-value / 1000) AS top FROM dr GROUP BY 1) t ON d.lob = t.lob GROUP BY 1", _DRAWS))
def logmeanexp(spark, d):
    draws = pseudo_draws(spark, d).withColumn("lv", -F.col("value") / 1000)
    return rounded(predictive.log_mean_exp(draws, LOB, "lv"), log_mean_exp=6)


@query(q("SELECT lob, round(pow(sum(value), 2) / sum(value * value), 4) AS ess FROM dr GROUP BY lob", _DRAWS))
def kish_ess(spark, d):
    return rounded(predictive.kish_ess(pseudo_draws(spark, d), LOB, "value"), ess=4)


@query(q("SELECT lob, n, round((1 - (h - floor(h))) * v[CAST(floor(h) AS INTEGER)] + (h - floor(h)) * v[CAST(least(floor(h) + 1, n) AS INTEGER)], 4) AS quantile FROM (SELECT lob, count(*) AS n, list_sort(list(value)) AS v, greatest(1.0, least(CAST(count(*) AS DOUBLE), (count(*) + 1.0 / 3) * 0.3 + 1.0 / 3)) AS h FROM dr GROUP BY lob)", _DRAWS))
def quantile_type8(spark, d):
    return rounded(predictive.quantile_type8(pseudo_draws(spark, d), LOB, "value", 0.3), quantile=4)


_SCORES = """sc0 AS (
  SELECT 'a' AS model, lob, origin_period, dev_lag, -abs(ratio - 1.2) AS elpd, abs(ratio - 1.2) AS crps FROM links
  UNION ALL SELECT 'b', lob, origin_period, dev_lag, CASE WHEN dev_lag >= 24 THEN -abs(ratio - 1.1) END, abs(ratio - 1.1) FROM links
  UNION ALL SELECT 'c', lob, origin_period, dev_lag, -abs(ratio - 1.3), CASE WHEN origin_period <= DATE '1998-01-01' THEN abs(ratio - 1.3) END FROM links)"""
CELL = ["lob", "origin_period", "dev_lag"]


def model_scores(spark, d):
    links = select_links(marts.cells(spark, d), LOB, STEP)
    parts = []
    for model, centre, has_density, has_draws in (("a", 1.2, F.lit(True), F.lit(True)), ("b", 1.1, F.col("dev_lag") >= 24, F.lit(True)), ("c", 1.3, F.lit(True), F.col("origin_period") <= F.lit("1998-01-01").cast("date"))):
        e = F.abs(F.col("ratio") - centre)
        parts.append(links.select(F.lit(model).alias("model"), *CELL, F.when(has_density, -e).alias("elpd"), F.when(has_draws, e).alias("crps")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(q("SELECT s.model, s.lob, s.origin_period, s.dev_lag, round(s.elpd, 6) AS elpd FROM sc0 s JOIN (SELECT lob, origin_period, dev_lag FROM sc0 WHERE elpd IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = 3) k USING (lob, origin_period, dev_lag) WHERE s.elpd IS NOT NULL", _SCORES))
def panel_intersection(spark, d):
    return rounded(predictive.align_panel(model_scores(spark, d), CELL).select("model", *CELL, "elpd"), elpd=6)


def _panel_sql(score: str) -> str:
    return f"(SELECT s.model, sum(s.{score}) AS total, avg(s.{score}) AS mean, count(*) AS n FROM sc0 s JOIN (SELECT lob, origin_period, dev_lag FROM sc0 WHERE {score} IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = 3) k USING (lob, origin_period, dev_lag) WHERE s.{score} IS NOT NULL GROUP BY 1)"


@query(q(f"SELECT e.model, round(e.total, 6) AS elpd, e.n AS n_elpd, round(c.mean, 6) AS crps, c.n AS n_crps FROM {_panel_sql('elpd')} e JOIN {_panel_sql('crps')} c ON e.model = c.model", _SCORES))
def leaderboard(spark, d):
    return rounded(predictive.leaderboard(model_scores(spark, d), CELL), elpd=6, crps=6)


@query(q("SELECT lob, origin_period, stratum, round((actual - predicted) / greatest(abs(predicted), 0.01 * prev_value, 1.0), 6) AS residual FROM (SELECT *, ntile(4) OVER (ORDER BY prev_value, actual) AS stratum FROM pr)", *_PRED))
def residual_strata(spark, d):
    out = predictive.residual_strata(predictions(spark, d).withColumn("size", F.col("prev_value")), 4)
    return rounded(out.select("lob", "origin_period", F.col("stratum").cast("bigint").alias("stratum"), "residual"), residual=6)


@query(
    q(
        """SELECT lob, origin_period, pool_n, pool_n >= 6 AS pooled, round(residual - CASE WHEN pool_n >= 6 THEN own ELSE everyone END, 6) + 0.0 AS centred FROM (
  SELECT *, count(*) OVER (PARTITION BY stratum) AS pool_n, median(residual) OVER (PARTITION BY stratum) AS own, median(residual) OVER () AS everyone FROM (
    SELECT lob, origin_period, ntile(4) OVER (ORDER BY prev_value, actual) AS stratum, (actual - predicted) / greatest(abs(predicted), 0.01 * prev_value, 1.0) AS residual FROM pr))""",
        *_PRED,
    )
)
def calibration_pools(spark, d):
    r = predictive.residual_strata(predictions(spark, d).withColumn("size", F.col("prev_value")), 4)
    out = predictive.calibration_pools(r, ["stratum"], least=6).select("lob", "origin_period", "pool_n", "pooled", "centred")
    return rounded(out, centred=6).withColumn("centred", F.col("centred") + 0.0)


@query(q("SELECT lob, 400 AS n, round(predicted, 2) AS predicted, true AS inside FROM pr", *_PRED))
def calibrated_draws(spark, d):
    """Draws around each prediction; every draw is the point and a residual of its pool."""
    p = predictions(spark, d).withColumn("size", F.col("prev_value"))
    r = predictive.residual_strata(p, 4)
    pools = predictive.calibration_pools(r, ["stratum"], least=6)
    draws = predictive.calibrated_draws(r.select("lob", "origin_period", "predicted", "size", "stratum"), pools, ["lob", "origin_period"], 400)
    scale = F.greatest(F.abs("predicted"), 0.01 * F.col("size"), F.lit(1.0))
    # A sum is rounded in proportion to its size, so the tolerance grows with it.
    rounding = 1e-6 + 1e-12 * (F.abs("predicted") + F.abs("value"))
    far = draws.crossJoin(F.broadcast(pools.agg(F.max(F.abs("centred")).alias("most")))).withColumn("ok", F.abs(F.col("value") - F.col("predicted")) <= scale * F.col("most") + rounding)
    return rounded(far.groupBy("lob", "origin_period", "predicted").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and("ok").alias("inside")).drop("origin_period"), predicted=2)


_CUTS, _FINAL = ["1997-12-31", "1998-12-31", "1999-12-31", "2000-12-31"], "2001-12-31"
_UNIT = ["lob", "origin_period"]


def rolling(spark, d):
    """Chain ladder forecasts of the last diagonal, made on earlier ones; a unit is an origin of a segment, its size the premium."""
    cells = marts.cells(spark, d)
    at = bt.snapshots(cells, LOB, _CUTS)
    key = ["snapshot", "lob"]
    factors = link_factors(select_links(at, key, STEP), key).select(*key, "dev_lag", "factor")
    now = methods.latest(at, key).join(marts.premiums(spark, d).withColumnRenamed("premium", "size"), _UNIT)
    horizon = F.year(F.lit(_FINAL).cast("date")) - F.year("snapshot")
    ages = factors.groupBy(*key).agg(F.collect_list(F.struct("dev_lag", "factor")).alias("ages"))
    ahead = F.aggregate(F.filter("ages", lambda a: (a["dev_lag"] >= F.col("latest_dev")) & (a["dev_lag"] < F.col("latest_dev") + STEP * F.col("horizon"))), F.lit(1.0), lambda p, a: p * a["factor"])
    made = now.join(ages, key).withColumn("horizon", horizon).withColumn("predicted", F.col("latest") * ahead)
    return calibration.rolling_residuals(made.select(*_UNIT, F.col("snapshot").alias("cutoff"), F.lit(_FINAL).cast("date").alias("target"), "horizon", "predicted", "size"), cells, _UNIT)


_ROLL = [
    "rs AS (SELECT d.snapshot, c.* FROM cells c JOIN (" + " UNION ALL ".join(f"SELECT DATE '{x}' AS snapshot" for x in _CUTS) + ") d ON c.eval_date <= d.snapshot)",
    "rf AS (SELECT a.snapshot, a.lob, a.dev_lag, sum(b.value) / sum(a.value) AS f FROM rs a JOIN rs b ON a.snapshot = b.snapshot AND a.lob = b.lob AND a.origin_period = b.origin_period AND b.dev_lag = a.dev_lag + 12 GROUP BY 1, 2, 3)",
    "rl AS (SELECT snapshot, lob, origin_period, max(dev_lag) AS latest_dev, arg_max(value, dev_lag) AS latest, 2001 - year(snapshot) AS horizon FROM rs GROUP BY 1, 2, 3)",
    "rw AS (SELECT l.*, l.latest * exp(coalesce((SELECT sum(ln(f)) FROM rf WHERE rf.snapshot = l.snapshot AND rf.lob = l.lob AND rf.dev_lag >= l.latest_dev AND rf.dev_lag < l.latest_dev + 12 * l.horizon), 0)) AS predicted FROM rl l)",
    "rr AS (SELECT w.lob, w.origin_period, w.snapshot AS cutoff, CAST(w.horizon AS INTEGER) AS horizon, predicted, t.latest AS actual, p.premium AS size, greatest(abs(predicted), 0.01 * p.premium, 1.0) AS scale FROM rw w JOIN lat t USING (lob, origin_period) JOIN prem p USING (lob, origin_period))",
    "rz AS (SELECT r.*, (actual - predicted) / scale AS z, s.stratum FROM rr r JOIN (SELECT lob, origin_period, ntile(2) OVER (ORDER BY size, lob, origin_period) AS stratum FROM (SELECT lob, origin_period, min(size) AS size FROM rr GROUP BY 1, 2)) s USING (lob, origin_period))",
]


@query(q("SELECT lob, origin_period, cutoff, horizon, round(predicted, 2) AS predicted, round(actual, 2) AS actual, round(z, 6) + 0.0 AS residual, stratum FROM rz", *_ROLL))
def rolling_residuals(spark, d):
    """Standardised errors of forecasts made at earlier dates, with the stratum of their unit's size."""
    out = calibration.with_strata(rolling(spark, d), _UNIT, 2, least=10)
    out = rounded(out.select(*_UNIT, "cutoff", "horizon", "predicted", "actual", "residual", F.col("stratum").cast("bigint").alias("stratum")), predicted=2, actual=2, residual=6)
    return out.withColumn("residual", F.col("residual") + 0.0)


def _type8(p: str) -> str:
    at = f"greatest(1.0, least(m, (m + 1 / 3) * {p} + 1 / 3))"
    return f"s[CAST(floor({at}) AS INTEGER)] + ({at} - floor({at})) * (coalesce(s[CAST(floor({at}) AS INTEGER) + 1], 0) - s[CAST(floor({at}) AS INTEGER)])"


@query(
    q(
        f"SELECT horizon, CAST(nominal AS DOUBLE) AS nominal, avg(CAST(z + med >= lo AND z + med <= hi AS INTEGER)) AS empirical, count(*) AS n FROM (SELECT *, {_type8('((1 - nominal) / 2)')} AS lo, {_type8('(1 - (1 - nominal) / 2)')} AS hi, {_type8('0.5')} AS med FROM rq) GROUP BY 1, 2",
        *_ROLL,
        "ro AS (SELECT a.lob, a.origin_period, a.cutoff, list_sort(list(b.z)) AS s, CAST(count(*) AS DOUBLE) AS m FROM rz a JOIN rz b ON a.stratum = b.stratum AND (a.lob <> b.lob OR a.origin_period <> b.origin_period) GROUP BY 1, 2, 3)",
        "rq AS (SELECT z.horizon, z.z, o.s, o.m, v.nominal FROM rz z JOIN ro o USING (lob, origin_period, cutoff) CROSS JOIN (VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) v(nominal))",
    )
)
def leave_one_out_coverage(spark, d):
    """How often intervals made from the other units hold what came, by horizon and level."""
    return calibration.leave_one_out_coverage(calibration.with_strata(rolling(spark, d), _UNIT, 2, least=10), _UNIT)


@query(
    q(
        """SELECT f.lob, f.origin_period, f.dev_lag, CASE WHEN excluded IS NULL OR excluded = 'no_predecessor' THEN o.w ELSE 0 END AS w, CASE WHEN excluded IS NULL OR excluded = 'no_predecessor' THEN CAST(f.dev_lag / 12 AS INTEGER) ELSE 0 END AS d,
  CASE WHEN excluded IS NULL OR excluded = 'no_predecessor' THEN round(prev_value, 2) END AS prev_value, CASE excluded WHEN 'new_origin' THEN 'unknown_origin' WHEN 'dev_beyond_trained' THEN 'dev_beyond_trained' END AS reason
  FROM ho f LEFT JOIN (SELECT lob, origin_period, CAST(dense_rank() OVER (PARTITION BY lob ORDER BY origin_period) AS INTEGER) AS w FROM (SELECT DISTINCT lob, origin_period FROM tr0)) o ON o.lob = f.lob AND o.origin_period = f.origin_period""",
        *_HOLD,
    )
)
def holdout_index(spark, d):
    """The next diagonal in the index space of what was known: places, predecessors, and reasons of cells without a place."""
    cells = marts.cells(spark, d)
    index = holdout.training_index(bt.known_at(cells, LOB, _DAY), LOB, STEP)
    out = holdout.index_into(bt.next_diagonal(cells, LOB, STEP, _DAY), index, LOB, STEP)
    return rounded(out.drop("value"), prev_value=2).fillna(0, ["w", "d"])


@query(
    q(
        "SELECT label, count(v) AS n, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, round(min(v), 2) AS least, round(max(v), 2) AS most FROM lt GROUP BY label",
        "ld AS (SELECT lob, origin_period, i AS draw, latest * (1 + 0.01 * ((i * (CASE WHEN lob = 'BUILDING' THEN 3 ELSE 5 END)) % 11)) AS v FROM lat, range(1, 21) r(i) WHERE lob IN ('BUILDING', 'MACHINERY'))",
        "lt AS (SELECT lob || '/' || origin_period AS label, draw, v FROM ld UNION ALL SELECT lob || '/total', draw, sum(v) FROM ld GROUP BY lob, draw UNION ALL SELECT 'total', draw, sum(v) FROM ld GROUP BY draw)",
    )
)
def multi_line_totals(spark, d):
    """Targets, line totals and the grand total of twenty draws, summed within each draw."""
    rows = methods.latest(_company(spark, d)[0].where(F.col("lob").isin(_TWO)), ["company", "lob"]).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20))))
    turn = (F.col("draw") * F.when(F.col("lob") == "BUILDING", 3).otherwise(5)) % 11
    draws = rows.select("company", "lob", "origin_period", "draw", (F.col("latest") * (1 + 0.01 * turn)).alias("value"))
    out = multiline.target_summary(multiline.with_totals(draws, ["company"], "lob"), ["company"]).drop("company")
    return rounded(out, mean=2, sd=2, least=2, most=2)


_ATTACHED = development.Tail(constant=1.05, attach_lag=60, rows=3)
_DEV = [
    "dx AS (SELECT (-2 + sqrt(4 + 16.0 / 3 * ln(1.05))) / (8.0 / 3) AS x)",
    """de AS (SELECT lob, dev_lag, factor, 'data' AS source FROM fac WHERE dev_lag < 60
  UNION ALL SELECT lob, CAST(60 + 12 * i AS BIGINT), CASE WHEN i < 2 THEN 1 + x * pow(0.5, i) ELSE 1.05 / ((1 + x) * (1 + x / 2)) END, 'tail' FROM (SELECT DISTINCT lob FROM fac), dx, range(0, 3) r(i))""",
    "dc AS (SELECT *, exp(sum(ln(factor)) OVER (PARTITION BY lob ORDER BY dev_lag DESC)) AS cdf FROM de)",
]


def _developed(spark, d, tail):
    return development.development(link_factors(select_links(marts.cells(spark, d), LOB, STEP), LOB), LOB, STEP, tail)


@query(q("SELECT lob, dev_lag, round(factor, 6) AS factor, source, round(cdf, 6) AS cdf, CAST(NULL AS VARCHAR) AS reason FROM dc", *_DEV))
def development_attached(spark, d):
    """A constant tail in place of the links from age 60 on, as three ages."""
    return rounded(_developed(spark, d, _ATTACHED), factor=6, cdf=6)


@query(q(f"SELECT {CL_OUT.format(u='ultimate')} FROM (SELECT l.lob, l.origin_period, l.latest_dev, l.latest, l.latest * c.cdf AS ultimate FROM lat l JOIN dc c ON c.lob = l.lob AND c.dev_lag = l.latest_dev)", *_DEV))
def chain_ladder_attached_tail(spark, d):
    """Chain ladder along it: the oldest origins meet the tail at their own ages."""
    return cl_out(development.projected(marts.cells(spark, d), _developed(spark, d, _ATTACHED), LOB))


@query(
    q(
        "SELECT lob, dev_lag, round(factor, 6) AS factor, source, round(exp(sum(ln(factor)) OVER (PARTITION BY lob ORDER BY dev_lag DESC)), 6) AS cdf, reason FROM dr",
        "df AS (SELECT lob, regr_slope(ln(factor - 1), dev_lag / 12) AS b, regr_intercept(ln(factor - 1), dev_lag / 12) AS a FROM fac WHERE factor > 1.00001 GROUP BY lob)",
        "dl AS (SELECT f.lob, max(f.dev_lag) // 12 AS n, any_value(a) AS a, any_value(b) AS b FROM fac f LEFT JOIN df ON df.lob = f.lob GROUP BY f.lob)",
        "dt AS (SELECT lob, t, n, 1 + exp(a + b * t) AS f FROM (SELECT *, unnest(range(n + 1, n + 101)) AS t FROM dl WHERE b < 0))",
        """dr AS (SELECT f.lob, f.dev_lag, f.factor, 'data' AS source, CASE WHEN l.b IS NULL THEN 'not_identified' WHEN l.b >= 0 THEN 'tail_not_decaying' END AS reason FROM fac f JOIN dl l ON l.lob = f.lob
  UNION ALL SELECT lob, CAST(12 * least(t, n + 3) AS BIGINT), exp(sum(ln(f))), 'tail', NULL FROM dt GROUP BY lob, least(t, n + 3))""",
    )
)
def development_curve(spark, d):
    """An exponential tail as three ages past the data, the last of which takes the rest."""
    return rounded(_developed(spark, d, development.Tail(curve="exponential", rows=3)), factor=6, cdf=6)


@query(
    q(
        """SELECT lob, cutoff, dev_lag, n_links, round(factor, 6) AS factor, CAST(sum(n_links) OVER p AS BIGINT) AS links_through, round(sum(previous) OVER p, 2) AS volume_through,
  round(factor - lag(factor) OVER (PARTITION BY lob, dev_lag ORDER BY cutoff), 6) + 0.0 AS factor_change, round(exp(sum(ln(coalesce(factor, 1))) OVER (PARTITION BY lob, cutoff ORDER BY dev_lag DESC)), 6) AS cdf FROM lf
  WINDOW p AS (PARTITION BY lob, cutoff ORDER BY dev_lag)""",
        "lg AS (SELECT c.lob, c.cutoff, a.dev_lag FROM (SELECT DISTINCT lob, eval_date AS cutoff FROM rest) c JOIN (SELECT DISTINCT lob, dev_lag FROM links) a ON a.lob = c.lob)",
        "ra AS (SELECT cutoff, lob, origin_period, dev_lag, arg_max(value, eval_date) AS value FROM rest JOIN (SELECT DISTINCT eval_date AS cutoff FROM rest) ON eval_date <= cutoff GROUP BY 1, 2, 3, 4)",
        "lk AS (SELECT a.cutoff, a.lob, a.dev_lag, count(*) AS n, sum(a.value) AS previous, sum(b.value) AS following FROM ra a JOIN ra b ON a.cutoff = b.cutoff AND a.lob = b.lob AND a.origin_period = b.origin_period AND b.dev_lag = a.dev_lag + 12 GROUP BY 1, 2, 3)",
        "lf AS (SELECT g.*, coalesce(n, 0) AS n_links, coalesce(previous, 0) AS previous, following / previous AS factor FROM lg g LEFT JOIN lk ON lk.lob = g.lob AND lk.cutoff = g.cutoff AND lk.dev_lag = g.dev_lag)",
    )
)
def cutoff_features(spark, d):
    """Link factors and totals as every date knew them, restatements included, without a copy of the cells for each date."""
    cells = marts.restated(spark, d).df.select("lob", "origin_period", "dev_lag", "eval_date", "value")
    out = rounded(features.cutoff_features(cells, LOB, STEP), factor=6, volume_through=2, factor_change=6, cdf=6)
    return out.withColumn("factor_change", F.col("factor_change") + 0.0)


@query(
    q(
        "SELECT lob, origin_period, CAST(count(*) AS INTEGER) AS n, round(avg(v), 2) AS mean, round(min(v), 2) AS least, round(max(v), 2) AS most, round(quantile_cont(v, 0.05), 2) AS q05, round(quantile_cont(v, 0.5), 2) AS q50, round(quantile_cont(v, 0.95), 2) AS q95 FROM ad GROUP BY 1, 2",
        "ad AS (SELECT lob, origin_period, latest * (1 + 0.01 * ((i * 7) % 31)) AS v FROM lat, range(1, 31) r(i))",
    )
)
def artifact_digest(spark, d):
    """Draws of every origin, kept as a typed artifact, read back by their footer's kind and summed up row by row."""
    draws = methods.latest(marts.cells(spark, d), LOB).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(30))))
    packed = artifacts.pack_draws(draws.select(*_UNIT, "draw", (F.col("latest") * (1 + 0.01 * ((F.col("draw") * 7) % 31))).alias("value")), _UNIT)
    kept, keys = artifacts.load(spark, artifacts.save(packed, shared_folder(spark, "artifact"), "draws", _UNIT), "draws")
    return rounded(artifacts.digest(kept, keys), mean=2, least=2, most=2, q05=2, q50=2, q95=2)


_MIX_WEIGHTS = {"a": 0.5, "b": 0.3, "c": 0.2}


@query(q("SELECT lob, model, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM (SELECT lob, 'a' AS model, i, v AS value FROM md WHERE i < 5 UNION ALL SELECT lob, 'b', i, v * 2 FROM md WHERE i < 3 UNION ALL SELECT lob, 'c', i, v * 3 FROM md WHERE i < 2) GROUP BY 1, 2", _DRAWS, "md AS (SELECT lob, row_number() OVER (PARTITION BY lob ORDER BY draw) - 1 AS i, value AS v FROM dr)"))
def stacked_mixture(spark, d):
    """Ten draws of a mixture: five, three and two of its models."""
    from pyspark.sql.window import Window

    # As in the SQL, draws without a number come last; those of the same number, which it leaves open, go by value.
    draws = pseudo_draws(spark, d).withColumn("draw", F.row_number().over(Window.partitionBy("lob").orderBy(F.col("draw").asc_nulls_last(), F.col("value").asc_nulls_last())) - 1)
    parts = [draws.select("lob", "draw", F.lit(m).alias("model"), (F.col("value") * k).alias("value")) for m, k in (("a", 1), ("b", 2), ("c", 3))]
    weights = spark.createDataFrame(list(_MIX_WEIGHTS.items()), "model string, weight double")
    out = predictive.apply_weights(parts[0].unionByName(parts[1]).unionByName(parts[2]), weights, LOB, 10)
    return rounded(out.groupBy("lob", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), total=2)


@query(q("SELECT lob, origin_period, dev_lag, round(-0.5 * pow((ln(value) - 17) / 1.5, 2) - ln(1.5) - 0.5 * ln(2 * pi()) - ln(value), 6) AS lognormal, round(-0.5 * pow((value / premium - 0.5) / 0.2, 2) - ln(0.2) - 0.5 * ln(2 * pi()) - ln(premium), 6) AS ratio_normal FROM cells JOIN prem USING (lob, origin_period)"))
def density_amount_scale(spark, d):
    c = marts.cells(spark, d).join(marts.premiums(spark, d), ["lob", "origin_period"])
    v, p = F.col("value"), F.col("premium")
    return rounded(c.select(*CELL, predictive.lognormal_lpdf(v, F.lit(17.0), F.lit(1.5)).alias("lognormal"), predictive.to_amount_scale(predictive.normal_lpdf(v / p, F.lit(0.5), F.lit(0.2)), "loss_ratio", premium=p).alias("ratio_normal")), lognormal=6, ratio_normal=6)


@query(q("SELECT dev_lag, round(sum(CAST(paid AS DOUBLE)) / sum(premium), 6) AS incremental_lr, count(*) AS n FROM inc JOIN prem USING (lob, origin_period) WHERE eval_date <= DATE '1999-12-31' GROUP BY 1"))
def pooled_incremental_lr(spark, d):
    t = marts.increments(spark, d).as_of("1999-12-31").df.join(marts.premiums(spark, d), ["lob", "origin_period"])
    return rounded(t.groupBy("dev_lag").agg((F.sum("value") / F.sum("premium")).alias("incremental_lr"), F.count(F.lit(1)).alias("n")), incremental_lr=6)


@query(q("SELECT lob, origin_period, dev_lag, round(value / premium, 6) AS paid_ratio, round(value / nullif(lag(value) OVER (PARTITION BY lob, origin_period ORDER BY dev_lag), 0), 6) AS own_factor FROM cells JOIN prem USING (lob, origin_period) WHERE eval_date <= DATE '1999-12-31'"))
def own_ratio_features(spark, d):
    from pyspark.sql.window import Window

    c = bt.known_at(marts.cells(spark, d), LOB, "1999-12-31").join(marts.premiums(spark, d), ["lob", "origin_period"])
    before = F.lag("value").over(Window.partitionBy("lob", "origin_period").orderBy("dev_lag"))
    return rounded(c.select(*CELL, (F.col("value") / F.col("premium")).alias("paid_ratio"), F.try_divide("value", before).alias("own_factor")), paid_ratio=6, own_factor=6)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from rundelta.streaming.snapshot import event_windows as windows

    return rounded(windows(marts.table(spark, d, "events")), total=2)


@query(q("SELECT lob, origin_period, dev_lag, max(eval_date) AS eval_date, round(arg_max(value, eval_date), 4) AS value FROM rest GROUP BY 1, 2, 3"))
def stream_snapshot(spark, d):
    """The restated history read as a stream of files and folded into the latest snapshot."""
    from rundelta.streaming.runs import folder_of, stream_of

    return rounded(stream_of(spark, marts.restated(spark, d).df.select(*CELL, "eval_date", "value"), folder_of(spark)), value=4)


# --- simulation and iterative fits (checked in the tests against closed forms) ------------------


@query()
def mack_simulate(spark, d):
    return simulate.mack_simulate(marts.cells(spark, d), LOB, STEP, n_draws=1000)


@query()
def cdr_simulate(spark, d):
    draws = simulate.mack_simulate(marts.cells(spark, d), LOB, STEP, n_draws=2000, process="normal", one_year=True)
    return simulate.simulated_msep(draws, LOB).join(simulate.cdr_risk_measures(draws, LOB), "lob")


_POOL = [
    *_ODP,
    "or0 AS (SELECT lob, (x - m) / sqrt(abs(m)) AS r, count(*) OVER (PARTITION BY lob) AS n, (SELECT count(DISTINCT origin_period) FROM ob b WHERE b.lob = ob.lob) + (SELECT count(DISTINCT dev_lag) FROM ob b WHERE b.lob = ob.lob) - 1 AS p FROM ob)",
]


@query(q("SELECT lob, max(n) AS n_cells, max(p) AS n_params, round(sum(r * r) / (max(n) - max(p)), 2) AS phi, count(*) AS n_pool, round(avg(r) * sqrt(max(n) / (max(n) - max(p))), 4) AS pool_mean, round(stddev_pop(r) * sqrt(max(n) / (max(n) - max(p))), 4) AS pool_sd, CAST(NULL AS VARCHAR) AS error FROM or0 GROUP BY lob", *_POOL))
def odp_pool(spark, d):
    return rounded(simulate.odp_scale(marts.cells(spark, d), LOB), phi=2, pool_mean=4, pool_sd=4)


@query()
def odp_pool_hat(spark, d):
    return simulate.odp_scale(marts.cells(spark, d), LOB, adjustment="hat", pool="centred")


@query()
def odp_bootstrap_bf(spark, d):
    return simulate.odp_bootstrap(marts.cells(spark, d), LOB, n_draws=1000, premium=marts.premiums(spark, d), method="bf", expected_loss_ratio=0.6, prior_cv=0.1)


@query()
def odp_bootstrap_cape_cod(spark, d):
    return simulate.odp_bootstrap(marts.cells(spark, d), LOB, n_draws=1000, premium=marts.premiums(spark, d), method="gcc", decay=0.75, adjustment="hat", pool="centred")


@query()
def odp_bootstrap(spark, d):
    return simulate.odp_bootstrap(marts.cells(spark, d), LOB, n_draws=1000)


def glm_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("lob", "origin_period", "latest", "ultimate", "ibnr", "error"), latest=2, ultimate=2, ibnr=2)


@query(q("SELECT lob, origin_period, round(latest, 2) AS latest, round(ultimate, 2) AS ultimate, round(ibnr, 2) AS ibnr, CAST(NULL AS VARCHAR) AS error FROM cl"))
def tweedie_glm(spark, d):
    """At power 1 the fitted ultimates are those of the chain ladder."""
    return glm_out(fits.tweedie_glm(marts.cells(spark, d), LOB, 1.0))


_FALL = "CASE WHEN origin_period = DATE '1996-01-01' AND dev_lag = 36 THEN 0.95 * lag(value) OVER (PARTITION BY lob, origin_period ORDER BY dev_lag) ELSE value END"
_FALLING = [
    f"nc AS (SELECT lob, origin_period, dev_lag, {_FALL} AS value FROM cells)",
    "nl AS (SELECT a.lob, a.dev_lag, sum(b.value) / sum(a.value) AS f FROM nc a JOIN nc b ON a.lob = b.lob AND a.origin_period = b.origin_period AND b.dev_lag = a.dev_lag + 12 GROUP BY 1, 2)",
    "np AS (SELECT lob, dev_lag, exp(sum(ln(f)) OVER (PARTITION BY lob ORDER BY dev_lag DESC)) AS cdf FROM nl)",
    "nt AS (SELECT lob, origin_period, max(dev_lag) AS latest_dev, arg_max(value, dev_lag) AS latest FROM nc GROUP BY 1, 2)",
    "nu AS (SELECT t.*, t.latest * coalesce(p.cdf, 1) AS ultimate FROM nt t LEFT JOIN np p ON p.lob = t.lob AND p.dev_lag = t.latest_dev)",
]


def falling(spark, d):
    """The triangle with one cumulative that falls."""
    from pyspark.sql.window import Window

    before = F.lag("value").over(Window.partitionBy("lob", "origin_period").orderBy("dev_lag"))
    there = (F.col("origin_period") == F.lit("1996-01-01").cast("date")) & (F.col("dev_lag") == 36)
    return marts.cells(spark, d).withColumn("value", F.when(there, 0.95 * before).otherwise(F.col("value")))


@query(q("SELECT lob, origin_period, round(latest, 2) AS latest, round(ultimate, 2) AS ultimate, round(ultimate - latest, 2) AS ibnr, CAST(NULL AS VARCHAR) AS error FROM nu", *_FALLING))
def tweedie_negative(spark, d):
    """A negative increment is data of the score equations, so the chain ladder is met here too."""
    return glm_out(fits.tweedie_glm(falling(spark, d), LOB, 1.0))


@query(q("SELECT DISTINCT lob, CAST(NULL AS DATE) AS origin_period, CAST(NULL AS DOUBLE) AS ultimate, 'Refusal: negative_increment: power 2' AS error FROM nu", *_FALLING))
def tweedie_refusal(spark, d):
    """Gamma increments cannot be negative: a row per cohort says so."""
    return fits.tweedie_glm(falling(spark, d), LOB, 2.0).select("lob", "origin_period", "ultimate", "error")


@query(
    q(
        """SELECT lob, origin_period, round(latest, 2) AS latest, round(latest * (SELECT sum(m) FROM im i WHERE i.lob = t.lob) / (SELECT sum(m) FROM im i WHERE i.lob = t.lob AND i.dev_lag <= t.latest_dev), 2) AS ultimate FROM lat t""",
        "ic AS (SELECT lob, origin_period, dev_lag, value - coalesce(lag(value) OVER (PARTITION BY lob, origin_period ORDER BY dev_lag), 0) AS x FROM cells)",
        "im AS (SELECT lob, dev_lag, avg(x) AS m FROM ic GROUP BY 1, 2)",
    )
)
def tweedie_shared_pattern(spark, d):
    """Normal increments without origin terms and an identity link: every age is fitted by its mean."""
    out = fits.tweedie_glm(marts.cells(spark, d), LOB, 0.0, link="identity", origin="none")
    return rounded(out.select("lob", "origin_period", "latest", "ultimate"), latest=2, ultimate=2)


@query()
def tweedie_trend(spark, d):
    """A calendar trend in place of origin factors."""
    return glm.tweedie(marts.cells(spark, d), LOB, _TREND)


_TREND = fits.Tweedie(1.0, origin="none", calendar="trend")


@query(
    q(
        "SELECT lob, 'age ' || dev_lag AS term, round(sum(x), 0) AS fitted FROM ix GROUP BY 1, 2 UNION ALL SELECT lob, 'trend', round(sum(x * t), 0) FROM ix GROUP BY 1",
        "ix AS (SELECT lob, dev_lag, value - coalesce(lag(value) OVER (PARTITION BY lob, origin_period ORDER BY dev_lag), 0) AS x, year(origin_period) - min(year(origin_period)) OVER (PARTITION BY lob) + dev_lag / 12 - 1 AS t FROM cells)",
    )
)
def tweedie_trend_margins(spark, d):
    """The score equations at power 1: fitted increments have the sums of the observed ones by age, and by the trend."""
    rows, found = glm.fit_tweedie(marts.cells(spark, d), LOB, _TREND)
    seen = glm.fitted_rectangle(rows, found, LOB, _TREND).join(rows.select("lob", "origin_period", "dev_lag", (F.col("i") + F.col("j")).alias("t")), CELL_KEYS)
    ages = seen.groupBy("lob", F.concat(F.lit("age "), F.col("dev_lag").cast("string")).alias("term")).agg(F.sum("fitted").alias("fitted"))
    trend = seen.groupBy("lob").agg(F.sum(F.col("fitted") * F.col("t")).alias("fitted")).select("lob", F.lit("trend").alias("term"), "fitted")
    return rounded(ages.union(trend), fitted=0)


@query()
def clark(spark, d):
    return fits.clark(marts.cells(spark, d), marts.premiums(spark, d), LOB)


def _company(spark, d):
    return marts.cells(spark, d).withColumn("company", F.lit("all")), marts.premiums(spark, d).withColumn("company", F.lit("all"))


@query()
def sur(spark, d):
    return fits.multivariate_chain_ladder(_company(spark, d)[0], ["company"], "lob", full=False)


_TWO = ["BUILDING", "MACHINERY"]


@query(
    q(
        "SELECT 'all' AS company, CASE WHEN l = 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS lob, origin_period, round(latest, 2) AS latest, round(ultimate, 2) AS ultimate FROM up",
        """w AS (SELECT a.origin_period, a.dev_lag, a.previous AS x1, b.previous AS x2, a.following AS y1, b.following AS y2 FROM links a JOIN links b USING (origin_period, dev_lag) WHERE a.lob = 'BUILDING' AND b.lob = 'MACHINERY')""",
        "v AS (SELECT dev_lag, count(*) AS n, sum(y1) / sum(x1) AS f1, sum(y2) / sum(x2) AS f2 FROM w GROUP BY 1)",
        "u AS (SELECT w.*, n, f1, f2, (y1 - f1 * x1) / sqrt(x1) AS r1, (y2 - f2 * x2) / sqrt(x2) AS r2 FROM w JOIN v USING (dev_lag))",
        "c AS (SELECT dev_lag, any_value(n) AS n, any_value(f1) AS f1, any_value(f2) AS f2, sum(r1 * r1) / (count(*) - 1) AS s11, sum(r1 * r2) / (count(*) - 1) AS s12, sum(r2 * r2) / (count(*) - 1) AS s22, sum(x1) AS m11, sum(sqrt(x1 * x2)) AS m12, sum(x2) AS m22, sum(y1) AS t11, sum(sqrt(x1) * y2 / sqrt(x2)) AS t12, sum(sqrt(x2) * y1 / sqrt(x1)) AS t21, sum(y2) AS t22 FROM u GROUP BY dev_lag)",
        "i AS (SELECT *, s22 / (s11 * s22 - s12 * s12) AS i11, -s12 / (s11 * s22 - s12 * s12) AS i12, s11 / (s11 * s22 - s12 * s12) AS i22 FROM c)",
        "g AS (SELECT *, i11 * m11 AS a11, i12 * m12 AS a12, i22 * m22 AS a22, i11 * t11 + i12 * t12 AS v1, i12 * t21 + i22 * t22 AS v2 FROM i)",
        "b AS (SELECT dev_lag, CASE WHEN n >= 4 THEN (v1 * a22 - a12 * v2) / (a11 * a22 - a12 * a12) ELSE f1 END AS b1, CASE WHEN n >= 4 THEN (a11 * v2 - a12 * v1) / (a11 * a22 - a12 * a12) ELSE f2 END AS b2 FROM g)",
        "up AS (SELECT l.origin_period, CASE WHEN l.lob = 'BUILDING' THEN 1 ELSE 2 END AS l, any_value(l.latest) AS latest, any_value(l.latest) * exp(coalesce(sum(ln(CASE WHEN l.lob = 'BUILDING' THEN b1 ELSE b2 END)), 0)) AS ultimate FROM lat l LEFT JOIN b ON b.dev_lag >= l.latest_dev WHERE l.lob IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2)",
    )
)
def sur_two_lines(spark, d):
    """Two lines by one round of feasible generalised least squares, thin ages line by line."""
    cells = _company(spark, d)[0].where(F.col("lob").isin(_TWO))
    return rounded(sur_lines.points(cells, ["company"], "lob", STEP, rounds=1).drop("ibnr"), latest=2, ultimate=2)


@query()
def sur_draws(spark, d):
    """The mean and the spread of each line's ultimate over a thousand correlated draws."""
    cells = sur_lines.alike(_company(spark, d)[0], ["company"], "lob")
    drawn = sur_lines.draws(cells, ["company", "shape"], "lob", STEP)
    return drawn.groupBy("company", "lob", "origin_period").agg(F.avg("ultimate").alias("mean"), F.stddev_samp("ultimate").alias("sd"))


@query()
def mcl(spark, d):
    return fits.multivariate_chain_ladder(_company(spark, d)[0], ["company"], "lob", full=True)


@query()
def copula_glm(spark, d):
    return fits.copula_glm(*_company(spark, d), ["company"], "lob")


@query()
def ml_forest(spark, d):
    return fits.ml_development(marts.cells(spark, d), LOB, STEP, "forest")


@query()
def ml_boosting(spark, d):
    return fits.ml_development(marts.cells(spark, d), LOB, STEP, "boosting")


def _posterior(model):
    def run(spark, d):
        out = posterior.posterior(marts.cells(spark, d), marts.premiums(spark, d), LOB, model, n_draws=200, warm=200)
        return predictive.summary(out.where("error is null").groupBy("lob", "draw").agg(F.sum("value").alias("value")), LOB)

    return run


for _name in posterior.MODELS:
    query(name=f"{_name}_ultimates")(_posterior(_name))


@query()
def growth_posterior(spark, d):
    return fits.metropolis(marts.cells(spark, d), marts.premiums(spark, d), LOB)


@query()
def stacking_weights(spark, d):
    panel = predictive.align_panel(model_scores(spark, d), CELL)
    return spark.createDataFrame(list(predictive.stacking_weights(panel, CELL).items()), "model string, weight double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOGUE.items() if sql}



