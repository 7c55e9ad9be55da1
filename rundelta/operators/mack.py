"""Mack's chain-ladder uncertainty and the one-year claims development result, for every cohort.

A cohort is one triangle, so it is small, and there are many.  Cells are dealt by cohort once; every
window, aggregate and join after that is by cohort or finer and needs no further shuffle.  A cohort's
ages travel as one array of its row, along which its origins are projected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.operators.links import LinkRules, factor_of, select_links, usable
from rundelta.operators.methods import latest

#: The average that goes with each variance exponent: sigma^2 scales with cumulative^alpha.
ALPHAS = {"volume": 1, "simple": 0, "regression": 2}


def _dealt(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells' own columns, dealt by cohort."""
    return cells.select(*keys, "origin_period", "dev_lag", "eval_date", "value").repartition(*keys)


def mack_factors(cells: DataFrame, keys: list[str], step: int, average: str = "volume", sigma_rule: str = "log_linear", rules: LinkRules | None = None) -> DataFrame:
    """keys, dev_lag, factor, weight (S), n, sigma2, sigma_extrapolated, reason.

    The last age with one link takes its sigma from ``sigma_rule``: ``mack`` (the smallest of its two
    predecessors and their extrapolation; its one predecessor; 0 without any) or ``log_linear`` (a line
    through the logs of all sigmas if they are positive and at least two, else the mack rule).  An
    earlier age with one link is filled by ``log_linear`` from all ages of positive sigma, two at
    least, or by ``mack`` from the two ages just before it; where these have no sigma of their own,
    ``sigma2`` is null and ``reason`` is ``variance_not_estimable``.  An age whose links are all left out
    takes the factor 1 without a sigma and the reason ``no_link_ratio``, so errors that pass it are null.
    """
    if average not in ALPHAS or sigma_rule not in ("mack", "log_linear"):
        raise Refusal("invalid_option", f"{average}, {sigma_rule}")
    a = ALPHAS[average]
    links = select_links(_dealt(cells, keys), keys, step, rules)
    links = links.withColumns({c: F.when(F.col("included"), F.col(c)) for c in ("previous", "following", "ratio")})
    links = links.withColumn("factor", factor_of(average, Window.partitionBy(*keys, "dev_lag")))
    links = links.withColumn("factor", F.when(usable(F.col("factor")), F.col("factor")).otherwise(F.lit(1.0)))
    weight = F.pow("previous", F.lit(a))
    found = links.groupBy(*keys, "dev_lag").agg(
        F.first("factor").alias("factor"),
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight"),
        F.count_if("included").alias("n_included"),
        F.count_if(F.col("previous") > 0).alias("n"),
        F.sum(F.when(F.col("previous") > 0, weight * F.pow(F.col("ratio") - F.col("factor"), F.lit(2)))).alias("squares"),
    )
    cohort, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("dev_lag")
    found = found.withColumn("estimated", F.when(F.col("n") > 1, F.col("squares") / (F.col("n") - 1)))
    ln = F.when(F.col("estimated") > 0, F.ln(F.col("estimated")) / 2)
    found = found.withColumns({"t": (F.col("dev_lag") / step).cast("int"), "s1": F.lag("estimated", 1).over(order), "s2": F.lag("estimated", 2).over(order), "is_last": F.col("dev_lag") == F.max("dev_lag").over(cohort)})
    found = found.withColumns({
        "gaps": F.count_if(F.col("estimated").isNull() & ~F.col("is_last")).over(cohort) > 0,
        "positive": F.count(ln).over(cohort),
        "known": F.count("estimated").over(cohort),
        "slope": F.regr_slope(ln, "t").over(cohort),
        "base": F.regr_intercept(ln, "t").over(cohort),
    })
    two = F.least(F.when(F.col("s2") <= 0, F.col("s1")).otherwise(F.col("s1") * F.col("s1") / F.col("s2")), F.col("s1"), F.col("s2"))
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    mack = F.when(both, two).when(~F.col("gaps"), F.coalesce("s1", F.lit(0.0)))
    if sigma_rule == "log_linear":
        line = F.exp(2 * (F.col("base") + F.col("slope") * F.col("t")))
        extrapolated = F.when(F.col("gaps"), F.when(F.col("positive") >= 2, line)).otherwise(F.when((F.col("positive") >= 2) & (F.col("positive") == F.col("known")), line).otherwise(mack))
    else:
        extrapolated = mack
    sigma2 = F.when(F.col("n_included") > 0, F.coalesce("estimated", extrapolated))
    reason = F.when(F.col("n_included") == 0, "no_link_ratio").when(sigma2.isNull(), "variance_not_estimable")
    return found.select(*keys, "dev_lag", "factor", "weight", "n", sigma2.alias("sigma2"), F.col("estimated").isNull().alias("sigma_extrapolated"), reason.alias("reason"))


def tail_variance(factors: DataFrame, keys: list[str], step: int, tail: DataFrame) -> DataFrame:
    """keys, tail_factor, position, tail_sigma2, tail_se2, reason: the tail as one more step of Mack's model.

    ``tail`` has keys and tail_factor, and may have tail_sigma and tail_std_err, which stand in place of
    what is read off.  Read off are straight lines by age number: that through ln(factor - 1), over
    factors above 1, reaches ln(tail_factor - 1) at ``position``, where those through ln(sigma) and
    ln(standard error) give the tail's.  A tail of 1 has no variance.  ``reason`` is
    ``variance_not_estimable`` for a tail below 1, fewer than two points of a line, factors that do not
    fall, and a position before the first link; the variances that are not given are null then.
    """
    t, se2 = F.col("dev_lag") / step, F.col("sigma2") / F.col("weight")
    points = {
        "f": F.when(F.col("factor") > 1, F.ln(F.col("factor") - 1)),
        "s": F.when(F.col("sigma2") > 0, F.ln("sigma2") / 2),
        "e": F.when(se2 > 0, F.ln(se2) / 2),
    }
    lines = factors.groupBy(*keys).agg(*[x for k, y in points.items() for x in (F.regr_slope(y, t).alias(f"{k}_slope"), F.regr_intercept(y, t).alias(f"{k}_base"), F.count(y).alias(f"{k}_n"))])
    given = [F.col(c).cast("double") if c in tail.columns else F.lit(None).cast("double") for c in ("tail_sigma", "tail_std_err")]
    out = tail.select(*keys, F.col("tail_factor").cast("double").alias("tail_factor"), given[0].alias("sigma"), given[1].alias("std_err")).join(lines, keys)
    ok = (F.col("tail_factor") > 1) & (F.col("f_n") >= 2) & (F.col("f_slope") < 0)
    position = F.when(ok, (F.ln(F.col("tail_factor") - 1) - F.col("f_base")) / F.col("f_slope"))
    out = out.withColumn("position", F.when(position >= 1, position))

    def read(own: str, k: str) -> Column:
        line = F.when(F.col(f"{k}_n") >= 2, F.exp(2 * (F.col(f"{k}_base") + F.col(f"{k}_slope") * F.col("position"))))
        return F.when(F.col(own).isNotNull(), F.col(own) * F.col(own)).when(F.col("tail_factor") == 1, F.lit(0.0)).otherwise(line)

    out = out.withColumns({"tail_sigma2": read("sigma", "s"), "tail_se2": read("std_err", "e")})
    reason = F.when(F.col("tail_sigma2").isNull() | F.col("tail_se2").isNull(), "variance_not_estimable")
    return out.select(*keys, "tail_factor", "position", "tail_sigma2", "tail_se2", reason.alias("reason"))


def _ages(factors: DataFrame, keys: list[str]) -> DataFrame:
    """A row per cohort: ``ages``, its factors in order of age."""
    return factors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dev_lag", "factor", "weight", "sigma2"))).alias("ages"))


def _projected(origins: DataFrame, alpha: int) -> DataFrame:
    """Origins (with their cohort's ``ages``) with ultimate, process and parameter shares of its square."""
    # A sum that starts from a plain literal may not become null: an age without sigma would add nothing.
    zero = F.when(F.col("latest").isNotNull(), F.lit(0.0))
    start = F.struct(F.col("latest").alias("amount"), zero.alias("process"), zero.alias("parameter"))

    def step(a: Column, x: Column) -> Column:
        ratio = x["sigma2"] / (x["factor"] * x["factor"])
        base = {0: F.lit(1.0), 1: a["amount"], 2: a["amount"] * a["amount"]}[alpha]
        return F.struct((a["amount"] * x["factor"]).alias("amount"), (a["process"] + ratio / base).alias("process"), (a["parameter"] + ratio / x["weight"]).alias("parameter"))

    ahead = F.filter(F.coalesce("ages", F.array().cast("array<struct<dev_lag: bigint, factor: double, weight: double, sigma2: double>>")), lambda x: x["dev_lag"] >= F.col("latest_dev"))
    out = origins.withColumn("run", F.aggregate(ahead, start, step))
    return out.withColumns({"ultimate": F.col("run.amount"), "process": F.col("run.process"), "parameter": F.col("run.parameter")}).drop("run", "ages")


def _origins(cells: DataFrame, keys: list[str], step: int, average: str, sigma_rule: str, rules: LinkRules | None, tail: DataFrame | None) -> DataFrame:
    """Origins with latest, ultimate and the two variances as shares of the squared ultimate, a tail step included."""
    factors = mack_factors(cells, keys, step, average, sigma_rule, rules)
    alpha = ALPHAS[average]
    out = _projected(latest(_dealt(cells, keys), keys).join(_ages(factors, keys), keys, "left"), alpha)
    if tail is None:
        return out
    more = tail_variance(factors, keys, step, tail).select(*keys, "tail_factor", "tail_sigma2", "tail_se2")
    out = out.join(more, keys, "left")
    square = F.col("tail_factor") * F.col("tail_factor")
    none = F.col("tail_factor").isNull()
    return out.withColumns({
        "process": F.when(none, F.col("process")).otherwise(F.col("process") + F.col("tail_sigma2") / square / F.pow("ultimate", F.lit(alpha))),
        "parameter": F.when(none, F.col("parameter")).otherwise(F.col("parameter") + F.col("tail_se2") / square),
        "ultimate": F.col("ultimate") * F.coalesce("tail_factor", F.lit(1.0)),
    }).drop("tail_factor", "tail_sigma2", "tail_se2")


def mack(cells: DataFrame, keys: list[str], step: int, average: str = "volume", sigma_rule: str = "log_linear", rules: LinkRules | None = None, tail: DataFrame | None = None) -> DataFrame:
    """keys, origin_period, latest, ultimate, ibnr, process_se, parameter_se, mack_se.

    ``tail`` (see ``tail_variance``) is one more step, taken by every origin.  An open origin without any
    losses has no error: every term of it is proportional to its amount.
    """
    out = _origins(cells, keys, step, average, sigma_rule, rules, tail)
    u = F.col("ultimate")

    def error(share: Column) -> Column:
        return F.when(u == 0, F.lit(0.0)).otherwise(u * F.sqrt(share))

    out = out.withColumns({"process_se": error(F.col("process")), "parameter_se": error(F.col("parameter")), "mack_se": error(F.col("process") + F.col("parameter")), "ibnr": u - F.col("latest")})
    return out.select(*keys, "origin_period", "latest_dev", "latest", "ultimate", "ibnr", "process_se", "parameter_se", "mack_se")


def _later(keys: list[str]) -> Column:
    """The sum of the ultimates of later (less developed) origins."""
    w = Window.partitionBy(*keys).orderBy(F.col("origin_period").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("ultimate").over(w), F.lit(0.0))


def mack_totals(cells: DataFrame, keys: list[str], step: int, average: str = "volume", sigma_rule: str = "log_linear", rules: LinkRules | None = None, tail: DataFrame | None = None) -> DataFrame:
    """keys, latest, ultimate, ibnr, mack_se of each cohort; origins are tied by the common factor errors.

    Two origins share the parameter errors of the older one's open ages, so the cross term needs, for
    each origin, the sum of the ultimates of later ones: a window, not a self-join.
    """
    rows = _origins(cells, keys, step, average, sigma_rule, rules, tail).withColumn("later", _later(keys))
    u = F.col("ultimate")
    msep = F.when(u == 0, F.lit(0.0)).otherwise(u * u * (F.col("process") + F.col("parameter")) + 2 * u * F.col("later") * F.col("parameter"))
    return rows.groupBy(*keys).agg(F.sum("latest").alias("latest"), F.sum("ultimate").alias("ultimate"), F.sum(u - F.col("latest")).alias("ibnr"), F.sqrt(F.sum(msep)).alias("mack_se"))


def next_cells(cells: DataFrame, keys: list[str], step: int, average: str = "volume", sigma_rule: str = "log_linear", rules: LinkRules | None = None) -> DataFrame:
    """keys, origin_period, dev_lag (of the coming cell), latest, mean, process_sd, parameter_sd of every open origin."""
    alpha = ALPHAS[average]
    ages = _ages(mack_factors(cells, keys, step, average, sigma_rule, rules), keys)
    rows = latest(_dealt(cells, keys), keys).join(ages, keys).withColumn("x", F.get(F.filter("ages", lambda x: x["dev_lag"] == F.col("latest_dev")), F.lit(0))).where("x is not null")
    c = F.col("latest")
    return rows.select(*keys, "origin_period", (F.col("latest_dev") + step).alias("dev_lag"), "latest", (c * F.col("x.factor")).alias("mean"), F.sqrt(F.col("x.sigma2") * F.pow(c, F.lit(2 - alpha))).alias("process_sd"), (c * F.sqrt(F.col("x.sigma2") / F.col("x.weight"))).alias("parameter_sd"))


def one_year_cdr(cells: DataFrame, keys: list[str], step: int, sigma_rule: str = "mack") -> tuple[DataFrame, DataFrame]:
    """Merz-Wuthrich: per origin (ultimate, ibnr, cdr_se) and per cohort (ibnr, cdr_se).

    With ratio_j = sigma_j^2 / f_j^2, S_j the weight of the links at age j, C_j the amount of the origin
    now at age j, and share_j = C_j / (S_j + C_j):

    * origin i at age k:   U^2 (ratio_k / C_k + ratio_k / S_k + sum over later ages j of share_j ratio_j / S_j)
      with share_j^2 ratio_j / C_j as the part of the coming diagonal's noise;
    * two origins:         U U' times the same shared terms from the age of the older origin on.
    """
    ages = _ages(mack_factors(cells, keys, step, "volume", sigma_rule), keys)
    base = latest(_dealt(cells, keys), keys)
    diagonal = base.groupBy(*keys).agg(F.collect_list(F.struct("latest_dev", "latest")).alias("diagonal"))
    rows = ages.join(diagonal, keys).select(*keys, F.explode("ages").alias("x"), "diagonal")
    now = F.filter("diagonal", lambda d: d["latest_dev"] == F.col("x.dev_lag"))
    rows = rows.select(*keys, "x.*", F.when(F.size(now) > 0, F.aggregate(now, F.lit(0.0), lambda a, d: a + d["latest"])).alias("on_diagonal"))
    ratio = F.col("sigma2") / (F.col("factor") * F.col("factor"))
    share = F.col("on_diagonal") / (F.col("weight") + F.col("on_diagonal"))
    down = Window.partitionBy(*keys).orderBy(F.col("dev_lag").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # What later ages add for any origin: the parameter error that the coming diagonal resolves.
    rows = rows.withColumns({"ratio": ratio, "resolved": F.coalesce(share * ratio / F.col("weight"), F.lit(0.0))})
    rows = rows.withColumn("beyond", F.coalesce(F.sum("resolved").over(down), F.lit(0.0)))
    own = F.col("ratio") / F.col("on_diagonal") + F.col("ratio") / F.col("weight") + F.col("beyond")
    tied = F.col("ratio") / F.col("weight") + F.col("beyond")
    shape = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dev_lag", "factor", "weight", "sigma2"))).alias("ages"), F.collect_list(F.struct("dev_lag", own.alias("own"), tied.alias("tied"))).alias("terms"))
    rows = _projected(base.join(shape, keys, "left"), 1)
    term = F.get(F.filter("terms", lambda x: x["dev_lag"] == F.col("latest_dev")), F.lit(0))
    rows = rows.withColumns({"own": F.coalesce(term["own"], F.lit(0.0)), "tied": F.coalesce(term["tied"], F.lit(0.0))})
    u = F.col("ultimate")
    origins = rows.select(*keys, "origin_period", "latest", "ultimate", (u - F.col("latest")).alias("ibnr"), (u * F.sqrt("own")).alias("cdr_se"))
    pairs = rows.withColumn("later", _later(keys))
    total = pairs.groupBy(*keys).agg(F.sum(u - F.col("latest")).alias("ibnr"), F.sqrt(F.sum(u * u * F.col("own") + 2 * u * F.col("later") * F.col("tied"))).alias("cdr_se"))
    return origins, total
