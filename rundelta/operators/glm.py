"""Tweedie models of increments for all cohorts at once: weighted least squares as an iterative Spark job.

The state is a row a cohort: the accepted coefficients, the trial ones and the quasi-likelihood.  A pass joins it to
the cells, each of which has two or three design terms, and sums their weighted outer products: the normal
equations, one map a cohort, solved by a Cholesky factorisation in higher-order functions.  Steps are halved while
the quasi-likelihood falls, cohorts leave once their means stand still or their fit fails, and every pass is a
written table.  Cells are dealt by cohort once a pass; nothing reaches Python or the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.errors import Refusal
from rundelta.functions.storage import kept
from rundelta.operators.fits import BOUNDARY, Tweedie
from rundelta.operators.methods import latest

#: Keys of a cohort's sums: ``a * WIDE + b`` for the products of terms a and b, b = TARGET for those with the response.
WIDE, TARGET = 10_000, 9_999
HALVINGS = 50


def increments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, origin_period, dev_lag, y: a cohort's increments from its cumulative cells."""
    w = Window.partitionBy(*keys, "origin_period").orderBy("dev_lag")
    return cells.select(*keys, "origin_period", "dev_lag", (F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))).alias("y"))


def _designed(inc: DataFrame, keys: list[str], model: Tweedie) -> DataFrame:
    """Increments with their ``terms`` (number, value), ``live``, the number of terms ``p`` and the scale of the cohort.

    With a log link, origins and ages without any losses are fitted by zero outside the regression: not live.
    """
    log, factor = model.link == "log", model.origin == "factor"
    cohort = Window.partitionBy(*keys)
    by = lambda c: Window.partitionBy(*keys, c)
    rows = inc.withColumns({
        "i": F.dense_rank().over(cohort.orderBy("origin_period")) - 1,
        "j": F.dense_rank().over(cohort.orderBy("dev_lag")) - 1,
        "row_live": (F.count_if(F.col("y") != 0).over(by("origin_period")) > 0) if log and factor else F.lit(True),
        "col_live": (F.count_if(F.col("y") != 0).over(by("dev_lag")) > 0) if log else F.lit(True),
        "scale": F.max(F.abs("y")).over(cohort),
        "negative": F.count_if(F.col("y") < 0).over(cohort) > 0,
        "zero": F.count_if(F.col("y") == 0).over(cohort) > 0,
    })
    rows = rows.withColumn("live", F.col("row_live") & F.col("col_live"))
    rows = rows.withColumns({"o": F.dense_rank().over(cohort.orderBy(F.col("row_live").desc(), "origin_period")) - 1, "a": F.dense_rank().over(cohort.orderBy(F.col("col_live").desc(), "dev_lag")) - 1})
    n_o = (F.max(F.when(F.col("row_live"), F.col("o"))).over(cohort) + 1) if factor else F.lit(1)
    rows = rows.withColumns({"n_o": n_o, "n_a": F.max(F.when(F.col("col_live"), F.col("a"))).over(cohort) + 1})
    trend = 1 if model.calendar == "trend" else 0
    return rows.withColumns({"p": F.col("n_o") + F.col("n_a") - 1 + trend, "terms": _terms(model)})


def _terms(model: Tweedie) -> Column:
    """The design's entries that are not zero at (o, a, i, j), as (k, v)."""
    one = F.lit(1.0)
    first = F.struct((F.col("o") if model.origin == "factor" else F.lit(0)).cast("int").alias("k"), one.alias("v"))
    age = F.struct((F.col("n_o") + F.col("a") - 1).cast("int").alias("k"), F.when(F.col("a") > 0, one).otherwise(F.lit(0.0)).alias("v"))
    out = [first, age]
    if model.calendar == "trend":
        out.append(F.struct((F.col("n_o") + F.col("n_a") - 1).cast("int").alias("k"), (F.col("i") + F.col("j")).cast("double").alias("v")))
    return F.filter(F.array(*out), lambda t: t["v"] != 0)


def _eta(beta: str) -> Column:
    return F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["v"] * F.get(F.col(beta), t["k"]))


def _solved() -> Column:
    """(x, least, most): the solution of the normal equations in the map ``sums``, and the extremes of the pivots."""
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (s, t) -> s * t), 0D, (s, t) -> s + t)"
    entry = lambda i, j: f"coalesce(sums[{i} * {WIDE} + {j}], 0D)"
    row = (
        f"aggregate(sequence(0, i), cast(array() as array<double>), (r, j) -> concat(r, array(if(j < i, "
        f"({entry('i', 'j')} - {dot('r', 'slice(m[j], 1, size(r))')}) / greatest(m[j][j], 1e-300D), "
        f"sqrt(greatest({entry('i', 'i')} - {dot('r', 'r')}, 0D))))))"
    )
    lower = f"aggregate(sequence(0, p - 1), cast(array() as array<array<double>>), (m, i) -> concat(m, array({row})))"
    forth = f"aggregate(sequence(0, p - 1), cast(array() as array<double>), (v, i) -> concat(v, array(({entry('i', TARGET)} - {dot('v', 'slice(m[i], 1, i)')}) / greatest(m[i][i], 1e-300D))))"
    back = f"aggregate(sequence(p - 1, 0, -1), cast(array() as array<double>), (v, i) -> concat(array((f[i] - {dot('v', 'transform(slice(m, i + 2, p - 1 - i), l -> l[i])')}) / greatest(m[i][i], 1e-300D)), v))"
    pivots = "transform(m, (l, i) -> l[i])"
    return F.expr(f"transform(array({lower}), m -> transform(array({forth}), f -> named_struct('x', {back}, 'least', array_min({pivots}), 'most', array_max({pivots})))[0])[0]")


def _loss(y: Column, mu: Column, power: float) -> Column:
    if power == 0:
        return (y - mu) * (y - mu)
    if power == 1:
        return mu - y * F.ln(mu)
    if power == 2:
        return y / mu + F.ln(mu)
    return F.pow(mu, F.lit(2 - power)) / (2 - power) - y * F.pow(mu, F.lit(1 - power)) / (1 - power)


def fit_tweedie(cells: DataFrame, keys: list[str], model: Tweedie | None = None, rounds: int = 200, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """The designed increments and a row a cohort: keys, beta, p, scale, phi, reason.

    Reasons: ``not_identified`` (no losses, or cells that cannot tell the terms apart), ``negative_increment`` and
    ``zero_increment`` (what the power does not allow), ``degenerate_fit`` (a mean falls to zero),
    ``negative_fitted_mean`` (identity link), ``did_not_converge``.  A failed cohort has null coefficients.
    """
    model = model or Tweedie()
    power, log = model.power, model.link == "log"
    rows = kept(_designed(increments(cells, keys), keys, model).repartition(*keys), "glm-cells")
    live = rows.where("live").withColumn("y", F.try_divide("y", "scale"))
    cohort = rows.groupBy(*keys).agg(F.first("p").alias("p"), F.first("scale").alias("scale"), F.bool_or("negative").alias("negative"), F.bool_or("zero").alias("zero"), F.count_if("live").alias("n"), F.coalesce(F.avg(F.when(F.col("live") & (F.col("y") > 0), F.col("y") / F.col("scale"))), F.lit(1.0)).alias("level"), F.coalesce(F.avg(F.when(F.col("live"), F.try_divide("y", "scale"))), F.lit(0.0)).alias("mean"))
    bad = F.when(F.coalesce(F.col("scale"), F.lit(0.0)) == 0, "not_identified")
    if power >= 2 or (power >= 1 and model.negative == "refuse"):
        bad = bad.when(F.col("negative"), "negative_increment")
    if power >= 2:
        bad = bad.when(F.col("zero"), "zero_increment")
    none = F.lit(None).cast("array<double>")
    state = kept(cohort.select(*keys, "p", "scale", "n", "level", "mean", none.alias("beta"), none.alias("trial"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("halved"), bad.alias("reason"), bad.isNotNull().alias("done"), F.lit(None).cast("double").alias("squares")), "glm-state")
    ended = [state.where("done")]
    for _ in range(rounds):
        state = kept(_pass(live, state.where("not done"), keys, power, log, tolerance), "glm-state")
        ended.append(state.where("done"))
        if not state.where("not done").limit(1).count():
            break
    else:
        ended.append(state.where("not done").withColumn("reason", F.lit("did_not_converge")))
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    fine, dof = F.col("reason").isNull(), F.col("n") - F.col("p")
    phi = F.when(fine & (dof > 0), F.col("squares") * F.pow("scale", F.lit(2 - power)) / dof)
    return rows, out.select(*keys, F.when(fine, F.col("beta")).alias("beta"), "p", "scale", phi.alias("phi"), "reason")


def _pass(live: DataFrame, state: DataFrame, keys: list[str], power: float, log: bool, tolerance: float) -> DataFrame:
    """One step of every open cohort: the trial is accepted and solved on from, or halved towards what was accepted."""
    y = F.col("y")
    clip = lambda e: F.greatest(F.least(e, F.lit(700.0)), F.lit(-700.0))
    mean = lambda beta: F.exp(clip(_eta(beta))) if log else _eta(beta)
    start = (F.when(y > 0, y).otherwise(F.col("level")) + F.greatest("mean", F.lit(1e-3))) / 2
    cells = live.drop("p", "scale").join(state, keys)
    fresh, first = F.col("trial").isNull(), F.col("beta").isNull()
    cells = cells.withColumns({"mu": F.when(fresh, start).otherwise(mean("trial")), "before": F.when(first, F.lit(None).cast("double")).otherwise(mean("beta"))})
    mu = F.col("mu")
    valid = ~F.isnan("mu") & (F.abs("mu") < 1e300) & ((mu > 0) if log or power > 0 else F.lit(True))
    safe = F.when(valid, mu).otherwise(F.lit(1.0))
    weight = F.pow(safe, F.lit(2 - power)) if log else 1 / F.pow(F.abs(safe), F.lit(power))
    response = F.log(safe) + (y - safe) / safe if log else y
    cells = cells.withColumns({"w": weight, "z": response, "loss": _loss(y, safe, power) if log else F.lit(0.0), "valid": valid})
    pairs = F.expr(
        f"concat(flatten(transform(terms, s -> transform(filter(terms, t -> t.k <= s.k), t -> named_struct('at', s.k * {WIDE} + t.k, 'x', w * s.v * t.v)))), transform(terms, s -> named_struct('at', s.k * {WIDE} + {TARGET}, 'x', w * s.v * z)))"
    )
    products = cells.select(*keys, F.explode(pairs).alias("e")).groupBy(*keys, "e.at").agg(F.sum("e.x").alias("x")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("sums"))
    scalars = cells.groupBy(*keys).agg(
        F.sum("loss").alias("loss"),
        F.bool_and("valid").alias("valid"),
        F.max(F.abs(mu - F.col("before"))).alias("moved"),
        F.bool_or((mu < BOUNDARY) & (y <= 0)).alias("vanishing"),
        F.sum((y - safe) * (y - safe) / F.pow(F.abs(safe), F.lit(power))).alias("now_squares"),
    )
    both = state.join(products, keys).join(scalars, keys)
    falls = F.col("last").isNotNull() & (F.col("loss") > F.col("last") + 1e-9 * F.abs("last") + 1e-12) if log else F.lit(False)
    halve = ~fresh & ~first & (F.col("halved") < HALVINGS) & (~F.col("valid") | falls)
    both = both.withColumns({"halve": halve, "s": F.when(~halve, _solved())})
    stands = ~halve & (F.coalesce(F.col("moved"), F.lit(float("inf"))) <= tolerance)
    reason = (
        F.when(~halve & ~F.col("valid"), "degenerate_fit" if log else "negative_fitted_mean")
        .when(~halve & (F.col("s.least") <= 1e-9 * F.col("s.most")), "not_identified" if log else "degenerate_fit")
        .when(stands & F.col("vanishing") & F.lit(log or power > 0), "degenerate_fit")
    )
    both = both.withColumns({"why": reason, "stands": stands})
    return both.select(
        *keys, "p", "scale", "n", "level", "mean",
        F.when(F.col("halve"), F.col("beta")).otherwise(F.col("trial")).alias("beta"),
        F.when(F.col("halve"), F.zip_with("trial", "beta", lambda a, b: (a + b) / 2)).when(F.col("stands"), F.col("trial")).otherwise(F.col("s.x")).alias("trial"),
        F.when(F.col("halve") | fresh, F.col("last")).otherwise(F.col("loss")).alias("last"),
        F.when(F.col("halve"), F.col("halved") + 1).otherwise(F.lit(0)).alias("halved"),
        F.col("why").alias("reason"),
        (F.col("why").isNotNull() | F.col("stands")).alias("done"),
        F.col("now_squares").alias("squares"),
    )


def fitted_rectangle(rows: DataFrame, fits: DataFrame, keys: list[str], model: Tweedie) -> DataFrame:
    """keys, origin_period, dev_lag, y (null where not observed), fitted: every origin at every age of its cohort."""
    ages = rows.groupBy(*keys, "dev_lag").agg(F.first("j").alias("j"), F.first("a").alias("a"), F.bool_or("col_live").alias("col_live"))
    origins = rows.groupBy(*keys, "origin_period").agg(F.first("i").alias("i"), F.first("o").alias("o"), F.first("n_o").alias("n_o"), F.first("n_a").alias("n_a"), F.bool_or("row_live").alias("row_live"))
    grid = origins.join(ages, keys).withColumn("terms", _terms(model)).join(fits.where("reason is null"), keys)
    eta = _eta("beta")
    mean = F.exp(eta) if model.link == "log" else eta
    grid = grid.withColumn("fitted", F.when(F.col("row_live") & F.col("col_live"), mean * F.col("scale")).otherwise(F.lit(0.0)))
    return grid.join(rows.select(*keys, "origin_period", "dev_lag", "y"), [*keys, "origin_period", "dev_lag"], "left").select(*keys, "origin_period", "dev_lag", "y", "fitted", "phi")


def tweedie(cells: DataFrame, keys: list[str], model: Tweedie | None = None) -> DataFrame:
    """keys, origin_period, latest, ultimate, ibnr, phi, reason: the model's projections; a failed cohort is one row."""
    model = model or Tweedie()
    if not keys:
        raise Refusal("invalid_option", "a cohort key is needed")
    rows, fits = fit_tweedie(cells, keys, model)
    fits = kept(fits, "glm-fits")
    grid = fitted_rectangle(rows, fits, keys, model)
    now = latest(cells, keys).select(*keys, "origin_period", "latest_dev", "latest")
    sums = grid.join(now, [*keys, "origin_period"]).groupBy(*keys, "origin_period").agg(
        F.first("latest").alias("latest"), F.first("phi").alias("phi"), F.sum("fitted").alias("whole"),
        F.sum(F.when(F.col("dev_lag") <= F.col("latest_dev"), F.col("fitted"))).alias("reached"),
        F.sum(F.when(F.col("y").isNull(), F.col("fitted")).otherwise(F.lit(0.0))).alias("ahead"),
        F.min("fitted").alias("least"),
    )
    pattern = F.col("latest") * F.when(F.col("reached") != 0, F.col("whole") / F.col("reached")).otherwise(F.lit(1.0))
    ultimate = F.col("latest") + F.col("ahead") if model.projection == "increments" else pattern
    out = sums.withColumn("ultimate", ultimate)
    lowest = cells.groupBy(*keys).agg(F.min("value").alias("lowest"))
    cohort = Window.partitionBy(*keys)
    out = out.join(lowest, keys)
    reason = F.lit(None).cast("string")
    if model.link == "identity" and model.power > 0:
        reason = F.when(F.min("least").over(cohort) <= 0, "negative_fitted_mean")
    out = out.withColumn("reason", F.coalesce(reason, F.when((F.min("ultimate").over(cohort) < 0) & (F.col("lowest") >= 0), "negative_projection")))
    fine = out.where("reason is null").select(*keys, "origin_period", "latest", "ultimate", (F.col("ultimate") - F.col("latest")).alias("ibnr"), "phi", "reason")
    turned = out.where("reason is not null").select(*keys, "reason").unionByName(fits.where("reason is not null").select(*keys, "reason")).distinct()
    return fine.unionByName(turned, allowMissingColumns=True)
