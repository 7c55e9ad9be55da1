"""Lines of a company developed together: seemingly unrelated regressions, their errors and correlated draws.

At each age every line's next amount is its slope times its amount, with a variance in proportion to the amount and
errors correlated across lines.  One aggregate over pairs of lines gives, per (company, age), the moments from
which feasible generalised least squares runs to its fixed point inside the row: lines are few, companies many.

Ages with too few origins for a covariance of their own take slopes line by line, the correlation pooled over all
ages, and their own variances (three origins at least) or those of Mack's tail rule along the ages before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.functions.linear import cholesky, inverse, let, normal, positive, solved
from rundelta.functions.storage import kept

ROUNDS = 25


def alike(cells: DataFrame, keys: list[str], line: str) -> DataFrame:
    """``cells`` with ``shape``, which lines of a company share if they show the same origins and ages, and amounts above zero in the same of them.

    Only such lines are regressed together: as a further key it keeps every origin of a line that others do not show.
    """
    whose = {c: f"shape_{c}" for c in (*keys, line)}
    shown = cells.groupBy(*whose).agg(F.md5(F.to_json(F.array_sort(F.collect_set(F.struct("origin_period", "dev_lag", (F.col("value") > 0).alias("positive")))))).alias("shape"))
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in whose.items()]
    return cells.join(shown.withColumnsRenamed(whose), same).drop(*whose.values())


def _pairs(cells: DataFrame, keys: list[str], line: str, step: int) -> tuple[DataFrame, DataFrame]:
    """Links seen by all lines of a company, from amounts above zero (the variance is in proportion to them), and their numbers of lines.

    keys, dev_lag, origin_period, n (origins), x, y (next amount less slope times x), slope, z (its standardised
    residual), by ``line`` number.
    """
    w = Window.partitionBy(*keys, line, "origin_period").orderBy("dev_lag").rangeBetween(step, step)
    lines = cells.select(*keys, line).distinct().withColumn("l", F.row_number().over(Window.partitionBy(*keys).orderBy(line)) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"))
    lines = kept(lines, "sur-lines")
    links = cells.select(*keys, line, "origin_period", "dev_lag", F.col("value").alias("x"), F.max("value").over(w).alias("next")).where("next is not null and x > 0")
    same = [links[c].eqNullSafe(lines[c]) for c in (*keys, line)]
    links = links.join(lines, same).drop(*[lines[c] for c in (*keys, line)])
    links = links.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy(*keys, "origin_period", "dev_lag"))).where("met = k")
    age = Window.partitionBy(*keys, line, "dev_lag")
    links = links.withColumn("slope", F.sum("next").over(age) / F.sum("x").over(age))
    links = links.withColumn("y", F.col("next") - F.col("slope") * F.col("x")).withColumn("r", F.col("y") / F.sqrt("x"))
    links = links.withColumns({"n": F.count(F.lit(1)).over(age), "sd": F.stddev_samp("r").over(age)})
    return links.select(*keys, "dev_lag", "origin_period", "l", "k", "n", "x", "y", "slope", F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("r") / F.col("sd")).alias("z")), lines


def _square(name: str, wide: str = "k") -> Column:
    """A k by k array of arrays from the map ``name`` of (p * k + q)."""
    return F.expr(f"transform(sequence(0, {wide} - 1), p -> transform(sequence(0, {wide} - 1), q -> {name}[p * {wide} + q]))")


def steps(cells: DataFrame, keys: list[str], line: str, step: int, rounds: int = ROUNDS, least_origins: int | None = None) -> DataFrame:
    """keys, dev_lag, k, n, method, beta, sigma, coef_cov of every age, arrays in order of lines.

    ``method``: ``fgls`` with at least ``least_origins`` (lines and two) origins, ``pooled_corr`` with three,
    else ``tail``.  Covariances that are not positive definite are drawn to their diagonals as far as needed.
    """
    links, _ = _pairs(cells, keys, line, step)
    links = kept(links, "sur-links")
    other = links.select(*keys, "dev_lag", "origin_period", F.col("l").alias("q"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    both = links.join(other, [*keys, "dev_lag", "origin_period"])
    s = F.sqrt(F.col("x") * F.col("x2"))
    at = (F.col("l") * F.col("k") + F.col("q")).alias("at")
    sums = both.groupBy(*keys, "dev_lag", "k", at).agg(F.first("n").alias("n"), F.sum(F.col("y") * F.col("y2") / s).alias("yy"), F.sum(F.col("y") * F.col("x2") / s).alias("yx"), F.sum(s).alias("xx"), F.first(F.when(F.col("l") == F.col("q"), F.struct("l", "slope")), ignorenulls=True).alias("slope"))
    moments = {c: F.map_from_entries(F.collect_list(F.struct("at", c))).alias(c) for c in ("yy", "yx", "xx")}
    rows = sums.groupBy(*keys, "dev_lag", "k").agg(F.first("n").alias("n"), *moments.values(), F.transform(F.array_sort(F.collect_list("slope")), lambda x: x["slope"]).alias("slopes"))
    rows = rows.withColumns({c: _square(c) for c in moments})
    # Only ages at which every line has a standardised residual are pooled.
    pool = both.withColumn("whole", F.min(F.col("z").isNotNull() & F.col("z2").isNotNull()).over(Window.partitionBy(*keys, "dev_lag"))).where("whole")
    corr = pool.groupBy(*keys, "k", at).agg(F.corr("z", "z2").alias("c")).groupBy(*keys, "k").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("corr"))
    corr = corr.select(*keys, F.expr(positive("transform(sequence(0, k - 1), p -> transform(sequence(0, k - 1), q -> if(p = q, 1D, coalesce(corr[p * k + q], 0D))))", "k")).alias("corr"))
    rows = rows.join(corr, keys, "left").withColumn("corr", F.coalesce("corr", F.expr("transform(sequence(0, k - 1), p -> transform(sequence(0, k - 1), q -> if(p = q, 1D, 0D)))")))
    enough = F.col("n") >= (F.col("k") + 2 if least_origins is None else F.lit(least_origins))
    cov = "transform(yy, (row, p) -> transform(row, (v, q) -> (v - d[q] * yx[p][q] - d[p] * yx[q][p] + d[p] * d[q] * xx[p][q]) / (n - 1)))"
    weighted = "transform(w, (row, p) -> transform(row, (v, q) -> v * xx[p][q]))"
    target = "transform(w, (row, p) -> aggregate(transform(row, (v, q) -> v * yx[q][p]), 0D, (s, t) -> s + t))"
    one = let("w", inverse(positive(cov, "k"), "k"), solved(weighted, target, "k"))
    shift = f"aggregate(sequence(1, {rounds}), transform(slopes, x -> 0D), (d, turn) -> {one})"
    # Without the check of the count, ages with one origin would be divided by zero.
    rows = rows.withColumn("method", F.when(enough & (F.col("n") > 1), "fgls").when(F.col("n") >= 3, "pooled_corr").otherwise("tail"))
    rows = rows.withColumn("d", F.when(F.col("method") == "fgls", F.expr(shift)).otherwise(F.expr("transform(slopes, x -> 0D)")))
    rows = kept(rows, "sur-moments")
    own = F.when(F.col("method") == "fgls", F.expr(positive(cov, "k")))
    variance = F.when(F.col("method") == "pooled_corr", F.expr("transform(yy, (row, p) -> row[p] / (n - 1))"))
    rows = rows.withColumns({"own": own, "variance": variance})
    rows = rows.withColumn("variance", F.when(F.col("method") == "fgls", F.expr("transform(own, (row, p) -> row[p])")).otherwise(F.col("variance")))
    # Mack's tail rule reads the two ages before, which may be the rule's own: along the ages of a company.
    ages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dev_lag", "variance"))).alias("ages"))
    rule = "if(size(s) = 0, cast(null as array<double>), if(size(s) = 1, s[0].variance, zip_with(element_at(s, -1).variance, element_at(s, -2).variance, (a, b) -> least(if(b > 0, a * a / b, a), a, b))))"
    run = f"aggregate(ages, cast(array() as array<struct<dev_lag: bigint, variance: array<double>>>), (s, x) -> concat(s, array(named_struct('dev_lag', x.dev_lag, 'variance', coalesce(x.variance, {rule})))))"
    ages = ages.select(*keys, F.explode(F.expr(run)).alias("x")).select(*keys, "x.dev_lag", F.col("x.variance").alias("var"))
    rows = rows.join(ages, [*keys, "dev_lag"])
    sigma = F.when(F.col("method") == "fgls", F.col("own")).otherwise(F.expr("transform(corr, (row, p) -> transform(row, (v, q) -> v * sqrt(var[p] * var[q])))"))
    rows = rows.withColumn("sigma", sigma)
    fgls_cov = let("w", inverse("sigma", "k"), inverse(weighted, "k"))
    coef = F.when(F.col("method") == "fgls", F.expr(fgls_cov)).otherwise(F.expr("transform(xx, (row, p) -> transform(row, (v, q) -> if(p = q, var[p] / v, 0D)))"))
    return rows.select(*keys, "dev_lag", "k", "n", "method", F.zip_with("slopes", "d", lambda a, b: a + b).alias("beta"), "sigma", coef.alias("coef_cov"))


def _latest(cells: DataFrame, keys: list[str], line: str) -> DataFrame:
    """keys, origin_period, latest_dev, amounts (in order of lines) at the last age that all lines of an origin show."""
    n = cells.select(*keys, line).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct(line))).alias("lines"))
    n = n.withColumn("lines", F.transform("lines", lambda x: x[line]))
    rows = cells.groupBy(*keys, "origin_period", "dev_lag").agg(F.array_sort(F.collect_list(F.struct(line, "value"))).alias("v")).join(n, keys).where("size(v) = k")
    last = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, "origin_period").orderBy(F.desc("dev_lag")))).where("turn = 1")
    return last.select(*keys, "origin_period", F.col("dev_lag").alias("latest_dev"), "lines", F.transform("v", lambda x: x["value"]).alias("amounts"))


def _ahead(cells: DataFrame, found: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Origins with the array ``ages`` of the steps before them."""
    ages = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dev_lag", "beta", "sigma", "coef_cov", "k"))).alias("ages"))
    rows = _latest(cells, keys, line).join(ages, keys, "left")
    return rows.withColumn("ages", F.filter("ages", lambda a: a["dev_lag"] >= F.col("latest_dev")))


def points(cells: DataFrame, keys: list[str], line: str, step: int, rounds: int = ROUNDS, found: DataFrame | None = None) -> DataFrame:
    """keys, line, origin_period, latest, ultimate, ibnr."""
    found = steps(cells, keys, line, step, rounds) if found is None else found
    rolled = F.expr("aggregate(coalesce(ages, array()), amounts, (c, a) -> zip_with(c, a.beta, (x, b) -> greatest(x * b, 0D)))")
    rows = _ahead(cells, found, keys, line).withColumn("ultimate", rolled)
    rows = rows.select(*keys, "origin_period", F.explode(F.arrays_zip("lines", "amounts", "ultimate")).alias("x"))
    return rows.select(*keys, F.col("x.lines").alias(line), "origin_period", F.col("x.amounts").alias("latest"), F.col("x.ultimate").alias("ultimate"), (F.col("x.ultimate") - F.col("x.amounts")).alias("ibnr"))


def draws(cells: DataFrame, keys: list[str], line: str, step: int, n_draws: int = 1000, seed: int = 1, found: DataFrame | None = None) -> DataFrame:
    """keys, line, origin_period, draw, ultimate: slopes drawn once a draw for all origins, process shocks by origin.

    Shocks are normal variates of hashes of (seed, company, draw, age, line, origin): the same on any partitioning,
    and correlated across lines by the factors of ``sigma`` and ``coef_cov``.  Amounts stop at zero.
    """
    found = steps(cells, keys, line, step) if found is None else found
    rows = _ahead(cells, found, keys, line)
    factor = {c: F.expr(f"transform(ages, a -> {let('m', f'a.{c}', let('k', 'a.k', cholesky(positive('m', 'k'), 'k')))})") for c in ("sigma", "coef_cov")}
    rows = rows.withColumns({f"{c}_f": x for c, x in factor.items()})
    rows = rows.withColumn("_company", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    shock = lambda tag, extra: f"transform(sequence(0, a.k - 1), l -> {normal(f'{seed}, _company, draw, a.dev_lag, l, {tag}{extra}')})"
    times = lambda m, z: f"transform({m}, row -> aggregate(zip_with(slice(row, 1, size({z})), {z}, (s, t) -> coalesce(s, 0D) * t), 0D, (s, t) -> s + t))"
    slopes = let("z", shock("1", ""), f"zip_with(a.beta, {times('coef_cov_f[i]', 'z')}, (b, e) -> b + e)")
    noise = let("z", shock("2", ", origin_period"), times("sigma_f[i]", "z"))
    stepped = let("b", slopes, let("e", noise, "transform(c, (x, l) -> greatest(x * b[l] + sqrt(greatest(x, 0D)) * e[l], 0D))"))
    rolled = f"aggregate(transform(coalesce(ages, array()), (a, i) -> named_struct('a', a, 'i', i)), amounts, (c, ai) -> {let('a', 'ai.a', let('i', 'ai.i', stepped))})"
    rows = rows.withColumn("ultimate", F.expr(rolled)).select(*keys, "origin_period", "draw", F.explode(F.arrays_zip("lines", "ultimate")).alias("x"))
    return rows.select(*keys, F.col("x.lines").alias(line), "origin_period", "draw", F.col("x.ultimate").alias("ultimate"))
