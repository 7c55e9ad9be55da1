"""Features of every cohort at every cutoff, from one pass: nothing after a cutoff can reach its row.

What a cutoff knows changes only when a cell is valued, so the table holds changes: how much each valuation adds to
the number and the amounts of a link.  Sums of changes along the calendar are what a cutoff knows (a restatement is
a change too), sums of these along ages are totals through an age: two-dimensional prefix sums, by two windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def link_changes(cells: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, dev_lag (from), eval_date, n, previous, following: what each date changes in the sums of an age's links.

    A link exists from the date at which both its cells are known; later valuations of either move its amounts.
    """
    key = [*keys, "origin_period", "dev_lag"]
    none = F.lit(None).cast("double")
    as_previous = cells.select(*key, "eval_date", F.col("value").alias("p"), none.alias("f"))
    as_following = cells.select(*keys, "origin_period", (F.col("dev_lag") - step).alias("dev_lag"), "eval_date", none.alias("p"), F.col("value").alias("f"))
    events = as_previous.unionByName(as_following).where("dev_lag > 0").groupBy(*key, "eval_date").agg(F.max("p").alias("p"), F.max("f").alias("f"))
    w = Window.partitionBy(*key).orderBy("eval_date")
    states = events.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("p", "f")})
    both = F.col("p").isNotNull() & F.col("f").isNotNull()
    states = states.withColumns({"n": both.cast("long"), "previous": F.when(both, F.col("p")).otherwise(F.lit(0.0)), "following": F.when(both, F.col("f")).otherwise(F.lit(0.0))})
    changes = {c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0).cast("long") if c == "n" else F.lit(0.0)) for c in ("n", "previous", "following")}
    moved = states.withColumns({f"d_{c}": x for c, x in changes.items()})
    return moved.groupBy(*keys, "dev_lag", "eval_date").agg(*[F.sum(f"d_{c}").alias(c) for c in changes])


def cutoff_features(cells: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, cutoff, dev_lag, n_links, factor, links_through, volume_through, factor_change, cdf for every cutoff and age.

    A cutoff is each date on which the cohort shows a cell.  ``factor`` is the volume factor of the links then
    known (null without any), ``links_through`` and ``volume_through`` the links and their earlier amounts up to
    that age, ``factor_change`` the factor less that of the cutoff before, ``cdf`` the product of the factors from
    the age on (ages without links count as 1).  An age without a link at the last cutoff has no rows.
    """
    changes = link_changes(cells, keys, step)
    cutoffs = cells.select(*keys, F.col("eval_date")).distinct()
    ages = changes.groupBy(*keys, "dev_lag").agg(F.sum("n").alias("n")).where("n > 0").select(*keys, "dev_lag")
    grid = cutoffs.join(ages, keys).join(changes, [*keys, "dev_lag", "eval_date"], "left")
    calendar = Window.partitionBy(*keys, "dev_lag").orderBy("eval_date").rowsBetween(Window.unboundedPreceding, 0)
    known = grid.select(*keys, "dev_lag", F.col("eval_date").alias("cutoff"), *[F.coalesce(F.sum(c).over(calendar), F.lit(0)).alias(c) for c in ("n", "previous", "following")])
    through = Window.partitionBy(*keys, "cutoff").orderBy("dev_lag").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys, "cutoff").orderBy(F.desc("dev_lag")).rowsBetween(Window.unboundedPreceding, 0)
    factor = F.when(F.col("n") > 0, F.try_divide("following", "previous"))
    out = known.withColumn("factor", factor)
    out = out.withColumns({
        "links_through": F.sum("n").over(through),
        "volume_through": F.sum("previous").over(through),
        "factor_change": F.col("factor") - F.lag("factor").over(Window.partitionBy(*keys, "dev_lag").orderBy("cutoff")),
        "cdf": F.product(F.coalesce("factor", F.lit(1.0))).over(onward),
    })
    return out.select(*keys, "cutoff", "dev_lag", F.col("n").alias("n_links"), "factor", "links_through", "volume_through", "factor_change", "cdf")
