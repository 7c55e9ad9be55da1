"""The long triangle: a DataFrame of observations with its grains and measure.

Core columns are ``origin_period`` (first day), ``dev_lag`` (months), ``eval_date``, ``field`` and
``value``; every other column is a segment key, and each combination of those is a cohort.  All
operations are lazy plans over any number of cohorts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from rundelta.errors import Refusal

CORE = {"origin_period": "date", "dev_lag": "bigint", "eval_date": "date", "field": "string", "value": "double"}
MONTHS = {"Y": 12, "Q": 3, "M": 1}
_TRUNC = {"Y": "year", "Q": "quarter", "M": "month"}


@dataclass(frozen=True)
class TriangleMeta:
    origin_grain: str = "Y"
    dev_grain: str = "Y"
    measure: str = "cumulative"
    units: str = "currency"

    def __post_init__(self):
        if self.origin_grain not in MONTHS or self.dev_grain not in MONTHS or self.measure not in ("cumulative", "incremental"):
            raise Refusal("invalid_option", f"no such grain or measure: {self}")

    @property
    def grain(self) -> str:
        return f"O{self.origin_grain}D{self.dev_grain}"

    @property
    def step(self) -> int:
        return MONTHS[self.dev_grain]


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def implied_dev_lag(origin: Column, eval_date: Column) -> Column:
    """Months from the origin's start to the end of the evaluation month."""
    return (month_number(eval_date) - month_number(origin) + 1).cast("bigint")


def grouped(*keys: str) -> WindowSpec:
    """A window partition by keys that is sorted by their hash first: one number decides most comparisons, not strings."""
    return Window.partitionBy(F.xxhash64(*keys), *keys)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class Triangle:
    """An immutable pair of a DataFrame and its meta data."""

    def __init__(self, df: DataFrame, meta: TriangleMeta | None = None):
        missing = [c for c in CORE if c not in df.columns]
        if missing:
            raise Refusal("invalid_table", f"missing columns {missing}")
        self.meta = meta or TriangleMeta()
        types = dict(df.dtypes)
        self.df = df.withColumns({c: F.col(c).cast(t) for c, t in CORE.items() if types[c] != t})

    # --- building -----------------------------------------------------------------------------

    @classmethod
    def from_long(cls, data: DataFrame, origin: str = "origin_period", dev: str = "dev_lag", eval_date: str = "eval_date", field: str = "field", value: str = "value", fields: list[str] | None = None, segments: list[str] | None = None, dev_lag_unit: str = "months", strict: bool = True, **meta) -> Triangle:
        """Rename, unpivot ``fields`` if given, drop null values (absent is unobserved), refuse null segments."""
        m = TriangleMeta(**meta)
        df = data.withColumnsRenamed({k: v for k, v in {origin: "origin_period", dev: "dev_lag", eval_date: "eval_date", field: "field", value: "value"}.items() if k != v})
        axes = ["origin_period", "dev_lag", "eval_date"]
        if fields:
            ids = [c for c in df.columns if c not in fields and c not in ("field", "value")]
            df = df.withColumns({c: F.col(c).cast("double") for c in fields}).unpivot(ids, fields, "field", "value")
        if segments is not None:
            df = df.select(*segments, *axes, "field", "value")
        if dev_lag_unit == "periods":
            df = df.withColumn("dev_lag", F.col("dev_lag") * m.step)
        elif dev_lag_unit != "months":
            raise Refusal("invalid_option", f"dev_lag_unit {dev_lag_unit!r}")
        out = cls(df.where(F.col("value").isNotNull()), m)
        keys = out.segments
        if strict and keys:
            bad = out.df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first()
            if any(bad):
                raise Refusal("missing_value", f"null segments: {bad.asDict()}")
        return out

    @classmethod
    def from_columns(cls, spark: SparkSession, columns, **options) -> Triangle:
        """From what is in memory: a dict of columns, an Arrow table or a pandas frame, as ``from_long`` takes it."""
        import pyarrow as pa

        return cls.from_long(spark.createDataFrame(pa.table(columns) if isinstance(columns, dict) else columns), **options)

    @classmethod
    def from_wide(cls, wide: DataFrame, segments: list[str] = (), origin: str = "origin_period", field: str = "paid_loss", **meta) -> Triangle:
        """From a row per origin and a column per age (named by months); null cells are unobserved."""
        ages = [c for c in wide.columns if c not in (*segments, origin)]
        if not ages or not all(a.isdigit() for a in ages):
            raise Refusal("invalid_age", f"columns {[a for a in ages if not a.isdigit()]}")
        long = wide.withColumns({a: F.col(a).cast("double") for a in ages}).unpivot([*segments, origin], ages, "dev_lag", "value")
        long = long.withColumns({"dev_lag": F.col("dev_lag").cast("bigint"), "field": F.lit(field)})
        ends = F.last_day(F.add_months(F.col(origin), (F.col("dev_lag") - 1).cast("int")))
        return cls.from_long(long.withColumn("eval_date", ends), origin=origin, **meta)

    @classmethod
    def from_arrow(cls, spark: SparkSession, table) -> Triangle:
        """From what ``to_arrow`` made."""
        if peek_kind(table) != "triangle":
            raise Refusal("invalid_table", "not a triangle")
        note = {k.decode(): v.decode() for k, v in table.schema.metadata.items()}
        return cls(spark.createDataFrame(table.replace_schema_metadata(None)), TriangleMeta(*(note[k] for k in ("origin_grain", "dev_grain", "measure", "units"))))

    def with_df(self, df: DataFrame, **changes) -> Triangle:
        return Triangle(df, replace(self.meta, **changes))

    # --- looking ------------------------------------------------------------------------------

    @property
    def segments(self) -> list[str]:
        return [c for c in self.df.columns if c not in CORE]

    @property
    def series(self) -> list[str]:
        """Segment keys and the field."""
        return [*self.segments, "field"]

    @property
    def cell(self) -> list[str]:
        return [*self.series, "origin_period", "dev_lag"]

    def distinct(self, column: str) -> DataFrame:
        return self.df.select(column).distinct()

    def summary(self) -> DataFrame:
        """A row per field: cells, cohorts, first and last origin, age and evaluation date, one aggregate."""
        cohort = F.count_distinct(F.struct(*self.segments)) if self.segments else F.lit(1)
        ends = [f(c).alias(f"{n}_{c}") for c in ("origin_period", "dev_lag", "eval_date") for f, n in ((F.min, "first"), (F.max, "last"))]
        return self.df.groupBy("field").agg(F.count(F.lit(1)).alias("n_cells"), cohort.cast("bigint").alias("n_cohorts"), F.count_distinct("origin_period").alias("n_origins"), F.count_distinct("dev_lag").alias("n_ages"), *ends)

    def to_arrow(self):
        """The whole table in memory, its meta data beside it; for triangles that a client can hold."""
        m = self.meta
        note = {"kind": "triangle", "origin_grain": m.origin_grain, "dev_grain": m.dev_grain, "measure": m.measure, "units": m.units}
        return self.df.toArrow().replace_schema_metadata(note)

    def fields(self) -> list[str]:
        return sorted(r[0] for r in self.distinct("field").collect())

    def view(self, name: str) -> None:
        """Make the triangle reachable from SQL."""
        self.df.createOrReplaceTempView(name)

    # --- filters ------------------------------------------------------------------------------

    def filter(self, *conditions: Column | str) -> Triangle:
        return self.with_df(reduce(lambda d, c: d.where(c), conditions, self.df))

    def select_fields(self, *names: str) -> Triangle:
        return self.with_df(self.df.where(F.col("field").isin(*names)))

    def as_of(self, day) -> Triangle:
        """What was known on ``day``: observations up to it, the latest restatement of each cell.

        Two observations of a cell on one day both stay (``rank``, not ``row_number``).
        """
        known = self.df.where(F.col("eval_date") <= F.lit(day).cast("date"))
        return self.with_df(_first_ranked(known, self.cell, F.col("eval_date").desc()))

    def latest_diagonal(self) -> Triangle:
        """The deepest cell of each origin, in its latest restatement."""
        return self.with_df(_first_ranked(self.df, [*self.series, "origin_period"], F.col("dev_lag").desc(), F.col("eval_date").desc()))

    # --- measures and grains ------------------------------------------------------------------

    def to_cumulative(self) -> Triangle:
        if self.meta.measure == "cumulative":
            return self
        w = grouped(*self.series, "origin_period").orderBy("dev_lag").rangeBetween(Window.unboundedPreceding, 0)
        return self.with_df(self.df.withColumn("value", F.sum("value").over(w)), measure="cumulative")

    def to_incremental(self) -> Triangle:
        """Less the cell exactly one step before; the first age keeps its value, and after a gap there is no increment."""
        if self.meta.measure == "incremental":
            return self
        step = self.meta.step
        w = grouped(*self.series, "origin_period").orderBy("dev_lag").rangeBetween(-step, -step)
        first = self.df.agg(F.min("dev_lag").alias("first_dev"))
        df = self.df.withColumn("before", F.max("value").over(w)).crossJoin(F.broadcast(first))
        df = df.withColumn("value", F.when(F.col("dev_lag") == F.col("first_dev"), F.col("value")).otherwise(F.col("value") - F.col("before")))
        return self.with_df(df.where(F.col("value").isNotNull()).drop("before", "first_dev"), measure="incremental")

    def with_dev_grain(self, grain: str, strict: bool = True) -> Triangle:
        """Coarser development periods, counted back from the latest evaluation date."""
        if grain not in MONTHS:
            raise Refusal("invalid_option", f"unknown grain {grain!r}")
        if grain == self.meta.dev_grain:
            return self
        target = MONTHS[grain]
        if target < self.meta.step or target % self.meta.step:
            raise Refusal("grain_mismatch", f"cannot turn {self.meta.dev_grain} into {grain}")
        if strict:
            self.require_single_observation()
        anchor = self.df.agg(month_number(F.max("eval_date")).alias("anchor"))
        df = self.df.crossJoin(F.broadcast(anchor)).withColumn("behind", F.col("anchor") - month_number(F.col("eval_date")))
        if self.meta.measure == "cumulative":
            return self.with_df(df.where(F.col("behind") % target == 0).drop("anchor", "behind"), dev_grain=grain)
        df = df.groupBy(*self.series, "origin_period", F.floor(F.col("behind") / target).alias("bucket")).agg(F.max("dev_lag").alias("dev_lag"), F.max("eval_date").alias("eval_date"), F.sum("value").alias("value"))
        return self.with_df(df.drop("bucket"), dev_grain=grain)

    def with_origin_grain(self, grain: str, strict: bool = True) -> Triangle:
        """Coarser origins; ages follow from the evaluation date."""
        if grain not in MONTHS:
            raise Refusal("invalid_option", f"unknown grain {grain!r}")
        if grain == self.meta.origin_grain:
            return self
        if MONTHS[grain] < MONTHS[self.meta.origin_grain]:
            raise Refusal("grain_mismatch", f"cannot turn {self.meta.origin_grain} into {grain}")
        if strict and not self.findings_frame(["eval_alignment"]).where("n > 0").isEmpty():
            raise Refusal("grain_mismatch", "evaluation dates disagree with ages")
        df = self.df.withColumn("origin_period", F.trunc("origin_period", _TRUNC[grain]))
        df = df.withColumn("dev_lag", implied_dev_lag(F.col("origin_period"), F.col("eval_date")))
        return self.with_df(df.groupBy(*self.cell, "eval_date").agg(F.sum("value").alias("value")), origin_grain=grain)

    def to_wide(self, field: str, lags: list[int], strict: bool = True) -> DataFrame:
        """Origins by ages of one field; values of different segments are added."""
        if strict:
            self.require_single_observation()
        return self.df.where(F.col("field") == field).groupBy("origin_period").pivot("dev_lag", lags).agg(F.sum("value"))

    # --- checks -------------------------------------------------------------------------------

    def require_single_observation(self) -> None:
        found = self.df.groupBy(*self.cell).count().where("count > 1").limit(100).collect()
        if found:
            raise Refusal("duplicate", f"{len(found)} cells are stored more than once", cells=tuple(found))

    def findings_frame(self, checks: list[str] | None = None) -> DataFrame:
        """A row per check with the number of offending rows or cells.

        Row checks share one aggregate over the table and cell checks one aggregate by cell.
        """
        step, keys = self.meta.step, self.segments
        offset = F.pmod("dev_lag", F.lit(step))
        # The offset that ages should have: the smallest one on the latest evaluation date.
        anchor = self.df.where("dev_lag > 0").agg(F.min_by(offset, F.struct(-F.unix_date("eval_date"), offset)).alias("anchor"))
        rows = self.df.crossJoin(F.broadcast(anchor)).agg(
            F.count_if(any_of(F.col(c).isNull() for c in CORE)).alias("null_values"),
            F.count_if(any_of(F.col(c).isNull() for c in keys)).alias("null_segments"),
            F.count_if(implied_dev_lag(F.col("origin_period"), F.col("eval_date")) != F.col("dev_lag")).alias("eval_alignment"),
            F.count_if((F.col("dev_lag") <= 0) | (offset != F.col("anchor"))).alias("dev_lag_on_grain"),
        )
        per_cell = self.df.groupBy(*self.cell, "eval_date").agg(F.count(F.lit(1)).alias("n")).groupBy(*self.cell).agg(F.count_if(F.col("n") > 1).alias("doubled"), F.count(F.lit(1)).alias("dates"))
        cells = per_cell.agg(F.coalesce(F.sum("doubled"), F.lit(0)).alias("duplicate_cells"), F.count_if(F.col("dates") > 1).alias("restated_cells"))
        names = ["null_values", "null_segments", "duplicate_cells", "restated_cells", "eval_alignment", "dev_lag_on_grain"]
        out = rows.crossJoin(cells).select(*[F.col(c).cast("bigint").alias(c) for c in names]).unpivot([], names, "check", "n")
        return out.where(F.col("check").isin(checks)) if checks else out

    def validate(self, strict: bool = False) -> list[str]:
        found = [f"{r['check']}: {r['n']}" for r in self.findings_frame().where("n > 0").collect()]
        if strict and found:
            raise Refusal("invalid_table", "; ".join(found))
        return found


def _first_ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = grouped(*keys).orderBy(*order)
    return df.withColumn("__rank", F.rank().over(w)).where("__rank = 1").drop("__rank")


def peek_kind(table) -> str | None:
    """What an Arrow table says it holds."""
    return ((table.schema.metadata or {}).get(b"kind") or b"").decode() or None


def inferred_step(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step: the smallest distance between ages of a cohort, or its only age.

    Ages are few, so their set is an aggregate's buffer.
    """
    ages = F.array_sort(F.collect_set("dev_lag"))
    out = df.groupBy(*keys).agg(ages.alias("ages"))
    gaps = F.zip_with(F.slice("ages", 2, F.size("ages")), F.slice("ages", 1, F.greatest(F.lit(1), F.size("ages") - 1)), lambda b, a: b - a)
    return out.select(*keys, F.when(F.size("ages") > 1, F.array_min(gaps)).otherwise(F.col("ages")[0]).alias("step"))


def run_off_violations(df: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Origins that break the staircase: not observed from the first age on without a gap, or off the cohort's diagonal."""
    d = (F.col("dev_lag") / step).cast("bigint")
    per = df.groupBy(*keys, "origin_period").agg(F.count_distinct("dev_lag").alias("n"), F.max(d).alias("k"))
    months = month_number(F.col("origin_period"))
    per = per.withColumns({"n_d": F.max("k").over(Window.partitionBy(*keys)), "diagonal": F.max((months / step).cast("bigint") + F.col("k")).over(Window.partitionBy(*keys))})
    expected = F.least("n_d", F.col("diagonal") - (months / step).cast("bigint"))
    return per.withColumn("expected", expected).where("n <> k or k <> expected").select(*keys, "origin_period", "n", "k", "expected")


def grid_findings(cells: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, reason, n: what keeps a cohort's cells from being one run-off grid.

    ``not_finite`` values, ``unreadable_label`` origins (not the first of a month), ``grain_mismatch`` gaps
    between origins that are no whole number of steps (one more if the smallest is not one step),
    ``not_run_off`` origins (see ``run_off_violations``) and, as ``invalid_table``, evaluation dates of open
    origins beside their latest one.
    """
    months = month_number(F.col("origin_period"))
    values = cells.groupBy(*keys).agg(F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("not_finite"), F.max("dev_lag").alias("oldest"))
    per = cells.groupBy(*keys, "origin_period").agg(F.max("dev_lag").alias("latest_dev"), F.max_by("eval_date", "dev_lag").alias("latest_date"))
    before = F.lag(months).over(Window.partitionBy(*keys).orderBy("origin_period"))
    per = per.join(values, keys).withColumn("gap", months - before)
    open_ = F.col("latest_dev") < F.col("oldest")
    found = per.groupBy(*keys).agg(
        F.max("not_finite").alias("not_finite"),
        F.count_if(F.dayofmonth("origin_period") != 1).alias("unreadable_label"),
        (F.count_if(F.col("gap") % step != 0) + (F.coalesce(F.min("gap"), F.lit(step)) != step).cast("int")).alias("grain_mismatch"),
        F.greatest(F.lit(0), F.count_distinct(F.when(open_, F.col("latest_date"))) - 1).alias("invalid_table"),
    )
    steps = run_off_violations(cells, keys, step).groupBy(*keys).agg(F.count(F.lit(1)).alias("not_run_off"))
    names = ["not_finite", "unreadable_label", "grain_mismatch", "not_run_off", "invalid_table"]
    found = found.join(steps, keys, "left").select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names])
    return found.unpivot(keys, names, "reason", "n").where("n > 0")


def read_triangle_csv(spark: SparkSession, path: str, schema: str, **options) -> Triangle:
    """Strict CSV ingest: a fixed schema, and any row that does not fit it is an error."""
    return Triangle.from_long(spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", dateFormat="yyyy-MM-dd", enforceSchema=False), **options)


def write_triangle(triangle: Triangle, path: str) -> None:
    """Parquet with the meta data beside every column set: a triangle reads back as it was."""
    m = triangle.meta
    note = {"origin_grain": m.origin_grain, "dev_grain": m.dev_grain, "measure": m.measure, "units": m.units}
    triangle.df.withMetadata("value", note).write.mode("overwrite").parquet(path)


def read_triangle(spark: SparkSession, path: str) -> Triangle:
    df = spark.read.parquet(path)
    return Triangle(df, TriangleMeta(**df.schema["value"].metadata))
