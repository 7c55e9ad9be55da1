"""Results kept as typed Parquet: what a folder holds is told by its footers, without reading data.

Draws are packed, an array a target.  Kind, version and keys stand in the metadata of the first column, which Spark
writes to the footer of every file and reads back with the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rundelta.errors import Refusal, require_none

VERSION = 1
#: Kinds and the columns, beside the keys, that they have at least.
KINDS = {
    "draws": {"first_draw": "bigint", "n": "int", "values": "array<double>"},
    "mack": {"dev_lag": "bigint", "factor": "double", "sigma2": "double"},
    "panel": {"model": "string", "score": "double"},
    "points": {"latest": "double", "ultimate": "double"},
}
QUANTILES = (0.05, 0.5, 0.95)


def pack_draws(draws: DataFrame, keys: list[str], draw: str = "draw", value: str = "value") -> DataFrame:
    """keys, first_draw, n, values: a target's draws in order.  Draws that are not one run, or not as many for every target, raise."""
    packed = draws.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(draw).cast("bigint").alias("d"), F.col(value).cast("double").alias("v")))).alias("x"))
    packed = packed.select(*keys, F.transform("x", lambda r: r["v"]).alias("values"), F.transform("x", lambda r: r["d"]).alias("at"), F.size("x").alias("n"))
    whole = packed.select(*keys, "n", "values", F.col("at")[0].alias("first_draw"), ((F.element_at("at", -1) - F.col("at")[0] + 1 == F.col("n")) & (F.size(F.array_distinct("at")) == F.col("n"))).alias("run"))
    require_none(whole.where("not run").select(*keys, "n", F.lit("missing_draws").alias("reason")))
    counts = whole.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    if counts["least"] != counts["most"]:
        raise Refusal("missing_draws", f"targets have from {counts['least']} to {counts['most']} draws")
    return whole.select(*keys, "first_draw", "n", "values")


def unpack_draws(packed: DataFrame, keys: list[str]) -> DataFrame:
    rows = packed.select(*keys, "first_draw", F.posexplode("values").alias("i", "value"))
    return rows.select(*keys, (F.col("first_draw") + F.col("i")).alias("draw"), "value")


def save(df: DataFrame, path: str, kind: str, keys: list[str]) -> str:
    """Write a frame as an artifact.  Columns that the kind needs and the frame lacks, or has with another type, are refused."""
    if kind not in KINDS:
        raise Refusal("invalid_option", f"kind {kind!r}; there are {sorted(KINDS)}", "kind")
    types = dict(df.dtypes)
    wrong = {c: types.get(c) for c, t in KINDS[kind].items() if types.get(c) != t} | {k: None for k in keys if k not in types}
    if wrong or not keys:
        raise Refusal("invalid_table", f"a {kind} artifact has {KINDS[kind]} and keys; found {wrong}")
    ordered = [*keys, *[c for c in df.columns if c not in keys]]
    note = {"artifact_kind": kind, "artifact_version": VERSION, "artifact_keys": list(keys)}
    df.select(F.col(f"`{ordered[0]}`").alias(ordered[0], metadata=note), *[F.col(f"`{c}`") for c in ordered[1:]]).write.parquet(path)
    return path


def _noted(schema: T.StructType, path: str) -> dict:
    notes = schema[0].metadata if len(schema) else {}
    if "artifact_kind" not in notes:
        raise Refusal("invalid_table", f"{path} is no artifact")
    if notes["artifact_version"] > VERSION:
        raise Refusal("not_supported", f"{path} is of version {notes['artifact_version']}; this library reads up to {VERSION}")
    return notes


def peek_kind(spark: SparkSession, path: str) -> tuple[str, int, list[str]]:
    """(kind, version, keys) from a footer."""
    notes = _noted(spark.read.parquet(path).schema, path)
    return notes["artifact_kind"], int(notes["artifact_version"]), list(notes["artifact_keys"])


def load(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, list[str]]:
    """The frame and its keys; another kind than the one asked for is refused."""
    found, _, keys = peek_kind(spark, path)
    if kind is not None and kind != found:
        raise Refusal("invalid_table", f"{path} holds {found}, not {kind}")
    return spark.read.parquet(path), keys


def _quantile(values: Column, p: float) -> Column:
    """The type-7 quantile of a sorted array."""
    at = (F.size(values) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    return F.get(values, low) + (at - low) * (F.coalesce(F.get(values, low + 1), F.get(values, low)) - F.get(values, low))


def digest(packed: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """keys, n, mean, least, most and quantiles (``q05``, ...) of packed draws, row by row: no shuffle.  Unknown draws are left out."""
    known = F.array_sort(F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = packed.select(*keys, known.alias("x"))
    mean = F.try_divide(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), F.size("x"))
    return rows.select(*keys, F.size("x").alias("n"), mean.alias("mean"), F.array_min("x").alias("least"), F.array_max("x").alias("most"), *[_quantile(F.col("x"), p).alias(f"q{round(100 * p):02d}") for p in quantiles])
