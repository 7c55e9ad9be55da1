"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. *Targets.*  Sources share the total size by weight; a target stops at ``cap`` times its source's
   size and the excess is shared out again by weight.  The fixed point is a water level: with sources
   in order of cap over weight, a source is capped while its cap is at most its weight times the level
   left for it and all after it.
2. *Draw.*  A row's place in its source is a 60-bit hash of it, so a source is in random order without
   a sort.  A source gives whole passes (``floor(target / size)``) and the rows up to a cut in that
   order.  The cut is found digit by digit: sizes are summed by the next 12 bits of the hash within the
   digit that holds the cut, until few enough rows are left to order them.  No step gathers a source.
3. *Splitting tree.*  The drawn part of a source is a whole number of blocks (runs of hash order, about
   equally many rows each; the block in which the cut falls is two).  From the root, each node parts its block quotas between two children of
   equal room by a multivariate hypergeometric draw: one conditional hypergeometric draw a source, by
   inversion, with the rest going to the other child.  So quotas are kept exactly at every node.  Leaves
   are output shards; a source's blocks, in random order, are dealt to the shards by their quotas.  A row
   is taken as often as its block was dealt.
4. Rows of a shard are put in random order locally (``shuffled``).

All randomness is a hash of the rows, the sources and ``seed``: reruns agree, on any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.llm.common import WORD_PATTERN, materialize, partitions_for, quoted, ready

#: Rows that may be left in the cut's digit for the last, ordered step.
FEW = 4096
#: Bits of the hash, and of it read in one step.
PLACE, STEP = 60, 12
#: Levels of the tree between dealings of its nodes; shares of a source's block copies, each ordered by itself.
SPREAD, SHARES = 7, 1024


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _place(seed: int, key: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of an MD5 digest as a number."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key, F.lit("~")), F.coalesce(F.concat(F.lit("t"), text), F.lit("~")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def _targets(rows: DataFrame, weights: tuple[int, ...], cap: int, n_shards: int) -> DataFrame:
    """A row per source: mix_source, source_size, n_rows, target, passes, need, bits."""
    found = rows.groupBy("mix_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # Windows over the catalogue of sources, not over documents.
    by_name, everything = Window.orderBy(F.col("mix_source").asc_nulls_last()), Window.partitionBy()
    found = found.withColumn("nth", F.row_number().over(by_name) - 1)
    found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    found = found.withColumns({"limit": F.lit(float(cap)) * F.col("source_size"), "total": F.sum("source_size").over(everything).cast("double"), "all_rows": F.sum("n_rows").over(everything)})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    found = found.withColumns({"level": level, "turn": F.row_number().over(order)})
    found = found.withColumn("capped", F.col("limit") <= F.col("weight") * F.col("level"))
    final = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("turn"))).over(everything)
    found = found.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * final))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    found = found.withColumn("passes", F.least(passes, F.lit(cap)))
    need = F.when(F.col("source_size") > 0, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0))
    # 32 blocks a shard in all, so a block is about as many rows in every source, and one row on average at least.
    blocks = F.least(F.col("n_rows").cast("double"), F.ceil(F.col("n_rows") * F.lit(32.0 * n_shards) / F.col("all_rows")))
    bits = F.greatest(F.lit(0), F.floor(F.log2(blocks))).cast("int")
    return found.withColumns({"need": need, "bits": bits}).select("mix_source", "source_size", "n_rows", "target", "passes", "need", "bits", "nth")


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.mix_source").eqNullSafe(F.col(f"{b}.mix_source"))


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """mix_source, cut: rows whose place is at most ``cut`` are taken once more; sources that need none are absent."""
    open_at = sources.where("need > 0").select("mix_source", "need", F.lit(0.0).alias("before"), F.lit(0).cast("long").alias("digit"))
    shift = PLACE
    while True:
        held = rows.alias("r").join(open_at.alias("o"), _same_source("r", "o") & (F.shiftright(F.col("r.place"), shift) == F.col("o.digit")))
        shift -= STEP
        sums = held.groupBy("o.mix_source", "o.need", "o.before", F.shiftright(F.col("r.place"), shift).alias("digit")).agg(F.sum("r.size").alias("sum"), F.count(F.lit(1)).alias("n"))
        run = F.col("before") + F.sum("sum").over(Window.partitionBy("mix_source").orderBy("digit"))
        sums = sums.withColumn("until", run).withColumn("start", F.col("until") - F.col("sum"))
        inside = sums.where("start < need and need <= until")
        open_at = materialize(inside.select("mix_source", "need", F.col("start").alias("before"), "digit", "n"), "mix-cut")
        if shift < STEP or (open_at.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    held = rows.alias("r").join(open_at.alias("o"), _same_source("r", "o") & (F.shiftright(F.col("r.place"), shift) == F.col("o.digit")))
    start = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("mix_source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("o.mix_source", "o.need", "o.before", "o.digit", "r.place", "r.size").withColumn("start", start)
    last = F.max(F.when(F.col("start") + F.col("size") / 2 <= F.col("need"), F.col("place")))
    return held.groupBy("mix_source", "digit").agg(last.alias("last")).select("mix_source", F.coalesce("last", F.shiftleft("digit", shift) - 1).alias("cut"))


def _hypergeometric(pop: str, hits: str, draws: str, u: str) -> str:
    """SQL for the number of hits among ``draws`` of ``pop`` of which ``hits`` count, by inversion at ``u``.

    Weights run over the support within ten deviations of the mean, from its low end, by the ratio of
    neighbouring probabilities.
    """
    mean = f"(cast({draws} as double) * {hits} / greatest({pop}, 1))"
    spread = f"ceil(10 * sqrt({mean} * (1 - cast({hits} as double) / greatest({pop}, 1)) + 1))"
    low = f"greatest(0, {draws} + {hits} - {pop}, cast(floor({mean} - {spread}) as bigint))"
    high = f"least({hits}, {draws}, cast(ceil({mean} + {spread}) as bigint))"
    ratio = f"(cast({hits} - k as double) * ({draws} - k) / ((k + 1) * cast({pop} - {hits} - {draws} + k + 1 as double)))"
    sums = (
        f"aggregate(if(e.hi > e.lo, sequence(e.lo, e.hi - 1), array()), named_struct('w', 1D, 's', array(1D)), "
        f"(c, k) -> named_struct('w', c.w * {ratio}, 's', concat(c.s, array(element_at(c.s, -1) + c.w * {ratio}))), c -> c.s)"
    )
    return (
        f"transform(array(named_struct('lo', {low}, 'hi', {high})), e -> "
        f"transform(array({sums}), s -> e.lo + size(filter(s, x -> x < {u} * element_at(s, -1))))[0])[0]"
    )


def _shards(blocks: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """mix_source, block, shards: the shard of each copy of each block."""
    quotas = blocks.groupBy("mix_source", "nth").agg(F.sum("copies").alias("quota"))
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "quota"))), lambda x: x["quota"]).alias("quotas")).withColumn("node", F.lit(0).cast("long"))
    for depth in range(int(math.log2(n_shards))):
        if depth and depth % SPREAD == 0:
            # So many nodes are work for all tasks.
            nodes = nodes.repartition(1 << min(depth, 2 * SPREAD), "node")
        u = f"(cast(pmod(xxhash64({seed}, {depth}, node, i), 9007199254740992L) as double) / 9007199254740992D)"
        left = (
            "aggregate(if(size(quotas) > 0, sequence(0, size(quotas) - 1), array()), "
            "named_struct('pop', pop, 'draws', pop div 2, 'out', cast(array() as array<bigint>)), "
            f"(a, i) -> transform(array({_hypergeometric('a.pop', 'quotas[i]', 'a.draws', u)}), "
            "h -> named_struct('pop', a.pop - quotas[i], 'draws', a.draws - h, 'out', concat(a.out, array(h))))[0], a -> a.out)"
        )
        nodes = nodes.withColumn("pop", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("lefts", F.expr(left))
        right = F.zip_with("quotas", "lefts", lambda q, x: q - x)
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("lefts").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))).alias("n")).select("n.*")
    dealt = nodes.select(F.col("node").cast("int").alias("shard"), F.posexplode("quotas").alias("nth", "quota")).where("quota > 0")
    upto = F.sum("quota").over(Window.partitionBy("nth").orderBy("shard"))
    dealt = dealt.withColumn("upto", upto).select("nth", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("turn"))
    copies = blocks.where("copies > 0").select("mix_source", "nth", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    # A copy's turn in its source's random order: those of earlier shares, then its row in its own share.
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed + 1), "nth", "block", "copy")).withColumn("share", F.pmod("h", F.lit(SHARES)))
    before = F.sum("n").over(Window.partitionBy("nth").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    counted = copies.groupBy("nth", "share").agg(F.count(F.lit(1)).alias("n")).select("nth", "share", F.coalesce(before, F.lit(0)).alias("before"))
    mine = F.row_number().over(Window.partitionBy("nth", "share").orderBy("h", "block", "copy")) - 1
    placed = copies.withColumn("mine", mine).join(counted, ["nth", "share"]).withColumn("turn", (F.col("before") + F.col("mine")).cast("long")).join(dealt, ["nth", "turn"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"])
    return placed.groupBy("mix_source", "block").agg(ordered.alias("shards"))


def shard_count(df: DataFrame) -> int:
    """A power of two, at least the partitions that the frame's size asks for."""
    return 1 << max(4, math.ceil(math.log2(partitions_for(df))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, n_shards: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies, taken and shards.

    ``copies`` is how often the mix takes a row (0 to ``cap``), ``taken`` that many times its size in
    words, ``shards`` the output shard of each copy.  ``keep`` names the columns to carry (default: all);
    a column of ``docs`` with one of the new names is replaced.

    Null texts have size 0, null is a source of its own and sorts last, rows of a source without any
    word are taken once (no words), equal rows are taken alike, an empty table gives an empty result.
    A source's taken words differ from its target by half of one row's size at most (a row counts
    with its exact repeats).
    """
    ready(docs.sparkSession)
    n_shards = n_shards or shard_count(docs)
    new = {"size", "source_size", "target", "copies", "taken", "shards", "mix_source", "place", "block"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    base = docs.withColumns({"size": _size(F.col(text_col)), "mix_source": F.col(source_col).cast("string"), "place": _place(seed, F.col(id_col).cast("string"), F.col(text_col).cast("string"))})
    rows = materialize(base.select("mix_source", "size", "place"), "mix-rows")
    sources = materialize(_targets(rows, weights, cap, n_shards), "mix-sources")
    cuts = _cuts(rows, sources)
    found = sources.alias("s").join(cuts.alias("c"), _same_source("s", "c"), "left").select("s.*", F.coalesce("c.cut", F.lit(-1)).alias("cut"))
    sources = materialize(found, "mix-sources")
    extra = (F.col("r.place") <= F.col("s.cut")).cast("int")
    block = F.expr(f"shiftright(r.place, {PLACE} - s.bits) * 2") + extra
    blocks = rows.alias("r").join(sources.alias("s"), _same_source("r", "s")).groupBy("s.mix_source", "s.nth", block.alias("block")).agg(F.max(F.col("s.passes") + extra).alias("copies"))
    blocks = materialize(blocks, "mix-blocks")
    shards = materialize(_shards(blocks, n_shards, seed), "mix-shards")
    out = base.select(*quoted(kept), "size", "mix_source", "place").alias("r").join(sources.alias("s"), _same_source("r", "s"))
    out = out.select("r.*", "s.source_size", "s.target", block.alias("block")).alias("r")
    out = out.join(shards.alias("h"), _same_source("r", "h") & (F.col("r.block") == F.col("h.block")), "left")
    placed = F.coalesce("h.shards", F.array().cast("array<int>"))
    return out.select(*[F.col("r.`" + c.replace("`", "``") + "`") for c in kept], "r.size", "r.source_size", "r.target", F.size(placed).alias("copies"), (F.size(placed) * F.col("r.size")).alias("taken"), placed.alias("shards"))


def shuffled(mixed: DataFrame, columns: list[str], n_shards: int, seed: int = 17) -> DataFrame:
    """The taken copies as rows, dealt to their shards and in random order there."""
    rows = mixed.select(*columns, F.posexplode("shards").alias("mix_copy", "mix_shard"))
    return rows.repartition(n_shards, "mix_shard").sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed), "mix_copy", *columns)).select(*columns)
