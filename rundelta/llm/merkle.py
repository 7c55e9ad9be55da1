"""A Merkle manifest of a dataset: a node store on shared storage, and proofs read from it.

Every row is a leaf; a group's leaves, in order, are hashed in runs of ``FAN`` until one node is left, the
group's root, and the groups' roots are hashed in the same way.  ``H`` is the lower-case hex SHA-256 of its
inputs in a row, digests as hex text.

The store is built in external memory.  Tasks write sorted runs of leaves; the runs are merged by ranges of
(group, order), and a leaf's place in its group is its row in the merged run behind those of earlier runs.
Leaves then stream block by block (``FAN ** STEP`` leaves) into Parquet that is partitioned by level: within a
block each level reads the one below as it is made, one open run a level, and further levels read the store's
last one in the same way.  Proofs come from a merge scan in order of coordinates: a block's path to the root,
then its nodes from the top down, then its leaves, so a task holds one block's inner nodes and one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.llm.common import discard, lean, materialize, partitions_for, quoted, ready, shared_dir
from rundelta.llm.neardup import join_small

FAN = 8
#: Levels that one dealing of a block builds.
STEP = 3
HEX = 64
PATH_LEVEL = 127

NODES = "g string, total long, level int, pos long, last boolean, digest string"


def H(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def height(total: int, fan: int = FAN) -> int:
    """Levels above the leaves."""
    h, nodes = 0, total
    while nodes > 1:
        h, nodes = h + 1, -(-nodes // fan)
    return h


def field(column: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def group_key(column: Column) -> Column:
    """A string that is never null and sorts as the group does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def place(rows: DataFrame) -> DataFrame:
    """Rows of (g, id, name, digest, altered) with ``pos``, their place in g by (id, name, digest), and ``total``, g's rows.

    Null identifiers come first; rows alike in all of these take places in any order.  Returned rows read a
    written table.
    """
    order = ["g", "id", "name", "digest", "tie"]
    runs = materialize(rows.withColumn("tie", F.monotonically_increasing_id()).sortWithinPartitions(*order), "merkle-runs")
    dealt = runs.repartitionByRange(partitions_for(runs), *order).sortWithinPartitions(*order).drop("tie")
    merged = materialize(dealt.withColumn("row", F.monotonically_increasing_id()), "merkle-merged")
    discard(runs)
    part = F.shiftright("row", 33).alias("part")
    held = merged.groupBy("g", part).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(held.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("total")), "merkle-offsets")
    placed = join_small(merged.withColumn("part", F.shiftright("row", 33)), offsets, ["g", "part"], 200)
    placed = placed.select("g", "id", "name", "digest", "altered", (F.col("row") + F.col("shift")).alias("pos"), "total")
    placed.reads = (merged, offsets)
    return placed


class Cascade:
    """Open runs of one block, one a level: a full run becomes a node of the level above."""

    def __init__(self, base: int, top: int, fan: int):
        self.base, self.fan = base, fan
        self.open: list[list[bytes]] = [[] for _ in range(top - base)]
        self.made: list[tuple[int, bytes]] = []

    def add(self, digest: bytes, at: int = 0) -> None:
        if at < len(self.open):
            self.open[at].append(digest)
            if len(self.open[at]) == self.fan:
                self._close(at)

    def _close(self, at: int) -> None:
        node = H(*self.open[at])
        self.open[at].clear()
        self.made.append((self.base + at + 1, node))
        self.add(node, at + 1)

    def end(self) -> None:
        for at, run in enumerate(self.open):
            if run:
                self._close(at)


def _reduce(base: int, fan: int):
    """Nodes of level ``base`` (leaves: 0), in order of (g, pos), to those of the next ``STEP`` levels."""

    def nodes(key, cascade: Cascade) -> pa.RecordBatch:
        g, total, block = key
        at = {level: block * fan ** (base + STEP - level) for level in range(base + 1, base + STEP + 1)}
        last = height(total, fan)
        out = []
        for level, digest in cascade.made:
            out.append({"g": g, "total": total, "level": level, "pos": at[level], "last": level == last, "digest": digest.decode()})
            at[level] += 1
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("g", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("last", pa.bool_()), ("digest", pa.string())]))

    def run(batches):
        key = cascade = None
        for batch in batches:
            for g, total, pos, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                now = (g, total, pos // fan**STEP)
                if now != key:
                    if cascade is not None:
                        cascade.end()
                        yield nodes(key, cascade)
                    key, cascade = now, Cascade(base, min(base + STEP, height(total, fan)), fan)
                cascade.add(digest.encode())
        if cascade is not None:
            cascade.end()
            yield nodes(key, cascade)

    return lean(run)


class Store:
    """A tree a group: ``leaves`` (placed rows) and the Parquet of nodes, partitioned by level."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, tallest: int, fan: int):
        self.leaves, self.nodes, self.tallest, self.fan = leaves, nodes, tallest, fan

    def roots(self) -> DataFrame:
        """(g, digest): a group's last node, or its lone leaf."""
        return self.nodes.where("last").select("g", "digest").unionByName(self.leaves.where("total = 1").select("g", "digest"))


def build(rows: DataFrame, fan: int = FAN) -> Store:
    """The node store of rows (g, id, name, digest, altered); see the module.

    An empty table gives an empty store; a group of one row has no nodes, its leaf is its root.
    """
    leaves = place(rows)
    spark, n = leaves.sparkSession, partitions_for(leaves)
    folder = shared_dir(spark, "merkle-nodes")
    tallest = height(leaves.reads[1].agg(F.max("total")).first()[0] or 0, fan)
    base, level = 0, leaves
    while base == 0 or base < tallest:
        dealt = level.where(F.col("total") > fan**base).select("g", "total", "pos", "digest")
        dealt = dealt.repartition(n, F.col("g"), block_of(base, base, fan)).sortWithinPartitions("g", "pos")
        dealt.mapInArrow(_reduce(base, fan), NODES).write.partitionBy("level").mode("append").option("compression", "zstd").parquet(folder)
        base += STEP
        level = spark.read.schema(NODES).parquet(folder).where(F.col("level") == base)
    return Store(leaves, spark.read.schema(NODES).parquet(folder), tallest, fan)


def block_of(level: int, base: int, fan: int) -> Column:
    """The block, of those rooted ``STEP`` levels above ``base``, that a node's ``pos`` lies in."""
    return F.expr(f"pos div {fan ** (base + STEP - level)}")


Steps = list[tuple[bytes, bytes]]


def pack(steps: Steps) -> bytes:
    """A path as bytes: per step, how many siblings stand before and after, then their digests."""
    return b"".join(bytes([len(before) // HEX, len(after) // HEX]) + before + after for before, after in steps)


def unpack(path: bytes) -> Steps:
    at, out = 0, []
    while at < len(path):
        before, after = path[at] * HEX, path[at + 1] * HEX
        out.append((path[at + 2 : at + 2 + before], path[at + 2 + before : at + 2 + before + after]))
        at += 2 + before + after
    return out


def fold(digest: bytes, steps: Steps) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in steps:
        digest = H(before, digest, after)
    return digest


class _Block:
    """What a merge scan holds of one block: its upper path and its inner nodes by level."""

    def __init__(self, base: int, total: int, fan: int):
        self.base, self.top, self.fan = base, min(base + STEP, height(total, fan)), fan
        self.nodes: dict[int, list[bytes]] = {level: [] for level in range(base + 1, self.top)}
        self.memo: dict[int, tuple[int, Steps]] = {}
        self.upper: Steps = []
        self.subroot = self.root = None

    def above(self, level: int, i: int) -> Steps:
        """Steps from the block's i-th node of a level to the root."""
        if level >= self.top:
            return self.upper
        known = self.memo.get(level)
        if known is None or known[0] != i:
            run, at = divmod(i, self.fan)
            near = self.nodes[level][run * self.fan : (run + 1) * self.fan]
            known = self.memo[level] = (i, [(b"".join(near[:at]), b"".join(near[at + 1 :])), *self.above(level + 1, run)])
        return known[1]

    def proofs(self, run_at: int, run: list[bytes]) -> Iterator[Steps]:
        """Steps for each leaf of a run, the block's ``run_at``-th."""
        above = self.above(self.base + 1, run_at)
        if self.top == self.base:
            yield from (above for _ in run)
            return
        for at in range(len(run)):
            yield [(b"".join(run[:at]), b"".join(run[at + 1 :])), *above]


def _scan(base: int, fan: int, answer: Callable, columns: list[str], schema: pa.Schema):
    """Blocks in order, each path first, nodes from the top down, then leaves: ``answer`` to each leaf's steps."""

    def run(batches):
        key = block = None
        run_at, held, out = None, [], []

        def end_run():
            digests = [r["digest"].encode() for r in held]
            local = run_at % fan ** (STEP - 1)
            for row, steps in zip(held, block.proofs(local, digests), strict=True):
                out.append(answer(row, steps, block))
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["g"], row["block"])
                if now != key:
                    if held:
                        end_run()
                    key, block, run_at = now, None, None
                if row["level"] == PATH_LEVEL:
                    above = row
                    continue
                if block is None:
                    block = _Block(base, row["total"], fan)
                    block.upper, block.subroot, block.root = unpack(above["path"]), above["subroot"], above["root"]
                if row["level"] > base:
                    block.nodes[row["level"]].append(row["digest"].encode())
                    continue
                if run_at != row["pos"] // fan:
                    if held:
                        end_run()
                    run_at = row["pos"] // fan
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], columns)
                out.clear()
        if held:
            end_run()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], columns)

    return lean(run)


def _scanned(store: Store, base: int, paths: DataFrame, answer: Callable, ddl: str) -> DataFrame:
    """``answer`` for every node of level ``base``; ``paths``: (g, block, path, subroot, root) above the blocks."""
    spark, fan = paths.sparkSession, store.fan
    blank = {"digest": "string", "path": "binary", "subroot": "string", "root": "string", "id": "long", "name": "string", "altered": "string", "total": "long", "pos": "long"}

    def shaped(df: DataFrame, level: Column) -> DataFrame:
        have = set(df.columns)
        return df.select("g", "block", level.cast("int").alias("level"), *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in blank.items()])

    inner = store.nodes.where((F.col("level") > base) & (F.col("level") < base + STEP) & ~F.col("last"))
    block = F.expr(f"pos div cast(power({fan}, {base + STEP} - level) as bigint)")
    bottom = store.leaves if base == 0 else store.nodes.where((F.col("level") == base) & ~F.col("last"))
    rows = shaped(paths, F.lit(PATH_LEVEL)).unionByName(shaped(inner.withColumn("block", block), F.col("level"))).unionByName(shaped(bottom.withColumn("block", block_of(base, base, fan)), F.lit(base)))
    dealt = rows.repartition(partitions_for(store.leaves), "g", "block").sortWithinPartitions("g", "block", F.desc("level"), "pos")
    schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in spark.createDataFrame([], ddl).schema])
    return dealt.mapInArrow(_scan(base, fan, answer, schema.names, schema), ddl)


def _path_row(row, steps: Steps, block: _Block):
    return row["g"], row["pos"], pack(steps), block.subroot, block.root


def prove(store: Store, above: DataFrame, answer: Callable, ddl: str) -> DataFrame:
    """``answer(row, steps, block)`` as a row of ``ddl`` for every leaf.

    ``above``: (g, path, subroot, root), a row a group: the packed steps from the group's root to the root of
    all, and both roots.  Scans go from the uppermost blocks down; a scan's paths are the next one's tops.
    """
    tops = above.select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    bases = list(range(0, max(1, store.tallest), STEP))
    paths = tops
    for base in reversed(bases[1:]):
        lower = _scanned(store, base, paths, _path_row, "g string, pos long, path binary, subroot string, root string")
        # A group that ends at or below this level has no node here to carry a path on: its own top serves.
        lower = lower.withColumnRenamed("pos", "block")
        paths = materialize(lower.unionByName(tops.join(lower.select("g").distinct(), "g", "left_anti")), "merkle-paths")
    return _scanned(store, 0, paths, answer, ddl)


def _named(row, steps: Steps, block: _Block):
    return row["name"], pack(steps), block.root, row["digest"]


def whole(groups: Store) -> tuple[Store, DataFrame]:
    """The tree over the groups' roots, in the groups' order, and (g, path, subroot, root) for each group."""
    roots = groups.roots().select(F.lit("").alias("g"), F.lit(None).cast("long").alias("id"), F.col("g").alias("name"), "digest", F.lit(None).cast("string").alias("altered"))
    tree = build(roots, groups.fan)
    root = tree.roots().select(F.lit("").alias("g"), F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    return tree, prove(tree, root, _named, "g string, path binary, root string, subroot string")


def _audited(row, steps: Steps, block: _Block):
    proof = sha256()
    for before, after in steps:
        proof.update(before)
        proof.update(after)
    folded = fold((row["altered"] or row["digest"]).encode(), steps).decode()
    return row["id"], row["digest"], block.subroot, block.root, proof.hexdigest(), folded, folded == block.root


AUDIT = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def tampered_text(id_col: Column, text: Column) -> Column:
    """The text in lower case (A-Z) where 3 divides the CRC-32 of the identifier as text, else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.coalesce(F.crc32(id_col.cast("string")) % 3 == 0, F.lit(False)), F.translate(text, upper, upper.lower())).otherwise(text)


def audit(docs: DataFrame, fields: list[str], group: str, id_col: str = "doc_id", tampered: str | None = None, fan: int = FAN) -> DataFrame:
    """Every row's leaf, the roots above it, its proof's digest, and the root that its data now gives.

    A leaf is H of ``fields`` in that order.  Where a column ``tampered`` is named, the fold starts from the
    leaf with ``fields[-1]`` replaced by that column, so altered rows fail and all others verify.

    Null fields count as ``-``; a null group is the first group; rows with a null identifier come first in
    theirs; rows that repeat an identifier stand in order of their leaves, wholly equal ones in any order (their
    results form the same rows).  A group of one row has its leaf as its root, a table with one group that
    group's root.  An empty table gives no rows; other columns are ignored.
    """
    ready(docs.sparkSession)
    named = dict(zip(docs.columns, quoted(docs.columns), strict=True))
    digest = leaf([named[f] for f in fields])
    altered = F.lit(None).cast("string") if tampered is None else F.nullif(leaf([*[named[f] for f in fields[:-1]], named[tampered]]), digest)
    rows = docs.select(group_key(named[group]).alias("g"), named[id_col].cast("long").alias("id"), F.lit(None).cast("string").alias("name"), digest.alias("digest"), altered.alias("altered"))
    groups = build(rows, fan)
    _, above = whole(groups)
    above = above.select("g", "path", "subroot", "root")
    return prove(groups, materialize(above, "merkle-above"), _audited, AUDIT)
