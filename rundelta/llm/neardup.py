"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its five-word shingles.  Equal sets are one *node*, whatever the
   number of copies; all later work is on nodes.
2. A node has ``BANDS * ROWS`` MinHash values.  Nodes that agree on a band share a bucket.  With six
   rows and forty bands a pair at similarity 0.85 shares no bucket with probability 6e-9.
3. In every bucket all nodes are first compared with its smallest and its largest node (two stars,
   a linear number of pairs).  Pairs are compared by batches of MinHash values: after each batch, the
   posterior probability that the similarity reaches the threshold (uniform prior, binomial matches)
   is bounded, and the pair is dropped once it is below ``miss``.  What survives is verified on the
   full shingle sets.
4. Verified links give components.  Buckets that still hold several components are compared in full
   across components, in tiles of bounded size, by the same two steps.  Pairs inside a component need
   no comparison, so no link between components is lost and groups of copies cost no quadratic work.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.llm.common import discard, lean, materialize, quoted, ready, settle

WORDS, ROWS, BANDS = 5, 6, 40
BATCH = 24
TILE = 128
#: Members of a star that meet one copy of its centre.
STAR = 512
#: A side of a join is broadcast if its rows are known to take no more than this; else both sides are shuffled.
BROADCAST_BYTES = 24 * 1024 * 1024
#: Stands for a null identifier: after all others.
LAST = (1 << 63) - 1

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = _rng.integers(0, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Hashes of words met before: at most 150,000 words of at most 64 bytes (some 30 MB)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[word] = h
        return h


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(words))
    n = len(h) - k + 1
    s = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        s += h[j : j + n] * _PLACE[j]
    return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(best, ((x[lo : lo + 512, None] ^ _XOR) * _MUL).min(axis=0), out=best)
    return (best ^ (best >> np.uint32(16))).astype(np.uint16)


def band_hashes(sig: np.ndarray) -> list[int]:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        h = _mix(h ^ (rows[:, j] + np.uint64(j << 20)))
    return h.astype(np.int64).tolist()


@lru_cache(maxsize=64)
def least_matches(threshold: float, miss: float, n: int) -> int:
    """The fewest matches of ``n`` at which P(similarity >= threshold) is not below ``miss``.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= matches).
    """
    total, lt, lf = 0.0, math.log(threshold), math.log1p(-threshold)
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * lt + (n + 1 - m) * lf)
        if total >= miss:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """For rows of two arrays of signatures: whether no batch rules the pair out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for lo in range(0, ROWS * BANDS, BATCH):
        matches = matches + (a[alive, lo : lo + BATCH] == b[alive, lo : lo + BATCH]).sum(axis=1)
        ok = matches >= least_matches(threshold, miss, min(lo + BATCH, ROWS * BANDS))
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """``100 * intersection >= percent * union`` of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(batches):
    for batch in batches:
        nodes, sizes, sigs = [], [], []
        for t in batch.column(1).to_pylist():
            s = shingle_set(t)
            sizes.append(len(s))
            nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "ord", "tk", "n_shingles", "node", "sig"])


def _bands(batches):
    for batch in batches:
        sigs = [np.frombuffer(s, np.uint16) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([band_hashes(s) for s in sigs], pa.list_(pa.int64()))], ["node", "buckets"])


def join_small(big: DataFrame, small: DataFrame, on, row_bytes: int, how: str = "inner") -> DataFrame:
    """Join with ``small`` (a written table) by broadcast if its counted rows fit, else by shuffle."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def _pairs_alive(percent: int, miss: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(plausible(a, b, percent / 100, miss)))

    return run


def _tiles_alive(percent: int, miss: float):
    """Groups of two tiles to the pairs in them that have to be verified.

    A pair counts in the first band on which it agrees only, so it is verified once.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                members = row["members"]
                sigs = np.frombuffer(b"".join(m["sig"] for m in members), np.uint16).reshape(len(members), -1)
                comps = np.array([m["comp"] for m in members])
                tiles = np.array([m["tile"] for m in members])
                i, j = np.triu_indices(len(members), 1)
                differ = comps[i] != comps[j]
                if row["left"] != row["right"]:
                    differ &= tiles[i] != tiles[j]
                i, j = i[differ], j[differ]
                keep = [np.zeros(0, dtype=bool)]
                for lo in range(0, len(i), 10_000):
                    a, b = sigs[i[lo : lo + 10_000]], sigs[j[lo : lo + 10_000]]
                    ok = plausible(a, b, percent / 100, miss)
                    agree = (a[ok] == b[ok]).reshape(-1, BANDS, ROWS).all(axis=2)
                    ok[np.flatnonzero(ok)[agree.argmax(axis=1) != members[0]["band"]]] = False
                    keep.append(ok)
                keep = np.concatenate(keep)
                if keep.any():
                    used, at = np.unique(np.concatenate([i[keep], j[keep]]), return_inverse=True)
                    yield pa.RecordBatch.from_pylist([{"bucket": row["bucket"], "left": row["left"], "right": row["right"], "nodes": [members[u]["node"] for u in used], "i": at[: keep.sum()].tolist(), "j": at[keep.sum() :].tolist()}], schema=_BLOCKS)

    return run


_BLOCKS = pa.schema([("bucket", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("nodes", pa.list_(pa.binary())), ("i", pa.list_(pa.int32())), ("j", pa.list_(pa.int32()))])


def _exact_blocks(percent: int):
    """Rows in order of blocks, each block's pairs first, then its texts one by one: the links that join its members.

    A task holds the shingle sets of one block, not its texts; pairs already joined in it need no look.
    """

    def links(block, sets):
        nodes, left, right = block
        root = list(range(len(nodes)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(left, right, strict=True):
            if i in sets and j in sets and find(i) != find(j) and is_link(sets[i], sets[j], percent):
                root[find(i)] = find(j)
                out.append({"a": min(nodes[i], nodes[j]), "b": max(nodes[i], nodes[j])})
        return pa.RecordBatch.from_pylist(out, schema=_LINKS)

    def run(batches):
        block, sets = None, {}
        for batch in batches:
            for pos, text, nodes, i, j in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if pos < 0:
                    if block is not None:
                        yield links(block, sets)
                    block, sets = (nodes, i, j), {}
                else:
                    sets[pos] = shingle_set(text)
        if block is not None:
            yield links(block, sets)

    return run


def _exact_stars(percent: int):
    """Rows in order of stars, each star's centre first: the members that are linked with it."""

    def run(batches):
        star, held = None, None
        for batch in batches:
            found = []
            for centre, salt, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = shingle_set(text)
                if (centre, salt) != star:
                    if node != centre:
                        raise ValueError("a star without its centre's text")
                    star, held = (centre, salt), s
                elif is_link(held, s, percent):
                    found.append({"a": min(centre, node), "b": max(centre, node)})
            yield pa.RecordBatch.from_pylist(found, schema=_LINKS)

    return run


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, once each, from a row of its smallest identifier.

    Rows that repeat a node's identifier and text are many at most where identifiers repeat or are null.
    """
    need = materialize(wanted.distinct().join(nodes.select("node", F.col("label.ord").alias("ord"), "tk"), "node"), "neardup-need")
    return join_small(docs, need, ["ord", "tk"], 72).groupBy("node").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among pairs (centre, node) whose full sets reach the threshold.

    The members of a star meet its centre's text in parts of about ``STAR`` members, so a text travels
    once for each part that it is the centre of and once for each pair that it is a member of.
    """
    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    members = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("node"))
    rows = members.union(centres)
    named = rows.join(_texts(rows.select("node"), nodes, docs), "node").select("centre", "part", "node", "text")
    dealt = named.repartition("centre", "part").sortWithinPartitions("centre", "part", (F.col("node") != F.col("centre")), "node")
    return materialize(dealt.mapInArrow(lean(_exact_stars(percent), _HASHES), "a binary, b binary").distinct(), "neardup-links")


def verify_blocks(blocks: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links in blocks of at most two tiles of nodes: a block's texts pass through one task, pairs are never rows."""
    key = ["bucket", "left", "right"]
    members = blocks.select(*key, F.posexplode("nodes").alias("pos", "node"))
    texts = members.join(_texts(members.select("node"), nodes, docs), "node").select(*key, "pos", "text")
    heads = blocks.select(*key, F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("text"), "nodes", "i", "j")
    rows = heads.unionByName(texts, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "pos")
    found = rows.select("pos", "text", "nodes", "i", "j").mapInArrow(lean(_exact_blocks(percent), _HASHES), "a binary, b binary")
    return materialize(found.distinct(), "neardup-links")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp for every node with a link: the smallest label that it reaches.

    Every node points to the smallest label known to it.  In a round it takes the least of the label
    that its pointer points to, and of those of its neighbours; the node pointed to before takes it as
    well.  So trees of pointers halve in height and hook onto each other, and rounds grow with the
    logarithm of a chain's length.  A round is written to shared storage, the one before is deleted.
    """
    settle(nodes.sparkSession)
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "neardup-edges")
    labels = materialize(both.select(F.col("a").alias("node")).distinct().join(nodes.select("node", F.col("label").alias("comp")), "node"), "neardup-labels")
    while True:
        above = labels.select(F.col("node").alias("up"), F.col("comp").alias("over"))
        jumped = materialize(labels.join(above, labels.comp.node == above.up).select("node", "comp", "over"), "neardup-jumped")
        told = both.join(jumped.select(F.col("node").alias("a"), "over"), "a").groupBy("b").agg(F.min("over").alias("told"))
        heard = jumped.join(told, jumped.node == told.b).select("node", "comp", F.least("over", "told").alias("least"))
        hooks = heard.where("least < comp").select(F.explode(F.array("node", "comp.node")).alias("hook"), "least").groupBy("hook").agg(F.min("least").alias("least"))
        new = labels.join(hooks, labels.node == hooks.hook, "left").select("node", F.least("comp", "least").alias("comp"), F.coalesce(F.col("least") < F.col("comp"), F.lit(False)).alias("moved"))
        new = materialize(new, "neardup-labels")
        moved = new.where("moved").limit(1).count()
        discard(labels, jumped)
        labels = new
        if not moved:
            discard(both)
            return labels.select("node", "comp")


def _tile_groups(rows: DataFrame) -> DataFrame:
    """Rows (bucket, band, node, comp, sig) of open buckets as groups of two tiles of about ``TILE`` members."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "bucket").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # A member of tile t is in the groups (t, t), (t, j) and (i, t).
    keyed = rows.select("bucket", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), F.struct("node", F.col("comp.node").alias("comp"), "sig", "tile", "band").alias("member"))
    return keyed.groupBy("bucket", "left", "right").agg(F.collect_list("member").alias("members"))


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Two texts are linked if ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest identifier reachable by links, the row's own included, and
    ``kept`` marks the rows that carry it.

    Null and empty texts and texts without words have the empty set, are linked with nothing and
    kept; repeated rows share a node; rows with a null identifier take their group's smallest one and
    are kept only where the group has none; an empty table gives an empty result; other columns are
    ignored.
    """
    out = _judged(docs, percent, miss, id_col, text_col)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("comp.ord") != LAST, F.col("comp.ord"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, percent: int = 85, miss: float = 1e-8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which exactly one stays of every component.

    It is the row of the smallest identifier (null after all others), then of the smallest hash of the
    text, then of the smallest columns.  Rows without words are in no component and all stay.
    """
    judged = _judged(docs, percent, miss, id_col, text_col).where("node is not null")
    alike = judged.groupBy("ord", "tk", "comp").agg(F.count(F.lit(1)).alias("n"))
    first = (F.col("ord") == F.col("comp.ord")) & (F.col("tk") == F.col("comp.tk"))
    gone = materialize(alike.select("ord", "tk", "n", first.cast("int").alias("stay")).where("n > stay").select("ord", "tk", "stay"), "neardup-gone")
    whole = docs.select(F.struct(*quoted(docs.columns)).alias("whole"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(F.col(text_col).cast("string")).alias("tk"))
    out = join_small(whole, gone.select("ord", "tk"), ["ord", "tk"], 24, "left_anti").select("whole.*")
    repeated = gone.where("stay = 1")
    if repeated.limit(1).count():
        one = join_small(whole, repeated, ["ord", "tk"], 24, "left_semi").groupBy("ord", "tk").agg(F.min("whole").alias("whole"))
        out = out.union(one.select("whole.*"))
    return out


def _judged(docs: DataFrame, percent: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ord, tk, n_shingles, node of every row, and comp, the first (ord, tk, node) of its component."""
    settle(ready(docs.sparkSession))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumns({"ord": F.coalesce("doc_id", F.lit(LAST)), "tk": F.xxhash64("text")})
    rows = materialize(docs.mapInArrow(lean(_signatures, _HASHES), "doc_id long, ord long, tk long, n_shingles long, node binary, sig binary"), "neardup-rows")
    full = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("ord", "tk")).alias("first"), F.first("sig").alias("sig"))
    # The node itself is in its label: identifiers may repeat or be null in unlike texts.
    nodes = materialize(full.select("node", F.struct("first.ord", "first.tk", "node").alias("label"), F.col("first.tk").alias("tk"), "sig"), "neardup-nodes")
    bands = nodes.select("node", "sig").mapInArrow(lean(_bands), "node binary, buckets array<long>").select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = materialize(shared, "neardup-buckets")
    met = materialize(join_small(bands, shared, "bucket", 96), "neardup-members")
    stars = met.select(F.explode(F.array("low", "high")).alias("centre"), "node").where("centre != node")
    # A pair of two centres is looked at once.
    stars = stars.groupBy(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).agg(F.min("centre").alias("centre"))
    links = verify(_alive(stars, nodes, percent, miss), nodes, docs, percent)
    comps = components(links, nodes)
    placed = met.select("bucket", "band", "node").join(nodes.select("node", "label", "sig"), "node").join(comps, "node", "left").select("bucket", "band", "node", F.coalesce("comp", "label").alias("comp"), "sig")
    open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 < c1 and n > 2").select("bucket")
    rest = placed.join(open_buckets, "bucket", "left_semi")
    blocks = materialize(_tile_groups(rest).mapInArrow(lean(_tiles_alive(percent, miss)), "bucket long, left int, right int, nodes array<binary>, i array<int>, j array<int>"), "neardup-blocks")
    if blocks.count():
        links = links.union(verify_blocks(blocks, nodes, docs, percent))
        comps = components(links, nodes)
    groups = nodes.select("node", "label").join(comps, "node", "left").select("node", F.coalesce("comp", "label").alias("comp"))
    return rows.drop("sig").join(groups, "node", "left")


def _alive(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """(centre, node) of the pairs (a, b, centre) that the batches of MinHash values do not rule out."""
    sigs = nodes.select("node", "sig")
    named = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "a_sig"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "b_sig"}), "b")
    other = F.when(F.col("centre") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    kept = named.select("centre", other.alias("node"), "a_sig", "b_sig").mapInArrow(lean(_pairs_alive(percent, miss)), "centre binary, node binary")
    return materialize(kept, "neardup-pairs")
