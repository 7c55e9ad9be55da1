"""Exact top-k search by Fagin's threshold algorithm.

Vectors are dealt to blocks.  A block keeps, for every dimension, its rows in order of that
dimension: the sorted lists.  For a query, lists are read from the end that adds most to the score,
some ranks at a time; each row met for the first time is scored by random access.  The score that a
row not yet met can still reach is the query times the values at the depth reached (the threshold).
Reading stops once that is below the k-th best score so far, or below that of the blocks which the
task searched before.  So results are exact, ties included.  Rows are scored when they are met: where one
step meets a quarter of a block, by a product with the whole block, of which later steps read too.  In many even
dimensions every row is met long before the threshold falls; the lists are then read on for the threshold alone.

A task keeps the k best of every query over all its blocks and returns them once, at its end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.llm.common import lean, materialize, ready

BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
#: Results that a task holds before it returns them early, which costs rows only.
HELD = 4_000_000


def quantize(values: list, scale: float = 64.0) -> np.ndarray | None:
    """``floor(scale * x)`` of each component as integers; None for null vectors and null or non-finite components.

    Components beyond 64-bit integers are an error, as their products could not be returned.
    """
    if values is None or any(v is None for v in values):
        return None
    x = np.floor(np.asarray(values, dtype=np.float64) * scale)
    if not np.isfinite(x).all():
        return None
    if (np.abs(x) >= 2.0**62).any():
        raise OverflowError(f"a component beyond 2^62 after scaling by {scale:g}")
    return x.astype(np.int64)


class Block:
    """Rows of integers with their sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, rows = ids[by_id], rows[by_id]
        largest = int(np.abs(rows).max()) if rows.size else 0
        exact = largest * largest * max(1, rows.shape[1]) < 2**52 if largest < 2**31 else False
        self.rows = rows.astype(np.float64) if exact else rows.astype(object)
        self.largest = largest
        #: lists[j]: rows by value of dimension j, largest first; values[j]: these values.
        self.lists = np.argsort(-rows, axis=0, kind="stable").T.copy() if rows.size else np.zeros((rows.shape[1], 0), np.int64)
        self.values = np.take_along_axis(self.rows.T, self.lists, axis=1)

    def top(self, query: np.ndarray, k: int, floor: int | None = None, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Identifiers and scores of the k best rows (ties to smaller identifiers), rows scored and ranks read.

        Rows that cannot reach ``floor`` may be missing; ``skip`` is an identifier that takes no part.  The
        threshold ended the search if fewer ranks were read than there are rows.
        """
        n = len(self.ids)
        if n == 0:
            return self.ids, np.zeros(0, np.int64), 0, 0
        d = min(len(query), self.rows.shape[1])
        wide = int(np.abs(query).max(initial=0)) * self.largest * max(1, d) >= 2**52
        q = np.zeros(self.rows.shape[1], dtype=object if wide or self.rows.dtype == object else np.float64)
        q[:d] = query[:d]
        rows = self.rows.astype(np.int64).astype(object) if q.dtype == object and self.rows.dtype != object else self.rows
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) and not len(down):
            up = np.arange(min(1, len(q)))
        seen, n_seen = np.zeros(n, dtype=bool), 0
        found, scores, product, bound = [], [], None, floor
        depth, first = 0, max(16, n // 64)
        step = first
        while depth < n:
            to = min(n, depth + step)
            if n_seen < n:
                met = np.zeros(n, dtype=bool)
                met[self.lists[up, depth:to]] = True
                met[self.lists[down, n - to : n - depth]] = True
                new = np.flatnonzero(met & ~seen)
                seen[new] = True
                n_seen += len(new)
                if product is None and 4 * len(new) > n and rows.dtype != object:
                    product = rows @ q
                found.append(new)
                scores.append(rows[new] @ q if product is None else product[new])
                if n_seen > k:
                    so_far = np.concatenate(scores)
                    kth = np.partition(so_far, n_seen - k - 1)[n_seen - k - 1]  # one more: ``skip`` may be among them
                    bound = kth if floor is None else max(kth, floor)
            threshold = q[up] @ self.values[up, to - 1] + q[down] @ self.values[down, n - to]
            depth, step = to, step * 2 if n_seen < n else first
            if bound is not None and threshold < bound:
                break
        at, s = np.concatenate(found), np.concatenate(scores)
        if skip is not None:
            other = self.ids[at] != skip
            at, s = at[other], s[other]
        best = np.lexsort((self.ids[at], -s))[:k] if s.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-s[i], self.ids[at[i]]))[:k], dtype=np.int64)
        return self.ids[at[best]], np.array([int(x) for x in s[best]], dtype=np.int64), n_seen, depth


def _pack(rows_each: int, scale: float):
    def run(batches):
        from pyspark import TaskContext

        part, seq, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def close():
            width = max(map(len, rows))
            m = np.zeros((len(rows), width), dtype="<i8")
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= m.min(initial=0) and m.max(initial=0) <= np.iinfo(t).max)
            m = m.astype(kind)
            return pa.RecordBatch.from_pylist([{"block": part * 100_000 + seq, "width": width, "kind": kind, "ids": np.array(ids, "<i8").tobytes(), "rows": m.tobytes()}])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = quantize(v, scale)
                if i is not None and x is not None:
                    ids.append(i)
                    rows.append(x)
                    if len(ids) == rows_each:
                        yield close()
                        seq, ids, rows = seq + 1, [], []
        if ids:
            yield close()

    return run


def _unpack(ids: bytes, rows: bytes, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(rows, kind).reshape(len(i), width).astype(np.int64)


def _search(k: int):
    def run(batches):
        best: dict[int, tuple] = {}
        held, last, block = 0, None, None

        def results():
            for q_ids, tops in best.values():
                rows = [(int(q), i, -s) for q, top in zip(q_ids, tops, strict=True) for s, i in top]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != last:
                    block, last = Block(*_unpack(r["ids"], r["rows"], r["width"], r["kind"])), r["block"]
                q_ids, q_rows = _unpack(r["q_ids"], r["q_rows"], r["q_width"], r["q_kind"])
                if r["q_block"] not in best:
                    if held and held + k * len(q_ids) > HELD:
                        yield from results()
                        best, held = {}, 0
                    best[r["q_block"]] = (q_ids, [[] for _ in q_ids])
                    held += k * len(q_ids)
                tops = best[r["q_block"]][1]
                for n, (i, q) in enumerate(zip(q_ids, q_rows, strict=True)):
                    floor = -tops[n][k - 1][0] if len(tops[n]) >= k else None
                    ids, scores, _, _ = block.top(q, k, floor, int(i))
                    tops[n] = sorted([*tops[n], *zip((-scores).tolist(), ids.tolist(), strict=True)])[:k]
        yield from results()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows by inner product, itself left out.

    Components count as ``floor(scale * x)``.  Both tables are packed into blocks on shared storage;
    query blocks meet every corpus block once, in lanes; a task holds one block of each, and the results
    of the queries it has met.

    A component beyond 2^62 after scaling raises: its products could not be returned as 64-bit integers.
    Vectors that are null or hold null or non-finite components take no part, as query or candidate, nor do null identifiers; shorter vectors count as padded with zeros; repeated rows are candidates
    each; fewer than k rows give all of them; an empty table gives an empty result.
    """
    spark = ready(vectors.sparkSession)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = "block long, width long, kind string, ids binary, rows binary"
    parts = max(1, math.ceil(vectors.count() / BLOCK_ROWS))
    corpus = materialize(pick(vectors).repartition(parts, "i").mapInArrow(lean(_pack(BLOCK_ROWS, scale)), schema), "topk-corpus")
    asked = materialize(pick(queries).repartition(max(1, math.ceil(parts / 64)), "i").mapInArrow(lean(_pack(QUERY_ROWS, scale)), schema), "topk-queries")
    lanes = max(1, min(parts, 4 * spark.sparkContext.defaultParallelism))
    corpus = corpus.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    # A merge join streams its left side and holds (or spills) the rows of the right one that match: all
    # query blocks come one after the other for each block of the corpus.
    pairs = corpus.join(asked.withColumn("lane", F.col("lane").cast("long")).hint("merge"), "lane").drop("lane")
    found = pairs.mapInArrow(lean(_search(k)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
