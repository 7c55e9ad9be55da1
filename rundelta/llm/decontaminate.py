"""Benchmark decontamination by latent semantic retrieval.

1. *Space.*  Benchmark passages are TF-IDF vectors over the benchmark's own words; document
   frequencies are counted over all documents.  A randomised SVD finds the ``rank`` leading right
   singular vectors: the passages are multiplied with random vectors in partitions, partial products
   are summed by blocks of terms, and power iterations sharpen the result.
2. *Candidates.*  A document is a row of overlapping windows of words.  Windows are projected with
   the benchmark's words and compared by cosine with every item; words outside the benchmark count in
   a window's length, so unrelated text scores low.  Long items are compared in pieces, each leading to
   the check of the whole item, and short ones with windows of their size.  The space holds only a share of an item's length,
   less in larger benchmarks, so cosines are given in units of that share.  Most windows are settled by
   a bound: the sum of the most that each of their words adds to any piece.  Beside it, an index of the
   items' word triples finds places that hold as many of an item's triples as a copy must.
3. *Checks.*  Around each candidate window the longest common subsequence of words with the item is
   computed (bit-parallel).  ``copied`` of the item's words in order are a copy; ``paraphrased`` are
   enough if the item's answer is there as well: three quarters of the words of its ``answer`` text, in
   order, if the table has one, else a third of the item's rarest words (a quarter of its words, six at
   least), and three of them at least, so a cut copy is found by whichever end is left.

All items share one space.  The catalogue of items is held whole by the driver and by each worker, as
are ``rank`` numbers for each word of its vocabulary; documents meet it batch by batch.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.llm.common import filtered, lean, ready

#: Halves of windows in words; a piece of an item is compared with the widest windows of which it fills more than one half.
HALVES = (12, 6, 3)
#: Items of more words are cut into equal pieces.
PIECE_WORDS = 64
#: Least number of rare words that stand for an answer.
ANSWER_WORDS = 6
#: Pieces of items that a chunk of windows is compared with at once, which bounds memory only.
PIECES_AT_ONCE = 4096
#: What cosines may lose to single precision when they are compared with their bound.
ROUNDING = 1e-3
GRAM = 3
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
TERM_BLOCK = 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def lcs_length(item: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the item's bits at a time."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in other:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _partial_products(terms: dict[bytes, int], weights: np.ndarray, probe: np.ndarray):
    """For partitions of passages: sum over passages a of a (a . probe), by blocks of terms."""

    def run(batches):
        total = np.zeros((len(terms), probe.shape[1]), dtype=np.float64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids, n = np.unique(np.array([terms[w] for w in words_of(t) if w in terms], dtype=np.int64), return_counts=True)
                if len(ids):
                    a = n * weights[ids]
                    a = a / np.sqrt((a * a).sum())
                    total[ids] += a[:, None] * (a @ probe[ids])
        for lo in range(0, len(terms), TERM_BLOCK):
            yield pa.RecordBatch.from_pylist([{"block": lo // TERM_BLOCK, "sums": total[lo : lo + TERM_BLOCK].tobytes()}])

    return run


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["sums"])
            sums[r["block"]] = sums[r["block"]] + x if r["block"] in sums else x
    for k, x in sums.items():
        yield pa.RecordBatch.from_pylist([{"block": k, "sums": x.tobytes()}])


def randomized_svd(passages: DataFrame, terms: dict[bytes, int], weights: np.ndarray, rank: int = 128, spare: int = 16, powers: int = 3, seed: int = 11) -> np.ndarray:
    """Orthonormal leading right singular vectors (terms x rank) of the unit TF-IDF rows of ``passages`` (one text column)."""
    width = min(rank + spare, len(terms))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), width)))[0]
    for _ in range(powers):
        parts = passages.mapInArrow(lean(_partial_products(terms, weights, q)), "block long, sums binary").repartition(8, "block")
        y = np.zeros_like(q)
        for r in parts.mapInArrow(_summed, "block long, sums binary").collect():
            y[r["block"] * TERM_BLOCK : (r["block"] + 1) * TERM_BLOCK] += np.frombuffer(bytes(r["sums"])).reshape(-1, width)
        q, s, _ = np.linalg.svd(y, full_matrices=False)
        q = q[:, s > 1e-9 * max(s.max(initial=0), 1e-300)]
        width = q.shape[1]
    return q[:, :rank]


def _gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    many, words = max(0, len(ids) - n + 1), (ids + 1).astype(np.uint64)
    keys = words[:many] * _PLACE[0]
    for j in range(1, n):
        keys += words[j : many + j] * _PLACE[j]
    return keys * _PLACE[0]


@dataclass(frozen=True)
class Grams:
    """Items by their runs of ``n`` words: ``items[first[k]:first[k + 1]]`` hold the run of hash ``keys[k]``."""

    n: int
    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray
    near: np.ndarray
    shift: np.uint64

    @staticmethod
    def of(items: dict[int, list[int]], n: int) -> Grams:
        parts = [_gram_keys(np.array(w, dtype=np.int64), n) for w in items.values()]
        keys = np.concatenate(parts)
        owners = np.repeat(np.fromiter(items, dtype=np.int64, count=len(items)), [len(x) for x in parts])
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        bits = max(10, (16 * len(keys)).bit_length())
        near = np.zeros(1 << bits, dtype=bool)
        near[keys >> np.uint64(64 - bits)] = True
        return Grams(n, keys, np.append(first, len(owners)), owners[order], near, np.uint64(64 - bits))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position in the text) of every run of a text that an item has, sorted."""
        keys = _gram_keys(ids, self.n)
        at = np.flatnonzero(self.near[keys >> self.shift])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[k] == keys[at]
        at, k = at[same], k[same]
        many = self.first[k + 1] - self.first[k]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, at = self.items[np.repeat(self.first[k], many) + inner], np.repeat(at, many)
        order = np.lexsort((at, item))
        return item[order], at[order]


@dataclass(frozen=True)
class Scale:
    """Pieces of items (columns of ``vectors``) that are compared with windows of two halves; ``owners`` are their items.

    ``most`` is, for each row of the table, its largest product with a piece, 0 at least.
    """

    half: int
    vectors: np.ndarray
    owners: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(half: int, vectors: np.ndarray, owners: np.ndarray, table: np.ndarray) -> Scale:
        most = np.zeros(len(table))
        for lo in range(0, len(table), PIECES_AT_ONCE):
            for p in range(0, len(owners), PIECES_AT_ONCE):
                top = (table[lo : lo + PIECES_AT_ONCE] @ vectors[:, p : p + PIECES_AT_ONCE]).max(axis=1)
                most[lo : lo + PIECES_AT_ONCE] = np.maximum(most[lo : lo + PIECES_AT_ONCE], top)
        return Scale(half, vectors, owners, most)


@dataclass(frozen=True)
class Benchmark:
    """Items in the latent space; ``table`` has a row per term and a last row of zeros for other words."""

    terms: dict[bytes, int]
    item_ids: list[int]
    item_words: list[list[int]]
    answers: list[list[int]]
    needs: list[int]
    table: np.ndarray
    squares: np.ndarray
    scales: list[Scale]
    grams: list[Grams]
    item_counts: list[list[tuple[int, int]]]
    item_sets: list[frozenset[int]]
    item_sizes: np.ndarray

    def check(self, words: list[bytes], floor: float, copied: float, paraphrased: float) -> dict[int, tuple[float, float]]:
        """Items found in a text: item to (share of its words in order, cosine)."""
        if not words or not self.item_ids:
            return {}
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        found: dict[int, tuple[float, float]] = {}
        place, around = None, {}

        def judge(i: int, lo: int, hi: int, cosine: float) -> None:
            nonlocal place, around
            wanted = self.item_words[i]
            # Items judged at one place share the words around it, out to the next power of two of their lengths.
            if place != (lo, hi):
                place, around = (lo, hi), {}
            reach = 1 << (len(wanted) - 1).bit_length()
            if (near := around.get(reach)) is None:
                near = around[reach] = frozenset(ids[max(0, lo - reach) : hi + reach].tolist())
            most = (len(wanted) - len(self.item_sets[i] - near)) / len(wanted)
            if most < copied and (most < paraphrased or not self._answerable(i, near)):
                return
            region = ids[max(0, lo - len(wanted)) : hi + len(wanted)].tolist()
            # No subsequence is longer than what item and region share in any order.
            there = Counter(region)
            most = sum(n if n < (k := there.get(w, 0)) else k for w, n in self.item_counts[i]) / len(wanted)
            if most < copied and (most < paraphrased or not self._answerable(i, there)):
                return
            share = lcs_length(wanted, region) / len(wanted)
            if share >= copied or share >= paraphrased and self._answered(i, region):
                best = found.get(i)
                if best is None or (share, cosine) > best:
                    found[i] = (share, cosine)

        for scale in self.scales:
            for (i, at), cosine in self._alike(ids, scale, floor):
                judge(i, at, at + 2 * scale.half, cosine)
        for i, at in self._copies(ids, copied):
            if found.get(i, (0.0,))[0] < 1.0:
                judge(i, at, at + len(self.item_words[i]), 0.0)
        return found

    def _alike(self, ids: np.ndarray, scale: Scale, floor: float):
        """((item, start), cosine) of windows that are like a piece of the item."""
        starts = np.arange(0, len(ids), scale.half)
        for lo in range(0, len(starts), 2048):
            # One half more than is judged here: windows of two halves overlap the next chunk.
            part = starts[lo : lo + 2049]
            chunk = ids[part[0] : part[-1] + scale.half]
            begin = part - part[0]
            lengths, most = np.add.reduceat(self.squares[chunk], begin), np.add.reduceat(scale.most[chunk], begin)
            if len(part) > 1:
                lengths, most = lengths[:-1] + lengths[1:], most[:-1] + most[1:]
            norms = np.sqrt(np.maximum(lengths, 1e-12))
            like = np.flatnonzero(most >= (floor - ROUNDING) * norms)
            if not len(like):
                continue
            norms = norms[like][:, None]
            # Vectors of the halves of these windows only.
            used = np.unique(np.minimum(np.concatenate([like, like + 1]), len(part) - 1))
            sizes = np.diff(begin, append=len(chunk))
            rows = self.table[chunk[np.repeat(np.isin(np.arange(len(part)), used), sizes)]]
            sums = np.add.reduceat(rows, np.cumsum(sizes[used]) - sizes[used], axis=0)
            halves = sums[np.searchsorted(used, like)]
            if len(part) > 1:
                halves = halves + sums[np.searchsorted(used, like + 1)]
            best: dict[tuple[int, int], float] = {}
            for p in range(0, len(scale.owners), PIECES_AT_ONCE):
                cosine = (halves @ scale.vectors[:, p : p + PIECES_AT_ONCE]) / norms
                window, piece = np.nonzero(cosine >= floor)
                for i, at, c in zip(scale.owners[p + piece].tolist(), part[like[window]].tolist(), cosine[window, piece].tolist(), strict=True):
                    best[i, at] = max(c, best.get((i, at), c))
            yield from best.items()

    def _copies(self, ids: np.ndarray, copied: float):
        """(item, position) where as many of an item's runs stand as are left when words are changed up to a share of ``copied``."""
        for grams in self.grams:
            item, at = grams.places(ids)
            if not len(item):
                continue
            sizes = self.item_sizes[item]
            changed = np.floor((1 - copied) * sizes + 1e-9).astype(np.int64)
            least = np.maximum(1, sizes - grams.n + 1 - grams.n * changed)
            last = np.arange(len(item)) + least - 1
            fits = last < len(item)
            item, at, sizes, last, whole, where = item[fits], at[fits], sizes[fits], last[fits], item, at
            near = (whole[last] == item) & (where[last] - at <= 2 * sizes)
            told: dict[int, int] = {}
            for i, a, n in zip(item[near].tolist(), at[near].tolist(), sizes[near].tolist(), strict=True):
                # A place judges a region that reaches an item's length to both sides.
                if i not in told or a - told[i] > n // 2:
                    told[i] = a
                    yield i, a

    def _answerable(self, i: int, there: Counter | frozenset[int]) -> bool:
        return sum(1 for w in self.answers[i] if w in there) >= self.needs[i]

    def _answered(self, i: int, region: list[int]) -> bool:
        return lcs_length(self.answers[i], region) >= self.needs[i]


def _document_counts(terms: set[bytes]):
    def run(batches):
        counts: dict[bytes, int] = {}
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                for w in terms.intersection(words_of(t)):
                    counts[w] = counts.get(w, 0) + 1
        rows = [{"term": b"", "n": n}] + [{"term": w, "n": c} for w, c in counts.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("term", pa.binary()), ("n", pa.int64())]))

    return run


def _rarest(words: list[bytes], weight: dict[bytes, float]) -> list[bytes]:
    """The rarest words of an item in its order: a quarter of it, at least ``ANSWER_WORDS`` (4 of items under twelve words)."""
    first = sorted({w: n for n, w in reversed(list(enumerate(words)))}.values(), key=lambda n: (-weight[words[n]], n))
    return [words[n] for n in sorted(first[: max(ANSWER_WORDS if len(words) >= 12 else 4, len(words) // 4)])]


def prepare(docs: DataFrame, items: list[tuple], rank: int = 128) -> Benchmark:
    """The latent space of the benchmark items: (item_id, text, answer or None)."""
    spark = docs.sparkSession
    kept = [(i, words_of(t), words_of(a)) for i, t, a in items]
    kept = [(i, w, a) for i, w, a in kept if w]
    vocabulary = sorted({w for _, words, answer in kept for w in [*words, *answer]})
    terms = {w: n for n, w in enumerate(vocabulary)}
    counted = docs.select(F.col("text").cast("string")).mapInArrow(lean(_document_counts(set(vocabulary))), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["term"]): r["n"] for r in counted}
    total = df.pop(b"", 0)
    weights = np.array([np.log((total + 1) / (df.get(w, 0) + 1)) + 0.1 for w in vocabulary])
    other = float(np.log(total + 1) + 0.1)
    if not kept:
        return Benchmark({}, [], [], [], [], np.zeros((1, 0), np.float32), np.zeros(1), [], [], [], [], np.zeros(0, np.int64))
    weight = dict(zip(vocabulary, weights.tolist(), strict=True))
    needs = [-(-3 * len(a) // 4) if a else 0 for _, _, a in kept]
    answers = [a or _rarest(w, weight) for _, w, a in kept]
    needs = [n or max(-(-len(a) // 3), min(len(a), 3)) for n, a in zip(needs, answers, strict=True)]
    pieces = [(n, x) for n, (_, w, _) in enumerate(kept) for x in _pieces(w)]
    passages = spark.createDataFrame([(b" ".join(x).decode("utf-8", "replace"),) for _, x in pieces], "text string")
    basis = randomized_svd(passages.repartition(max(1, len(pieces) // 2000)), terms, weights, rank)
    table = np.vstack([weights[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    words = [[terms[x] for x in w] for _, w, _ in kept]
    squares = np.append(weights**2, other**2)
    scales = []
    for half in HALVES:
        some = [(n, x) for n, x in pieces if half == next((h for h in HALVES if len(x) > h), HALVES[-1])]
        if some:
            latent = np.vstack([_in_units_of_itself(table, weights, [terms[w] for w in x]) for _, x in some]).T.astype(np.float32)
            scales.append(Scale.of(half, latent, np.array([n for n, _ in some]), table))
    by_run = {n: {i: w for i, w in enumerate(words) if min(GRAM, len(w)) == n} for n in range(1, GRAM + 1)}
    grams = [Grams.of(some, n) for n, some in by_run.items() if some]
    return Benchmark(terms, [i for i, _, _ in kept], words, [[terms[x] for x in a] for a in answers], needs, table, squares, scales, grams, [list(Counter(w).items()) for w in words], [frozenset(w) for w in words], np.array([len(w) for w in words]))


def _pieces(words: list) -> list[list]:
    n = -(-len(words) // PIECE_WORDS)
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


def _in_units_of_itself(table: np.ndarray, weights: np.ndarray, words: list[int]) -> np.ndarray:
    """An item's vector in the space, scaled so that its product with the item's own unit TF-IDF vector is 1."""
    ids, n = np.unique(words, return_counts=True)
    v = table[ids].astype(np.float64).T @ n
    return v * np.sqrt(((n * weights[ids]) ** 2).sum()) / max(v @ v, 1e-12)


_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64())]))


def _judge(model: Benchmark, floor: float, copied: float, paraphrased: float):
    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                found = model.check(words_of(t), floor, copied, paraphrased)
                hits = sorted((model.item_ids[i], share, cos) for i, (share, cos) in found.items())
                out.append([{"item_id": i, "share": s, "cosine": c} for i, s, c in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _HITS)], ["doc_id", "hits"])

    return run


def _model(docs: DataFrame, benchmark: DataFrame, rank: int) -> Benchmark:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer)
    return prepare(docs, sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0], r[1])), rank)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, floor: float = 0.3, copied: float = 0.75, paraphrased: float = 0.5, rank: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, items (found item identifiers, ascending), best_item, best_share of every row.

    The benchmark is a catalogue and goes to the driver; documents do not.  Null and empty texts are
    clean; items with a null text or identifier or without words are not searched for; repeated rows
    are judged alike and all returned; without items every row is clean; ties for the best item go to
    the smaller one; other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run = _judge(_model(rows, benchmark, rank), floor, copied, paraphrased)
    found = rows.mapInArrow(lean(run), "doc_id long, hits array<struct<item_id: long, share: double, cosine: double>>")
    best = F.array_sort("hits", lambda a, b: F.when(a["share"] > b["share"], -1).when(a["share"] < b["share"], 1).otherwise(F.when(a["item_id"] < b["item_id"], -1).otherwise(1)))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.transform("hits", lambda h: h["item_id"]).alias("items"), F.get(best, F.lit(0)).alias("b")).select("doc_id", "contaminated", "n_items", "items", F.col("b.item_id").alias("best_item"), F.col("b.share").alias("best_share"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, floor: float = 0.3, copied: float = 0.75, paraphrased: float = 0.5, rank: int = 128) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark is found."""
    ready(docs.sparkSession)
    at, model = docs.columns.index("text"), _model(docs, benchmark, rank)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not model.check(words_of(t), floor, copied, paraphrased) for t in batch.column(at).to_pylist()], pa.bool_()))

    return filtered(docs, run)
