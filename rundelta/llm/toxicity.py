"""Toxicity: a counterfactual-regularised linear classifier over the words of a text.

The model is a logistic regression on the presence of words (ASCII case folded, ASCII punctuation
apart) and of their beginnings (4 to 6 bytes, which meet inflected and compounded forms).  It is
fitted in numpy by proximal AdaGrad on the log loss with an absolute penalty plus ``fairness`` times the squared change of
the logit when the identity terms of a text are swapped for other terms of their group.  So a mention
of a group by itself can carry no weight of its own.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.llm.common import bucket_of, discard, filtered, lean, materialize, ready

#: Identity terms by group: fixed values, in English, German, French and Spanish.
IDENTITY_GROUPS = (
    "women men woman man girls boys girl boy female male frauen männer femmes hommes mujeres hombres",
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "black white asian african european latino arab indian chinese schwarze weiße noirs blancs negros blancos",
    "gay lesbian straight bisexual transgender homosexual heterosexual queer",
    "immigrants immigrant refugees refugee natives foreigners migrants einwanderer immigrés inmigrantes",
    "old young elderly disabled deaf blind",
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words of a whole text; null and empty texts have none."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


BEGINNINGS = (4, 5, 6)


def features_of(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer words behind a byte that tells their length."""
    return words.union(*({bytes([n]) + w[:n] for w in words if len(w) > n} for n in BEGINNINGS))


def identity_terms() -> dict[bytes, list[bytes]]:
    """Each identity term and the other terms of its group."""
    groups = [[t.encode().translate(_FOLD) for t in g.split()] for g in IDENTITY_GROUPS]
    return {t: [x for x in g if x != t] for g in groups for t in g}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    intercept: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        w = self.weights
        tables = {n: {k[1:]: x for k, x in w.items() if k[0] == n} for n in BEGINNINGS}
        out = []
        for t in texts:
            words = words_of(t)
            z = self.intercept + sum(map(w.__getitem__, w.keys() & words))
            for n, table in tables.items():
                z += sum(map(table.__getitem__, table.keys() & {x[:n] for x in words if len(x) > n}))
            out.append(z)
        return np.array(out, dtype=np.float64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))


class PackedBags:
    """Word sets kept as their words joined by spaces; each set exists only while it is looked at."""

    def __init__(self, packed: pa.ChunkedArray):
        self.packed = packed

    def __iter__(self):
        for bag in self.packed:
            yield set(bag.as_py().split())


def fit(bags: Iterable[set[bytes]], labels: np.ndarray, min_count: int = 4, epochs: int = 15, rate: float = 0.3, sparse: float = 1e-4, fairness: float = 1.0, seed: int = 5) -> ToxicityModel:
    """Fit on word sets, which are gone through twice.  Features in fewer than ``min_count`` of them are left out.

    Without any label, or with one kind of label only, the score is the smoothed share of label 1.
    """
    labels = np.asarray(labels, dtype=np.float64)
    prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
    start = float(np.log(prior / (1 - prior)))
    counts: dict[bytes, int] = {}
    for bag in bags:
        for w in features_of(bag):
            counts[w] = counts.get(w, 0) + 1
    kept = sorted((w for w, n in counts.items() if n >= min_count), key=lambda w: (-counts[w], w))
    if not kept or labels.min() == labels.max():
        return ToxicityModel({}, start)
    number, swap = {w: i for i, w in enumerate(kept)}, identity_terms()
    rng = np.random.default_rng(seed)
    rows, other = [], []
    for bag in bags:
        rows.append(np.fromiter(sorted(number[w] for w in features_of(bag) if w in number), dtype=np.int32))
        if swapped := [w for w in sorted(bag) if w in swap]:
            changed = set(bag) - set(swapped) | {swap[w][int(rng.integers(len(swap[w])))] for w in swapped}
            other.append(np.fromiter(sorted(number[w] for w in features_of(changed) if w in number), dtype=np.int32))
        else:
            other.append(None)
    w, b = np.zeros(len(kept)), start
    gw, gb = np.full(len(kept), 1e-8), 1e-8

    def segments(batch):
        return np.concatenate(batch) if batch else np.zeros(0, np.int64), np.repeat(np.arange(len(batch)), [len(x) for x in batch])

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            pick = order[lo : lo + 128]
            at, seg = segments([rows[i] for i in pick])
            z = b + np.bincount(seg, weights=w[at], minlength=len(pick))
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[pick]) / len(pick)
            grad = np.bincount(at, weights=error[seg], minlength=len(w))
            if pairs := [i for i in pick if other[i] is not None]:
                a, sa = segments([rows[i] for i in pairs])
                c, sc = segments([other[i] for i in pairs])
                change = np.bincount(sa, weights=w[a], minlength=len(pairs)) - np.bincount(sc, weights=w[c], minlength=len(pairs))
                pull = 2 * fairness * change / len(pick)
                grad += np.bincount(a, weights=pull[sa], minlength=len(w)) - np.bincount(c, weights=pull[sc], minlength=len(w))
            gw += grad * grad
            pace = rate / np.sqrt(gw + 1e-4)
            w -= pace * grad
            w = np.sign(w) * np.maximum(np.abs(w) - pace * sparse, 0)
            step = error.sum()
            gb += step * step
            b -= 0.1 * rate * step / np.sqrt(gb)
    return ToxicityModel({k: float(x) for k, x in zip(kept, w, strict=True) if abs(x) > 1e-6}, float(b))


def _bags(batches):
    for batch in batches:
        bags = [b" ".join(sorted(words_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["label", "bag"])


def _fit_task(max_bytes: int, settings: dict):
    """Rows (label, bag) in order, as many as ``max_bytes`` hold, to one row: the pickled model."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if size < max_bytes:
                held.append(batch)
                size += batch.nbytes
        table = pa.Table.from_batches(held, pa.schema([("label", pa.int32()), ("bag", pa.binary())]))
        model = fit(PackedBags(table["bag"]), table["label"].to_numpy(), **settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weights, model.intercept))])], ["model"])

    return lean(run)


def fit_on_tables(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_rows: int = 10_000, max_bytes: int = 128 * 1024 * 1024, **settings) -> ToxicityModel:
    """Fit on labelled documents outside the held-out fold ``crc32(doc_id as text) mod folds = held``.

    At most ``max_rows`` labelled identifiers are used, those of smallest hash, and at most twice as many
    documents of them, should identifiers repeat, as far as ``max_bytes`` of word sets go (in order of a hash).
    The sample is fitted in one task; the driver gets the weights only.  Rows with a null identifier, label or a
    label but 0 and 1 are not learned from.
    """
    spark = ready(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and label_id is not null")
    usable = usable.where(bucket_of("label_id", folds) != held).groupBy("label_id").agg(F.max("label").alias("label"))
    picked = materialize(usable.orderBy(F.xxhash64(F.lit(1), "label_id"), "label_id").limit(max_rows), "toxicity-labels")
    # Twelve bytes a row, max_rows of them: a bounded table.
    sample = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "label_id").select("label", "text")
    bags = materialize(sample.mapInArrow(lean(_bags), "label int, bag binary"), "toxicity-bags")
    ordered = bags.orderBy(F.crc32("bag"), "bag").limit(2 * max_rows)
    found = ordered.mapInArrow(_fit_task(max_bytes, settings), "model binary").collect()
    discard(picked, bags)
    if not found:
        return fit([], np.zeros(0), **settings)
    return ToxicityModel(*pickle.loads(found[0]["model"]))


def score(docs: DataFrame, model: ToxicityModel, folds: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score is at least ``threshold``) of every row.

    Null and empty texts get the score of no words; a null identifier is not held out; repeated rows
    are scored alike; the model (words of a bounded sample) travels with the code.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            held_out = [i is not None and zlib.crc32(str(i).encode()) % folds == held for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held_out), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    ready(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at).to_pylist()) < threshold))

    return filtered(docs, run)
