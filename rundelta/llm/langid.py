"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes of the ASCII-folded text, white
space as one mark; n-grams with white space inside are left out), each hashed to a row of a table.
Table and softmax are trained by stochastic gradient descent in numpy.  A temperature fitted on rows
that training did not see calibrates the probabilities; the confidence below which a prediction is
marked ``rejected`` is the least one at which these rows reach the wanted precision.

For prediction, table and softmax fold into one row of class scores per n-gram bucket, and whole
batches of texts are scored by gathers and segment sums.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.llm.common import bucket_of, give_back, lean, ready

BUCKETS = 1 << 16
#: Bytes of a longer text that are scored at once.
SLICE = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def ngram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For n = 2, 3, 4: the bucket of the n-gram at each byte, ``BUCKETS`` where white space is inside."""
    x = data.astype(np.uint32)
    space = data == 32
    out, gram, inside = [], x, np.zeros(len(x), dtype=bool)
    for n in (2, 3, 4):
        if len(gram) < 2:
            break
        if n > 2:
            inside = inside[:-1] | space[n - 2 : len(space) - 1]
        else:
            inside = inside[:-1]
        gram = (gram[:-1] << np.uint32(8)) | x[n - 1 :]
        h = (gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        out.append(np.where(inside, np.uint32(BUCKETS), h >> np.uint32(16)))
    return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each between white space, and where each begins."""
    raw = [b" " + t.encode("utf-8", "surrogatepass").translate(_FOLD) + b" " for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw])


@dataclass(frozen=True)
class LanguageModel:
    """``scores`` has a row of class scores for each bucket and a row of zeros; ``reject`` the least trusted confidence."""

    classes: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def _sums(self, text: str) -> tuple[np.ndarray, int]:
        """Summed scores and number of one text's n-grams, a slice of their first bytes at a time."""
        data, _ = _joined([text])
        total, count = np.zeros(len(self.classes)), 0
        for lo in range(0, len(data), SLICE):
            for grams in ngram_buckets(data[lo : lo + SLICE + 3]):
                mine = grams[:SLICE]
                known = np.bincount(mine[mine != BUCKETS], minlength=BUCKETS)
                total += known @ self.scores[:BUCKETS]
                count += int(known.sum())
        return total, count

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > SLICE:
            total, count = self._sums(texts[0])
            return (total / max(count, 1) + self.bias)[None, :]
        data, begins = _joined(texts)
        total, count = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for grams in ngram_buckets(data):
            ends = np.minimum(begins, len(grams))
            sums = np.vstack([np.zeros((1, len(self.classes))), np.zeros((0, len(self.classes)))])
            at = np.minimum(ends[:-1], max(len(grams) - 1, 0))
            sums = np.add.reduceat(self.scores[grams], at, axis=0).astype(np.float64)
            known = np.add.reduceat((grams != BUCKETS).astype(np.int64), at)
            empty = ends[1:] <= ends[:-1]
            sums[empty], known[empty] = 0, 0
            total += sums
            count += known
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and confidences; ``und`` and 0 for null texts and texts without a letter."""
        names, conf = ["und"] * len(texts), np.zeros(len(texts))
        if not self.classes:
            return names, conf
        asked = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        lo = 0
        while lo < len(asked):
            hi, size = lo, 0
            while hi < len(asked) and (hi == lo or size + len(texts[asked[hi]]) < SLICE):
                size += len(texts[asked[hi]])
                hi += 1
            part = asked[lo:hi]
            p = _softmax(self.logits([texts[i] for i in part]) / self.temperature)
            best = p.argmax(axis=1)
            for i, k, x in zip(part, best, p.max(axis=1), strict=True):
                names[i], conf[i] = self.classes[k], x
            lo = hi
        return names, conf


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    data, _ = _joined([text])
    grams = np.concatenate([g[g != BUCKETS] for g in ngram_buckets(data)] or [np.zeros(0, np.uint32)])
    at, n = np.unique(grams, return_counts=True)
    return at.astype(np.int64), n / max(1, n.sum())


def fit(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 8, rate: float = 0.5, precision: float = 0.995, snippet_words: int = 12, seed: int = 3) -> LanguageModel:
    """Train on whole texts and, so that short texts are met too, on a run of words drawn from each."""
    classes = sorted(set(langs))
    if not classes:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng, n = np.random.default_rng(seed), len(texts)
    bags, y = [], []
    for t, lang in zip(texts, langs, strict=True):
        words = t.split()
        size = int(rng.integers(1, snippet_words + 1))
        start = int(rng.integers(0, max(1, len(words) - size + 1)))
        for x in (t, " ".join(words[start : start + size])):
            bags.append(_bag(x))
            y.append(classes.index(lang))
    y = np.array(y)
    held = np.repeat(rng.permutation(n) < n // 5, 2)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    table = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    soft, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    soft += rng.normal(0, 1 / dim, soft.shape).astype(np.float32)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for lo in range(0, len(train), 32):
            pick = rng.permutation(train)[:32] if lo == 0 and epoch == 0 else train[(np.arange(lo, lo + 32) * 7919 + epoch * 104729) % len(train)]
            at = np.concatenate([bags[i][0] for i in pick])
            w = np.concatenate([bags[i][1] for i in pick]).astype(np.float32)
            seg = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            hidden = np.zeros((len(pick), dim), np.float32)
            np.add.at(hidden, seg, table[at] * w[:, None])
            p = _softmax(hidden @ soft + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ soft.T
            soft -= lr * hidden.T @ p / len(pick) * 8
            bias -= lr * p.mean(axis=0)
            np.subtract.at(table, at, lr * 8 * w[:, None] * back[seg])
    scores = np.vstack([table @ soft, np.zeros((1, len(classes)), np.float32)]).astype(np.float32)
    model = LanguageModel(classes, scores, bias.astype(np.float64), 1.0, 0.0)
    seen = np.flatnonzero(held) if held.any() else train
    z = np.vstack([scores[bags[i][0]].T @ bags[i][1] + bias for i in seen])
    grid = np.exp(np.linspace(-3, 2, 51))
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(seen)), y[seen]], 1e-12)).mean()))
    p = _softmax(z / temperature)
    right, conf = p.argmax(axis=1) == y[seen], p.max(axis=1)
    order = np.argsort(-conf)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    reject = float(conf[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LanguageModel(model.classes, scores, model.bias, temperature, reject)


def fit_on_table(docs: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 4000, max_bytes: int = 64 << 20, **settings) -> LanguageModel:
    """Fit on texts with a language outside the held-out fold ``crc32(doc_id as text) mod folds = held``.

    At most ``max_rows`` rows in all are used, equally many of each language, those of smallest
    identifier hash, and of these as many as ``max_bytes`` bytes of text hold; rows with a null text or
    language and texts of more than a 64th of ``max_bytes`` are not learned from.
    """
    ready(docs.sparkSession)
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    usable = usable.where(F.octet_length("text") <= max_bytes // 64)
    usable = usable.where(bucket_of("doc_id", folds) != held)
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, max_rows // max(1, len(counts)))
    # About ``each`` rows a language by a threshold on the hash: no sort, no language gathered in one task.
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * each / n))) for k, n in counts.items()], F.lit(0.0)) if counts else F.lit(0.0)
    place = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    order = [F.xxhash64(F.lit(2), "doc_id"), F.col("text")]
    sample = usable.where(place < share).select("doc_id", "text", "lang").orderBy(*order).limit(2 * max_rows + 100)
    # A window over these few rows.
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = sample.withColumn("upto", upto).where(F.col("upto") <= max_bytes).collect()
    taken, texts, langs = dict.fromkeys(counts, 0), [], []
    for r in found:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            texts.append(r["text"])
            langs.append(r["lang"])
    model = fit(texts, langs, **settings)
    del found, texts, langs
    give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, over whole texts.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; so is every text where
    nothing could be learned.  A null identifier is not held out.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            names, conf = model.predict(batch.column(1).to_pylist())
            held_out = [i is not None and zlib.crc32(str(i).encode()) % folds == held for i in batch.column(0).to_pylist()]
            rejected = [n == "und" or c < model.reject for n, c in zip(names, conf, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held_out), pa.array(names), pa.array(conf), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
