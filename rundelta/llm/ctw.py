"""Language-model scoring by context-tree weighting over bytes.

What is modelled is the token sequence of a text: its words (ASCII letters folded to lower case) joined
by spaces, and a line feed as the end.  So the model and a word model give probabilities of the same
event.  Every byte is eight binary decisions; a decision's context is the ``DEPTH`` bytes before it and
the bits of the byte so far.  At each depth a node keeps counts of both outcomes and predicts by the
Krichevsky-Trofimov rule; the weight of a node against its children follows from the evidence:
``Pw = (Pe + product of the children's Pw) / 2``.  The mixture ends at the deepest node that training met.

*Learning.*  Tasks count byte strings of ``DEPTH + 1``; the counts are summed and dealt by the three bytes
before the target, so that all nodes from depth three down are built in one task each.  What is above
is finished on the driver while it has at most ``UPPER_NODES`` nodes; else strings are dealt by two
bytes, which leaves it 256 * 255 nodes at most.  Each string that occurs anywhere in the corpus
then gets its log probability, so a text's score is a sum of table entries.

*Word model.*  The base score needs the training count of every word.  Words counted twice or more are
in a table; of the others, one in a training text has count one, and only those of held-out texts have
to be looked up among the words counted once, by a join.

Tables are written to shared storage.  While they have no more than ``TABLE_ROWS`` rows, workers load
them; beyond that, strings and words of each text are joined with them instead.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.llm.common import file_system, lean, materialize, partitions_for, ready, shared_dir

DEPTH = 5
#: Nodes above the depth at which strings are dealt that the driver may finish.
UPPER_NODES = 1_000_000
TABLE_ROWS = 12_000_000
END = 10
LOG10 = float(np.log(10))


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams_of(token_lists: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The packed string at each byte of all texts in a row, and where each text begins.

    A string is packed with the byte just before the target first, then older bytes, the target last.
    """
    pad = b"\n" * depth
    parts = [pad + b" ".join(t) + b"\n" for t in token_lists]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    gram = data[depth:].copy()
    for k in range(1, depth + 1):
        gram |= data[depth - k : len(data) - k] << np.uint64(8 * (depth + 1 - k))
    target = np.ones(len(data), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(depth):
        target[starts + k] = False
    return gram[target[depth:]], np.cumsum(sizes - depth) - (sizes - depth)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for positive arguments (Stirling's series above 8)."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


class Level:
    """Nodes of one depth: sorted keys (context, bits so far), counts, evidence and the share that stops here."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        evidence = log_kt(n0, n1)
        if below is None:
            self.log_pw, self.stop = evidence, np.ones(len(keys))
        else:
            self.log_pw = np.logaddexp(evidence, below) - np.log(2)
            self.stop = 1 / (1 + np.exp(np.clip(below - evidence, -700, 700)))
        self.kt = (n1 + 0.5) / (n0 + n1 + 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys and whether they exist."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def _bits(context: np.ndarray, byte: np.ndarray):
    """For each of the eight decisions: node key and outcome."""
    for k in range(8):
        yield (context << np.uint64(8)) | (np.uint64(1 << k) | (byte >> np.uint64(8 - k))), (byte >> np.uint64(7 - k)) & np.uint64(1)


def _sum_by(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    found, at = np.unique(keys, return_inverse=True)
    return (found, *(np.bincount(at, weights=w, minlength=len(found)) for w in weights))


def build_levels(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """Levels ``depth`` down to ``top`` from counted strings."""
    grams, counts = grams[counts > 0], counts[counts > 0].astype(np.float64)
    levels: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        context, byte = grams >> np.uint64(8 * (depth - d + 1)), grams & np.uint64(255)
        pairs, n = _sum_by((context << np.uint64(8)) | byte, counts)
        nodes = [(k, n * (bit == 0), n * (bit == 1)) for k, bit in _bits(pairs >> np.uint64(8), pairs & np.uint64(255))]
        keys, n0, n1 = _sum_by(*(np.concatenate(x) for x in zip(*nodes, strict=True)))
        below = None
        if d < depth:
            child = levels[d + 1]
            below = np.bincount(np.searchsorted(keys, _parents(child.keys)), weights=child.log_pw, minlength=len(keys))
        levels[d] = Level(keys, n0, n1, below)
    return levels


def log_probabilities(grams: np.ndarray, depth: int, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the mixture probability of each string's target byte."""
    byte, total = grams & np.uint64(255), np.zeros(len(grams))
    for k in range(8):
        p, known = np.full(len(grams), 0.5), np.zeros(len(grams), dtype=bool)
        for d in range(depth, -1, -1):
            context = grams >> np.uint64(8 * (depth - d + 1))
            key = (context << np.uint64(8)) | (np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
            at, there = levels[d].find(key)
            kt, stop = (levels[d].kt[at], levels[d].stop[at]) if len(levels[d].keys) else (p, p)
            p = np.where(there, np.where(known, stop * kt + (1 - stop) * p, kt), p)
            known |= there
        bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
        total += np.log(np.where(bit == 1, p, 1 - p))
    return total / LOG10


class HashTable:
    """Values by unsigned 64-bit key, looked up for whole arrays (open addressing, at most two thirds full)."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float):
        self.default = values.dtype.type(default)
        #: The value of the one key that marks free slots, if it is among the keys.
        self.of_empty = values[keys == self.EMPTY][0] if (keys == self.EMPTY).any() else self.default
        self.shift = 64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        size = 1 << (64 - self.shift)
        self.mask = size - 1
        self.keys, self.values = np.full(size, self.EMPTY), np.full(size, default, dtype=values.dtype)
        for lo in range(0, len(keys), 500_000):
            part = np.arange(lo, min(lo + 500_000, len(keys)))
            left = part[keys[part] != self.EMPTY]
            at = self._home(keys[left])
            while len(left):
                free = self.keys[at] == self.EMPTY
                put, first = np.unique(at[free], return_index=True)
                row = left[free][first]
                self.keys[put], self.values[put] = keys[row], values[row]
                unset = self.keys[at] != keys[left]
                left, at = left[unset], (at[unset] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.default)
        left = np.flatnonzero((found != keys) & (found != self.EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (found != self.EMPTY)
            left, at = left[more], at[more]
        if (keys == self.EMPTY).any():
            out[keys == self.EMPTY] = self.of_empty
        return out


_TABLES: dict = {}


def load_table(folder: str, default: float) -> HashTable:
    """A written table (key long, value double) as a hash table, once per worker."""
    if folder not in _TABLES:
        if len(_TABLES) > 1:  # a worker outlives queries: tables of earlier ones go
            _TABLES.clear()
        fs, path = file_system(folder)
        import pyarrow.fs as pafs

        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet"))
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.float64)]
        for n in names:
            t = pq.read_table(n, filesystem=fs, columns=["key", "value"])
            keys.append(t["key"].to_numpy())
            values.append(t["value"].to_numpy())
        _TABLES[folder] = HashTable(np.concatenate(keys).view(np.uint64), np.concatenate(values), default)
    return _TABLES[folder]


#: Bytes of text that are taken together.
CHUNK_BYTES = 1_500_000


def chunks_of(texts: pa.Array):
    """Ranges of rows with about ``CHUNK_BYTES`` of text each."""
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    lo = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= CHUNK_BYTES or i - lo >= 400:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


class _WordHashes(dict):
    """Hashes of words met before: at most 150,000 words of at most 64 bytes (some 30 MB)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[word] = h
        return h


_WORDS = _WordHashes()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _held(doc_id: int | None, folds: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held


def _learns(doc_id: int | None, folds: int, held: int) -> bool:
    return doc_id is not None and not _held(doc_id, folds, held)


def _counter(folds: int, held: int, depth: int):
    """(kind, key, n): training counts of strings (kind 0; n is 0 for those of other texts only) and of words (kind 1)."""

    def merged(parts):
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, weights=n, minlength=len(found))

    def run(batches):
        _TABLES.clear()
        parts: dict[int, list] = {0: [], 1: []}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in chunks_of(texts):
                tokens = [tokens_of(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                learns = np.array([_learns(i, folds, held) for i in ids[lo:hi]])
                grams, begins = grams_of(tokens, depth)
                weights = np.repeat(learns.astype(np.float64), np.diff(np.append(begins, len(grams))))
                parts[0].append(merged([(grams, weights)]))
                if used := [w for t, ok in zip(tokens, learns, strict=True) if ok for w in t]:
                    hashes = word_hashes(used)
                    parts[1].append(merged([(hashes, np.ones(len(hashes)))]))
            for kind, p in parts.items():
                if len(p) > 1 and sum(len(x[0]) for x in p[1:]) > max(1_000_000, len(p[0][0])):
                    parts[kind] = [merged(p)]
        for kind, p in parts.items():
            if p:
                keys, n = merged(p)
                for lo in range(0, len(keys), 100_000):
                    k = keys[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[lo : lo + 100_000].astype(np.int64))], ["kind", "key", "n"])

    return run


def _gathered(batches) -> tuple[np.ndarray, np.ndarray]:
    keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        n.append(batch.column(1).to_numpy(zero_copy_only=False))
    return np.concatenate(keys).view(np.uint64), np.concatenate(n)


def _parents(keys: np.ndarray) -> np.ndarray:
    """Node keys one depth up: the oldest context byte goes, the bits stay."""
    return (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))


def _upper_sums(depth: int, top: int):
    def run(batches):
        grams, n = _gathered(batches)
        if (n > 0).any():
            level = build_levels(grams, n, depth, top)[top]
            keys, n0, n1, below = _sum_by(_parents(level.keys), level.n0, level.n1, level.log_pw)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n0), pa.array(n1), pa.array(below)], ["node", "n0", "n1", "below"])

    return run


def _string_scores(depth: int, top: int, upper: dict[int, tuple]):
    def run(batches):
        grams, n = _gathered(batches)
        if len(grams):
            none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), None)
            levels = build_levels(grams, n, depth, top) if (n > 0).any() else {d: Level(*none) for d in range(top, depth + 1)}
            levels |= {d: Level(*x) for d, x in upper.items()}
            scores = log_probabilities(grams, depth, levels)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(scores)], ["key", "value"])

    return run


def _written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    folder = shared_dir(df.sparkSession, tag)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.written_to = folder
    return out, folder


def score_texts(docs: DataFrame, folds: int = 5, held: int = 1, depth: int = DEPTH, table_rows: int = TABLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    The model and the word counts are learned from rows outside the fold ``crc32(doc_id as text) mod
    folds = held``; ``score`` is the model's log10 probability of the token sequence, ``bits_per_byte``
    its code length per byte, ``base_score`` that of the add-half word model.

    Null and empty texts are the end alone; rows with a null identifier are scored, not learned from,
    and not held out; repeated rows count each and score alike; without any training row the model
    gives every bit one half and the word model ``log10(0.5 / 0.5)``; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(lean(_counter(folds, held, depth), _WORDS), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "ctw-counts")
    parts = max(partitions_for(rows), 8)
    for top in (min(3, depth), min(2, depth)):
        dealt = counted.where("kind = 0").select("key", "n").repartition(parts, F.shiftrightunsigned("key", 8 * (depth + 1 - top)))
        sums = dealt.mapInArrow(lean(_upper_sums(depth, top)), "node long, n0 double, n1 double, below double").groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
        sums = materialize(sums, "ctw-upper")
        if sums.count() <= UPPER_NODES:
            break
    found = sums.orderBy("node").toArrow()
    level = tuple(found[c].to_numpy() for c in ("node", "n0", "n1", "below"))
    level = (level[0].view(np.uint64), *level[1:])
    upper: dict[int, tuple] = {}
    for d in range(top - 1, -1, -1):
        upper[d] = level
        level = _sum_by(_parents(level[0]), level[1], level[2], Level(*level).log_pw if len(level[0]) else level[3])
    strings, string_folder = _written(dealt.mapInArrow(lean(_string_scores(depth, top, upper)), "key long, value double"), "ctw-strings")
    words = counted.where("kind = 1")
    often, often_folder = _written(words.where("n > 1").select("key", F.col("n").cast("double").alias("value")), "ctw-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    learned = F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held)
    train_docs = rows.select("doc_id").where(learned).count()
    n_all, v = totals["n"] + train_docs, totals["v"] + (1 if train_docs else 0)
    norm = n_all + 0.5 * (v + 1)
    loaded = max(strings.count(), often.count()) <= table_rows
    schema = "doc_id long, text_key long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, left array<struct<key: long, n: long>>, strings array<struct<key: long, n: long>>"
    run = _scorer(folds, held, depth, string_folder if loaded else None, often_folder, norm, train_docs)
    scored = materialize(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(run, _WORDS), schema), "ctw-scored")
    # Words not settled: their count is in the table of words (1 in training rows and words of the table are settled there).
    once = words.select("key", "n") if not loaded else words.where("n = 1").select("key", "n")
    left = scored.select("doc_id", "text_key", F.explode("left").alias("w")).select("doc_id", "text_key", F.col("w.key").alias("key"), F.col("w.n").alias("times")).distinct()
    joined = left.join(once, "key").groupBy("doc_id", "text_key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10((F.col("n") + 0.5) / norm) - F.log10(F.lit(0.5 / norm)))).alias("more_base"))
    joined, same = joined.withColumnsRenamed({"doc_id": "r_id", "text_key": "r_key"}), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key"))
    out = scored.drop("left", "strings").join(joined, same, "left").select("doc_id", "text_key", "held_out", "n_tokens", "n_bytes", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
    if not loaded:
        uses = scored.select("doc_id", "text_key", F.explode("strings").alias("s")).select("doc_id", "text_key", F.col("s.key").alias("key"), F.col("s.n").alias("times")).distinct()
        sums = uses.join(strings, "key").groupBy("doc_id", "text_key").agg(F.sum(F.col("times") * F.col("value")).alias("string_score"))
        sums = sums.withColumnsRenamed({"doc_id": "r_id", "text_key": "r_key"})
        out = out.join(sums, same, "left").select("doc_id", "text_key", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", F.coalesce("string_score", F.lit(0.0)).alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def _scorer(folds: int, held: int, depth: int, string_folder: str | None, often_folder: str, norm: float, train_docs: int):
    def run(batches):
        strings = load_table(string_folder, np.nan) if string_folder else None
        often = load_table(often_folder, 0.0) if string_folder else None
        end_base = float(np.log10((train_docs + 0.5) / norm))
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            out = []
            for lo, hi in chunks_of(texts):
                tokens = [tokens_of(t) for t in texts.slice(lo, hi - lo).to_pylist()]
                grams, begins = grams_of(tokens, depth)
                ends = np.append(begins[1:], len(grams))
                if strings is not None:
                    logs = strings.get(grams)
                    if np.isnan(logs).any():
                        raise ValueError("a string is missing from the table")
                    sums = np.add.reduceat(logs, begins)
                for j, t in enumerate(tokens):
                    i, h = ids[lo + j], word_hashes(t)
                    row = {"doc_id": i, "text_key": keys[lo + j], "held_out": _held(i, folds, held), "n_tokens": len(t) + 1, "n_bytes": int(ends[j] - begins[j]), "known": int(train_docs > 0), "base": end_base, "score": 0.0, "left": [], "strings": []}
                    if strings is not None:
                        c = often.get(h)
                        if _learns(i, folds, held):
                            c = np.maximum(c, 1.0)
                        else:
                            k, n = np.unique(h[c == 0], return_counts=True)
                            row["left"] = [{"key": int(a), "n": int(b)} for a, b in zip(k.view(np.int64), n, strict=True)]
                        row["known"] += int((c > 0).sum())
                        row["base"] += float(np.log10((c + 0.5) / norm).sum())
                        row["score"] = float(sums[j])
                    else:
                        k, n = np.unique(h, return_counts=True)
                        row["left"] = [{"key": int(a), "n": int(b)} for a, b in zip(k.view(np.int64), n, strict=True)]
                        row["base"] += len(t) * float(np.log10(0.5 / norm))
                        k, n = np.unique(grams[begins[j] : ends[j]], return_counts=True)
                        row["strings"] = [{"key": int(a), "n": int(b)} for a, b in zip(k.view(np.int64), n, strict=True)]
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_SCORED)

    return run


_PAIRS = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
_SCORED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("left", _PAIRS), ("strings", _PAIRS)])
