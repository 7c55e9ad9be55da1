"""Phrase collocations: count-min sketches first, then exact counts of what the sketches leave.

Pass one adds every n-gram occurrence to a count-min sketch; sketches are linear, so those of all tasks merge by
addition, slice by slice.  A sketch never counts too little, so an n-gram with a light cell in any row is rare
and is left out of pass two, which counts the survivors by their words.  Nothing that is frequent is lost, and
nothing rare is reported: false survivors fall to their exact counts.

The sketch's width follows the corpus (a cell for about ``BYTES_A_CELL`` bytes of text) up to ``SKETCH_BYTES``
for the bitmaps of heavy cells, which every worker holds in pass two.  Beyond that it prunes less and the exact
aggregation does more; results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rundelta.llm.common import discard, file_system, lean, materialize, quoted, ready

BYTES_A_CELL = 8
SKETCH_BYTES = 512 * 1024 * 1024
ROWS = 2
SLICE_BITS = 20
#: Occurrences that a task holds before it adds them up.
HELD = 1 << 21
#: Three words' numbers fit 63 bits; a task forgets its words beyond a quarter of these, which a chunk cannot fill.
WORD_BITS = 21
MOST_WORDS = 1 << (WORD_BITS - 2)
CHUNK = 1 << 20
SALTS, SHARES = 32, 64

MARK = b"."
#: Fixed by the contract: A-Z in lower case, separators of pieces to a mark that is no word, tab to space.
_TABLE = bytes(0x2E if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Odd multipliers, one a word of a phrase and one a row of the sketch.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ROW = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def pieces_of(text: str) -> list[bytes]:
    """Words and marks of a whole text."""
    return text.encode().translate(_TABLE).replace(MARK, b" . ").split(b" ")


class Words(dict):
    """Numbers of (language, word) in order of appearance, from 1; 0 is the mark."""

    def __init__(self):
        super().__init__()
        self.by_lang: dict[str, dict] = {}
        self.names: list[tuple[str, bytes]] = [("", b"")]
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def of(self, lang: str) -> _Lang:
        found = self.by_lang.get(lang)
        if found is None:
            found = self.by_lang[lang] = _Lang(self, lang)
        return found

    def new(self, lang: str, salt: bytes, word: bytes) -> int:
        n = len(self.names)
        self.names.append((lang, word))
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(salt + word) | 1
        return n

    def clear(self) -> None:
        self.__init__()


class _Lang(dict):
    def __init__(self, words: Words, lang: str):
        super().__init__({MARK: 0})
        self.words, self.lang, self.salt = words, lang, lang.encode() + b"\n"

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.words.new(self.lang, self.salt, word)
        return n


def _chunks(langs: list[str], texts: list[str], most: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words and marks, how many leading ones were counted before) of a batch, a megabyte or so each.

    Short texts are joined by marks; a long one is cut between words and its last ``most - 1`` words go along.
    """
    by_lang: dict[str, list[str]] = {}
    for lang, text in zip(langs, texts, strict=True):
        by_lang.setdefault(lang, []).append(text)
    for lang, some in by_lang.items():
        joined, held = [], 0
        for text in some:
            if len(text) > CHUNK:
                yield from ((lang, *part) for part in _cut(text, most))
                continue
            joined.append(text)
            held += len(text)
            if held >= CHUNK:
                yield lang, _words("\n".join(joined)), 0
                joined, held = [], 0
        if joined:
            yield lang, _words("\n".join(joined)), 0


def _words(text: str) -> list[bytes]:
    return [w for w in pieces_of(text) if w]


def _cut(text: str, most: int) -> Iterator[tuple[list[bytes], int]]:
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] not in " \t":
            end += 1
        words = _words(text[at:end])
        yield carried + words, len(carried)
        carried = (carried + words)[1 - most :] if most > 1 else []
        at = end


def _grams(numbers: np.ndarray, seen: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, start positions) of the phrases of up to ``most`` words that end beyond the first ``seen`` words."""
    whole = numbers > 0
    for size in range(1, most + 1):
        if len(numbers) < size:
            return
        ok = whole[: len(numbers) - size + 1].copy()
        for i in range(1, size):
            ok &= whole[i : len(numbers) - size + 1 + i]
        ok[: max(0, seen - size + 1)] = False
        yield size, np.flatnonzero(ok)


def _hash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64 bits of each phrase, by its words' hashes in order."""
    out = hashes[at] * _MIX[0]
    for i in range(1, size):
        out ^= out >> np.uint64(31)
        out = (out + hashes[at + i]) * _MIX[i]
    out ^= out >> np.uint64(29)
    return out


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = hashes * _ROW[row]
    mixed ^= mixed >> np.uint64(32)
    return (mixed * _MIX[row]) >> np.uint64(64 - bits)


SKETCH = "row int, slice long, cells binary"


def _sketcher(bits: int, most: int):
    """Batches of (lang, text) to slices of local sketches: the cells that are not zero and their counts."""
    words = Words()
    slice_bits = min(bits, SLICE_BITS)

    def flush(held):
        hashes = np.concatenate(held)
        pack = zstandard.ZstdCompressor(level=1).compress
        for row in range(ROWS):
            cells, counts = np.unique(_cells(hashes, row, bits), return_counts=True)
            parts = cells >> np.uint64(slice_bits)
            starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            rows = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True):
                low = (cells[lo:hi] & np.uint64((1 << slice_bits) - 1)).astype(np.int64)
                gaps = np.diff(low, prepend=0).astype("<u4")
                rows.append((int(parts[lo]), pack(gaps.tobytes() + counts[lo:hi].astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["row", "slice", "cells"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for lang, some, seen in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), most):
                numbers = np.fromiter(map(words.of(lang).__getitem__, some), np.int64, len(some))
                hashes = words.hashes[numbers]
                for size, at in _grams(numbers, seen, most):
                    held.append(_hash(hashes, at, size))
                    n += len(at)
                if len(words.names) > MOST_WORDS:
                    words.clear()
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return lean(run, words)


def _merger(bits: int, least: int):
    """Slices of local sketches, those of one slice in a row, to bitmaps of the cells that reach ``least``."""
    width = 1 << min(bits, SLICE_BITS)

    def close(key, counts) -> pa.RecordBatch:
        heavy = np.packbits(counts >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([heavy], pa.binary())], ["row", "slice", "cells"])

    def run(batches):
        key = counts = None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row, part, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (row, part) != key:
                    if key is not None:
                        yield close(key, counts)
                    key, counts = (row, part), np.zeros(width, dtype=np.uint64)
                data = np.frombuffer(unpack(cells), dtype="<u4")
                gaps, n = data[: len(data) // 2], data[len(data) // 2 :]
                counts[np.cumsum(gaps, dtype=np.int64)] += n
        if key is not None:
            yield close(key, counts)

    return lean(run)


class Heavy:
    """The merged sketch as bitmaps: which cells of each row reach the least count."""

    def __init__(self, path: str, bits: int):
        self.bits = bits
        self.maps = np.zeros((ROWS, (1 << bits) // 8), dtype=np.uint8)
        fs, place = file_system(path)
        each = (1 << min(bits, SLICE_BITS)) // 8
        for info in fs.get_file_info(pafs.FileSelector(place)):
            if info.base_name.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(batch_size=16):
                        for row, part, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                            self.maps[row, part * each : (part + 1) * each] = np.frombuffer(cells, dtype=np.uint8)

    def may_reach(self, hashes: np.ndarray) -> np.ndarray:
        """False only for phrases that are rarer than the least count."""
        alive = np.ones(len(hashes), dtype=bool)
        for row in range(ROWS):
            cells = _cells(hashes, row, self.bits)
            alive &= (self.maps[row][(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return alive


_HEAVY: dict[str, Heavy] = {}

COUNTS = "lang string, size int, phrase string, f long"


def _counter(path: str, bits: int, most: int):
    """Batches of (lang, text) to exact counts of the phrases that the sketch leaves; size 0 counts all words."""
    words = Words()

    def rows(out) -> pa.RecordBatch:
        langs, sizes, phrases, counts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "size", "phrase", "f"])

    def flush(held):
        names, low = words.names, (1 << WORD_BITS) - 1
        for size, keys in held.items():
            if keys:
                found, counts = np.unique(np.concatenate(keys), return_counts=True)
                for lo in range(0, len(found), 50_000):
                    some, out = found[lo : lo + 50_000], []
                    numbers = [(some >> (WORD_BITS * i) & low).tolist() for i in range(size)]
                    for phrase, n in zip(zip(*numbers, strict=True), counts[lo : lo + 50_000].tolist(), strict=True):
                        out.append((names[phrase[0]][0], size, b" ".join([names[i][1] for i in phrase]).decode(), n))
                    yield rows(out)
                keys.clear()

    def run(batches):
        _HEAVY.setdefault(path, None)
        if _HEAVY[path] is None:
            _HEAVY.clear()
            _HEAVY[path] = Heavy(path, bits)
        heavy, totals, n = _HEAVY[path], {}, 0
        held = {size: [] for size in range(1, most + 1)}
        for batch in batches:
            for lang, some, seen in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), most):
                numbers = np.fromiter(map(words.of(lang).__getitem__, some), np.int64, len(some))
                hashes = words.hashes[numbers]
                for size, at in _grams(numbers, seen, most):
                    if size == 1:
                        totals[lang] = totals.get(lang, 0) + len(at)
                    at = at[heavy.may_reach(_hash(hashes, at, size))]
                    key = numbers[at]
                    for i in range(1, size):
                        key = key | numbers[at + i] << (WORD_BITS * i)
                    held[size].append(key)
                    n += len(at)
                if n >= HELD or len(words.names) > MOST_WORDS:
                    yield from flush(held)
                    n = 0
                    if len(words.names) > MOST_WORDS:
                        words.clear()
        yield from flush(held)
        if totals:
            yield rows([(lang, 0, "", n) for lang, n in totals.items()])

    return lean(run, words)


def width_bits(n_bytes: int) -> int:
    """Cells of a row of the sketch, as a power of two, for so many bytes of text."""
    most = (SKETCH_BYTES * 8 // ROWS).bit_length() - 1
    return max(16, min(most, (n_bytes // BYTES_A_CELL).bit_length()))


def count_phrases(docs: DataFrame, most: int, least: int, lang_col: str = "lang", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to ``most`` words that occur ``least`` times, exactly, and (lang, 0, "", all words).

    ``most`` is 3 at most: the numbers of a phrase's words are held in 63 bits.  The rows read a written table.
    """
    if not 1 <= most <= 3:
        raise ValueError("phrases of one to three words")
    spark = ready(docs.sparkSession)
    lang, text = quoted([lang_col, text_col])
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), text.cast("string").alias("text")).where("length(text) > 0")
    if bits is None:
        bits = width_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    local = rows.mapInArrow(_sketcher(bits, most), SKETCH)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ROWS << max(0, bits - SLICE_BITS - 3))
    merged = local.repartition(n, "row", "slice").sortWithinPartitions("row", "slice")
    heavy = materialize(merged.mapInArrow(_merger(bits, least), SKETCH), "sketch")
    exact = rows.mapInArrow(_counter(heavy.written_to, bits, most), COUNTS)
    exact = exact.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))
    counts = materialize(exact, "phrase-counts")
    discard(heavy)
    return counts


def score_cuts(counts: DataFrame, least_words: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): each candidate by its lowest-scoring cut, ties to the first.

    A cut's parts occur as often as the phrase at least, so their counts stand in the same table.  A word may be
    a part of a large share of all phrases: single words are salted.
    """
    words = F.split("phrase", " ")
    cuts = counts.where(F.col("size") >= least_words).select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    first, rest = F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ")
    side = F.explode(F.array(F.struct(F.lit(True).alias("left"), first.alias("part"), F.col("k").alias("words")), F.struct(F.lit(False).alias("left"), rest.alias("part"), (F.col("size") - F.col("k")).alias("words"))))
    sides = cuts.select("lang", "phrase", "size", "a", "k", side.alias("s")).select("lang", "phrase", "size", "a", "k", "s.left", "s.part", F.when(F.col("s.words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
    known = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), "f", F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    joined = sides.join(known, ["lang", "part", "salt"])
    both = joined.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # Counts up to 10^15 keep the product within 38 digits.
    score = F.expr("(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def subsumed(counts: DataFrame, least_words: int, share_percent: int) -> DataFrame:
    """(lang, phrase) of candidates inside a longer one that occurs at least that share of their count."""
    longer = counts.where(F.col("size") > least_words).select("lang", F.split("phrase", " ").alias("words"), "size", "f")
    inner = longer.select("lang", "f", "words", F.explode(F.expr(f"flatten(transform(sequence({least_words}, size - 1), m -> transform(sequence(1, size - m + 1), i -> struct(i, m))))")).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("at.i"), F.col("at.m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return counts.where(F.col("size") >= least_words).join(inner, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * share_percent).select("lang", "phrase")


def mine(docs: DataFrame, least_words: int = 2, most_words: int = 3, least: int = 10, share_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Words and pieces are those of the whole lower-cased (A-Z) text.  Null texts are empty, a null language is
    ``und``; repeated rows count each time; an empty table gives no rows; other columns are ignored.  Ties of
    score go to the more frequent phrase, then to the smaller in UTF-8 bytes.
    """
    counts = count_phrases(docs, most_words, least, lang_col, text_col, bits)
    kept = score_cuts(counts, least_words).join(subsumed(counts, least_words, share_percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language's best are among the best of its shares, so no task sorts all its phrases.
    share = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
