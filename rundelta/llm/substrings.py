"""Exact removal of repeated substrings, by suffix sorting around content-defined anchors.

Every window of ``LENGTH`` bytes has one anchor: the place in it where the hash of ``GRAM`` bytes is
smallest (leftmost).  Equal windows have equal anchors at equal offsets, so

1. an anchor's hash is counted over all distinct texts; windows whose anchor hash occurs at one place
   only cannot repeat;
2. around every other anchor the bytes of its windows are cut out (a *context*), and equal contexts
   collapse to their first occurrence by a partial aggregate;
3. contexts that share an anchor hash but differ are sorted in both directions: the bytes from the
   anchor on, and the bytes before it backwards.  Sorting is deep-shallow: multikey quicksort (three-way
   partitions on eight-byte symbols, all segments of a level at once) to ``SHALLOW`` bytes, then a blind trie orders each group that is still tied; it
   gives the order and the longest common prefixes.  A window at offset ``o`` equals another if they
   lie in one run of both orders, with common prefixes of at least ``LENGTH - o`` and ``o`` bytes; the
   first of each class stays;
4. an anchor hash with more than ``GROUP`` different contexts is parted first: the range of offsets is
   halved, contexts are cut to each half, equal ones collapse, and those that differ in the bytes which
   all windows of the half hold go to different groups.  Halving goes on where a group is still large;
   at a single offset these bytes are the window itself, so every group ends up small enough to sort.

Every occurrence but the first marks ``LENGTH`` bytes for removal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.llm.common import discard, lean, materialize, partitions_for, ready
from rundelta.llm.ctw import _written, load_table
from rundelta.llm.neardup import join_small

LENGTH, GRAM, SHALLOW, GROUP = 100, 24, 16, 2048
#: Repeated anchor hashes that workers load as a table; more are joined.
LOADED = 12_000_000
#: Windows whose anchors are found at once; positions among them are packed in 28 bits.
AT_ONCE = 1 << 22
#: Rows of small groups that are sorted together.
TOGETHER = 20_000
#: Parts of the rows of one fingerprint.
SALTS = 16
FIRST = -(1 << 63)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    w = data.astype(np.uint64)
    for shift in (1, 2, 4):
        w = w[:-shift] | (w[shift:] << np.uint64(8 * shift))
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for j, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        h ^= h >> np.uint64(29)
        h = (h + w[j : j + n]) * np.uint64(m)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, anchor place, smallest and largest offset, anchor hash.

    Places count from the text's start; an offset is the anchor's place less the window's.
    """
    if sum(map(len, texts)) > AT_ONCE + LENGTH:
        return _anchors_of_parts(texts)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        return none
    h = _gram_hashes(data)
    width = LENGTH - GRAM + 1
    low = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    at[np.arange(len(at)) + LENGTH > (begins + sizes)[text]] = -1
    starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    ends = np.append(starts[1:], len(at)) - 1
    ok = at[starts] >= 0
    starts, ends = starts[ok], ends[ok]
    place, number = at[starts], text[starts]
    return number, place - begins[number], place - ends, place - starts, h[place]


def _anchors_of_parts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of very long texts, from parts that overlap by a window less a byte; a run across a cut is two."""
    found = []
    for n, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - LENGTH + 1), AT_ONCE):
            _, place, a, b, h = anchors([t[lo : lo + AT_ONCE + LENGTH - 1]])
            found.append((np.full(len(place), n), place + lo, a, b, h))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_chunks(batch, text_at: int, most: int = 1_500_000):
    """Row numbers and texts as bytes, some megabytes at a time."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(batch.column(text_at).to_pylist()):
        raw = (t or "").encode("utf-8", "surrogatepass")
        rows.append(i)
        texts.append(raw)
        size += len(raw)
        if size >= most:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _places(batches):
    """(hash, place) where place tells the distinct text and the position: what is counted in step 1."""
    for batch in batches:
        keys = batch.column(1).to_numpy()
        for rows, texts in _in_chunks(batch, 2):
            number, place, _, _, h = anchors(texts)
            tag = (keys[np.array(rows)][number].view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tag.view(np.int64))], ["h", "place"])


_FOUND = pa.schema([("ord", pa.int64()), ("tk", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _contexts(folder: str | None):
    """Anchors with their contexts: those in the table of a folder, or else all, without contexts."""
    schema = _FOUND.append(pa.field("ctx", pa.binary())) if folder else _FOUND

    def run(batches):
        known = load_table(folder, 0.0) if folder else None
        for batch in batches:
            ords, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, texts in _in_chunks(batch, 2):
                number, place, lo, hi, h = anchors(texts)
                if folder:
                    hit = known.get(h) > 0
                    number, place, lo, hi, h = number[hit], place[hit], lo[hit], hi[hit], h[hit]
                row = np.array(rows)[number]
                out = [pa.array(ords[row]), pa.array(keys[row]), pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (place, lo, hi))]
                if folder:
                    cut = [texts[n][p - b : p - a + LENGTH] for n, p, a, b in zip(number.tolist(), place.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                    out.append(pa.array(cut, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def _cut(batches):
    """Contexts of the anchors listed beside each text."""
    for batch in batches:
        for ord_, tk, text, listed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_pylist([{"ord": ord_, "tk": tk, **x, "ctx": raw[x["pos"] - x["hi"] : x["pos"] - x["lo"] + LENGTH]} for x in listed], schema=_FOUND.append(pa.field("ctx", pa.binary())))


class _BlindTrie:
    """A Patricia tree over strings of one length that all share their first bytes.

    Inner nodes are ``[depth, children by byte]``, leaves are string numbers.  A string goes down by
    branch bytes alone to some leaf, is compared with it once, and joins where they part.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.values, self.root, self.same = strings, {}, None, {}

    def _value(self, i: int) -> int:
        if i not in self.values:
            self.values[i] = int.from_bytes(self.strings[i], "big")
        return self.values[i]

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        s, node = self.strings[i], self.root
        while type(node) is list:
            children = node[1]
            node = children.get(s[node[0]])
            if node is None:
                node = next(iter(children.values()))
        x = self._value(i) ^ self._value(node)
        if not x:
            self.same.setdefault(node, []).append(i)
            return
        common = len(s) - (x.bit_length() + 7) // 8
        above, key, place = None, None, self.root
        while type(place) is list and place[0] < common:
            above, key = place, s[place[0]]
            place = above[1][key]
        if type(place) is list and place[0] == common:
            place[1][s[common]] = i
            return
        new = [common, {self.strings[node][common]: place, s[common]: i}]
        if above is None:
            self.root = new
        else:
            above[1][key] = new

    def walk(self) -> tuple[list[int], list[int]]:
        """String numbers in order, and each one's common prefix with the string before it (0 for the first)."""
        order, common = [], []
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if type(node) is list:
                depth, children = node
                for n, b in enumerate(sorted(children, reverse=True)):
                    stack.append((children[b], shared if n == len(children) - 1 else depth))
            else:
                order.append(node)
                common.append(shared)
                for twin in self.same.get(node, ()):
                    order.append(twin)
                    common.append(len(self.strings[twin]))
        return order, common


def multikey_quicksort(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their symbols, and in it whether a row differs from the one before.

    Every segment of more than one row is parted in three by its pivot (the median of its first, middle and
    last symbol): smaller, equal, larger; rows of the equal part go on to the next symbol.  All segments
    are parted in one round of array operations.
    """
    n, words = symbols.shape
    order, depth = np.arange(n), np.zeros(n, dtype=np.int64)
    begins = np.zeros(n, dtype=bool)
    begins[:1] = True
    while True:
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, n))
        live = (sizes > 1) & (depth[starts] < words)
        if not live.any():
            return order, begins
        starts, sizes = starts[live], sizes[live]
        first = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(seg)) - first[seg] + starts[seg]
        own = symbols[order[at], depth[at]]
        three = np.sort(np.stack([own[first], own[first + sizes // 2], own[first + sizes - 1]]), axis=0)
        pivot = three[1][seg]
        smaller, larger = own < pivot, own > pivot
        equal = ~smaller & ~larger
        before = [np.cumsum(x) - x for x in (smaller, equal, larger)]
        within = [b - b[first][seg] for b in before]
        n_small, n_equal = np.add.reduceat(smaller.astype(np.int64), first), np.add.reduceat(equal.astype(np.int64), first)
        place = np.where(smaller, within[0], np.where(equal, n_small[seg] + within[1], (n_small + n_equal)[seg] + within[2])) + starts[seg]
        order[place], depth[place] = order[at], depth[at] + equal
        cuts = np.concatenate([starts + n_small, starts + n_small + n_equal])
        begins[cuts[cuts < np.tile(starts + sizes, 2)]] = True


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of one length, and the common prefix of each with the one before it in that order."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(strings[0])
    words = max(1, min(shallow, size) // 8)
    head = np.frombuffer(b"".join(s[: 8 * words].ljust(8 * words, b"\0") for s in strings), dtype=">u8").reshape(n, words).astype(np.uint64)
    order, begins = multikey_quicksort(head)
    group = np.cumsum(begins)
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        x = head[order[1:]] ^ head[order[:-1]]
        lead = np.zeros(n - 1, dtype=np.int64)
        open_ = np.ones(n - 1, dtype=bool)
        for w in range(words):
            for b in range(8):
                open_ &= ((x[:, w] >> np.uint64(56 - 8 * b)) & np.uint64(255)) == 0
                lead += open_
        common[1:] = np.minimum(lead, size)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, b in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
        if b - a > 1:
            trie = _BlindTrie(strings)
            for i in order[a:b].tolist():
                trie.insert(i)
            found, inside = trie.walk()
            order[a:b] = found
            common[a + 1 : b] = inside[1:]
    return order, common


def first_windows(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For contexts with different first places (``rank``), whether the window at each offset is the first of its kind.

    Returns a boolean array (context, offset); offsets outside ``lo`` to ``hi`` are False.
    """
    n, most = len(contexts), LENGTH - GRAM
    right = [c[h:].ljust(LENGTH, b"\0") for c, h in zip(contexts, hi.tolist(), strict=True)]
    left = [c[:h][::-1].ljust(most, b"\0") for c, h in zip(contexts, hi.tolist(), strict=True)]
    places = []
    for strings in (right, left):
        order, common = deep_shallow(strings)
        where = np.empty(n, dtype=np.int64)
        where[order] = np.arange(n)
        places.append((where, common))
    (right_at, right_common), (left_at, left_common) = places
    out = np.zeros((n, most + 1), dtype=bool)
    for o in range(most + 1):
        here = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(here):
            continue
        r = np.cumsum(right_common < LENGTH - o)[right_at[here]]
        s = np.cumsum(left_common < o)[left_at[here]] if o else np.zeros(len(here), np.int64)
        by = np.lexsort((rank[here], s, r))
        new = np.concatenate([[True], (r[by][1:] != r[by][:-1]) | (s[by][1:] != s[by][:-1])])
        out[here[by[new]], o] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


_KEPT = pa.schema([("ord", pa.int64()), ("tk", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def _sorted_groups(batches):
    """Contexts, in order of their groups, to the offsets at which they are first, as runs."""

    def done(part):
        part.sort(key=lambda r: (r["g"], r["ord"], r["tk"], r["pos"]))
        flags = first_windows([r["ctx"] for r in part], np.array([r["lo"] for r in part]), np.array([r["hi"] for r in part]), np.arange(len(part)))
        out = [{"ord": r["ord"], "tk": r["tk"], "pos": r["pos"], "first": a, "last": b} for r, f in zip(part, flags, strict=True) for a, b in _runs(f)]
        return pa.RecordBatch.from_pylist(out, schema=_KEPT)

    part: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if len(part) >= TOGETHER and r["g"] != part[-1]["g"]:
                yield done(part)
                part = []
            part.append(r)
    if part:
        yield done(part)


def _halved(large: DataFrame) -> DataFrame:
    """Contexts cut to each half of their group's offsets ``a`` to ``b``; ``g`` tells what all windows of a half hold."""
    middle = F.expr("(a + b) div 2").cast("int")
    halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b"))))
    rows = large.select("ord", "tk", "pos", "h", "ctx", "lo", "hi", halves.alias("part")).withColumns({"low": F.greatest("lo", "part.a"), "high": F.least("hi", "part.b")}).where("low <= high")
    # A context begins ``hi`` bytes before its anchor; a cut one ``high`` bytes before it.
    cut = F.expr(f"substring(ctx, hi - high + 1, high - low + {LENGTH})")
    core = F.expr(f"substring(ctx, hi - part.a + 1, part.a + {LENGTH} - part.b)")
    rows = rows.select("ord", "tk", "pos", "h", F.col("part.a").alias("a"), F.col("part.b").alias("b"), cut.alias("ctx"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.xxhash64("h", "part.a", "part.b", core).alias("g"))
    first = F.min(F.struct("ord", "tk", "pos")).alias("at")
    return rows.groupBy("g", "h", "a", "b", "lo", "hi", "ctx").agg(first).select("g", "h", "a", "b", "lo", "hi", "ctx", "at.*")


def _first_runs(distinct: DataFrame, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """(ord, tk, pos, first, last): the runs of offsets at which a distinct context is the first of its kind.

    Beside them the written tables that they are read from.
    """
    written, found, level = [], None, distinct.withColumns({"g": F.col("h"), "a": F.lit(0), "b": F.lit(LENGTH - GRAM)})
    while True:
        level = materialize(level, "substr-level")
        sizes = materialize(level.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "substr-sizes")
        written += [level, sizes]
        lone = level.drop("ctx").join(sizes.where("m = 1"), "g", "left_semi").select("ord", "tk", "pos", F.col("lo").alias("first"), F.col("hi").alias("last"))
        few = level.join(sizes.where(F.col("m").between(2, GROUP)), "g", "left_semi").select("g", "ord", "tk", "pos", "lo", "hi", "ctx")
        few = few.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(lean(_sorted_groups), "ord long, tk long, pos int, first int, last int")
        found = lone.union(few) if found is None else found.union(lone).union(few)
        large = sizes.where(F.col("m") > GROUP)
        if not large.limit(1).count():
            return found, written
        level = _halved(level.join(large, "g", "left_semi"))


def _finish(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    for batch in batches:
        r = batch.to_pydict()
        out = []
        for doc_id, text, copy, found in zip(r["doc_id"], r["text"], r["copy"], r["found"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            n = len(raw)
            spans: list[tuple[int, int]] = []
            if copy and n >= LENGTH:
                spans = [(0, n)]
            elif found and n >= LENGTH:
                starts = np.zeros(n, dtype=bool)
                for f in found:
                    if f["kept"] is None:
                        starts[f["pos"] - f["hi"] : f["pos"] - f["lo"] + 1] = True
                for f in found:
                    if f["kept"] is not None:
                        starts[f["pos"] - f["hi"] : f["pos"] - f["lo"] + 1] = True
                        for k in f["kept"]:
                            starts[f["pos"] - k["last"] : f["pos"] - k["first"] + 1] = False
                at = np.flatnonzero(starts)
                if len(at):
                    cuts = np.flatnonzero(np.diff(at) > LENGTH)
                    spans = list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), (at[np.concatenate([cuts, [len(at) - 1]])] + LENGTH).tolist(), strict=True))
            digest, last = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[last:a])
                last = b
            digest.update(raw[last:])
            out.append({"doc_id": doc_id, "n_bytes": n, "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": digest.hexdigest(), "spans": [{"start": a, "stop": b} for a, b in spans]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])).select(names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row.

    A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a text of
    smaller identifier or earlier in the same text.  Strings are judged on the input.

    Null texts are empty; null identifiers come before all others; rows that share an identifier come
    in order of a hash of their texts, and those that share identifier and text are one text, with one
    result; texts below ``LENGTH`` bytes are never touched; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"ord": F.coalesce("doc_id", F.lit(FIRST)), "tk": F.xxhash64("text")})
    long_rows = rows.where(F.octet_length("text") >= LENGTH)
    # Whole copies of an earlier text.
    skinny = long_rows.select("ord", "tk", F.md5("text").alias("fp"))
    firsts = skinny.groupBy("fp").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).where("first_ord < last_ord")
    # The rows of one fingerprint may be many: they are parted, and its first row goes to every part.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    skinny = skinny.withColumn("salt", F.pmod(F.xxhash64("ord", "tk"), F.lit(SALTS)).cast("int"))
    copies = materialize(skinny.join(firsts, ["fp", "salt"]).where("ord > first_ord").select("ord", "tk").distinct(), "substr-copies").withColumn("copy", F.lit(True))
    originals = join_small(long_rows, copies, ["ord", "tk"], 48, "left_anti")
    texts = originals.select("ord", "tk", "text")
    hashes = texts.mapInArrow(lean(_places), "h long, place long").groupBy("h").agg(F.min("place").alias("p0"), F.max("place").alias("p1")).where("p0 <> p1")
    repeated, folder = _written(hashes.select(F.col("h").alias("key"), F.lit(1.0).alias("value")), "substr-hashes")
    schema = "ord long, tk long, h long, pos int, lo int, hi int"
    if repeated.count() <= LOADED:
        found = texts.mapInArrow(lean(_contexts(folder)), schema + ", ctx binary")
    else:
        # Beyond what a worker can hold, anchors go to the hashes, and contexts are cut from the texts of those that met.
        met = texts.mapInArrow(lean(_contexts(None)), schema).join(repeated.select(F.col("key").alias("h")), "h")
        listed = met.groupBy("ord", "tk").agg(F.collect_list(F.struct("h", "pos", "lo", "hi")).alias("listed"))
        once = texts.groupBy("ord", "tk").agg(F.first("text").alias("text"))
        found = once.join(listed, ["ord", "tk"]).select("ord", "tk", "text", "listed").mapInArrow(lean(_cut), schema + ", ctx binary")
    found = materialize(found, "substr-contexts")
    first = F.min(F.struct("ord", "tk", "pos")).alias("at")
    distinct = found.groupBy("h", "lo", "hi", "ctx").agg(first).select("h", "lo", "hi", "ctx", "at.*")
    runs, written = _first_runs(distinct, partitions_for(rows))
    kept = runs.groupBy("ord", "tk", "pos").agg(F.collect_list(F.struct("first", "last")).alias("kept"))
    # A first occurrence whose windows are all repeats of other contexts has an empty list: it is told from later ones by that alone.
    spans = found.select("ord", "tk", "pos", "lo", "hi").join(kept, ["ord", "tk", "pos"], "left")
    spans = spans.groupBy("ord", "tk").agg(F.collect_list(F.struct("pos", "lo", "hi", "kept")).alias("found"))
    spans = materialize(spans, "substr-spans")
    discard(repeated, found, *written)
    out = rows.join(spans, ["ord", "tk"], "left")
    out = join_small(out, copies, ["ord", "tk"], 48, "left")
    types = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    return out.select("doc_id", "text", "copy", "found").mapInArrow(lean(_finish), types)
