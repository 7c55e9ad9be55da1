"""Token-ID output: documents in sorted-string-table shards that a reader can search.

A shard is one immutable file:

``data blocks | Bloom filter | sparse block index | footer``

* Keys: one byte ``00`` for a null identifier, else ``01`` and the identifier as an unsigned big-endian
  integer with its sign bit flipped (so byte order is numeric order), then a four-byte counter that
  tells rows with one identifier apart.
* A data block holds entries in key order.  An entry stores the length of the prefix it shares with
  the key before it, the rest of the key and the value.  Every ``RESTART`` entries a key is stored
  whole; the offsets of these entries end the block, so a lookup can bisect them.  Blocks are
  compressed one by one and carry a CRC-32.
* The index has the last key, offset and length of each block; the footer the places of all parts and
  the counts of documents and tokens.

A value is one byte (2 or 4: bytes of a token identifier) and the identifiers, little-endian.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rundelta.llm.common import file_system, lean, materialize, partitions_for, read_range, ready, shared_dir, write_bytes

MAGIC = b"RDSSTBL1"
RESTART = 16
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 64 * 1024 * 1024
BITS_PER_KEY = 12
FOOTER = struct.Struct("<QQQQQQQII8s")


def encode_key(doc_id: int | None, repeat: int = 0) -> bytes:
    if doc_id is None:
        return b"\x00" + struct.pack(">I", repeat)
    return b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1)) + struct.pack(">I", repeat)


def decode_key(key: bytes) -> tuple[int | None, int]:
    if key[0] == 0:
        return None, struct.unpack(">I", key[1:5])[0]
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63), struct.unpack(">I", key[9:13])[0]


def encode_value(ids: bytes) -> bytes:
    """From little-endian unsigned 32-bit identifiers; two bytes each where all fit."""
    a = np.frombuffer(ids, dtype="<u4")
    if len(a) == 0 or int(a.max()) < 65536:
        return b"\x02" + a.astype("<u2").tobytes()
    return b"\x04" + ids


def decode_value(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    """A Bloom filter with double hashing; what was added is always found."""

    def __init__(self, bits: np.ndarray, hashes: int = 8):
        self.bits, self.hashes = bits, hashes

    @staticmethod
    def _places(keys: list[bytes], n_bits: int, hashes: int) -> np.ndarray:
        h = np.array([xxhash.xxh3_128_intdigest(k) & ((1 << 64) - 1) for k in keys], dtype=np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(n_bits)

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        n_bytes = max(8, (len(keys) * BITS_PER_KEY + 7) // 8)
        bits = np.zeros(n_bytes, dtype=np.uint8)
        if keys:
            at = cls._places(keys, n_bytes * 8, 8).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        return cls(bits)

    def may_hold(self, key: bytes) -> bool:
        at = self._places([key], len(self.bits) * 8, self.hashes)[0]
        return all(self.bits[int(x) >> 3] >> (int(x) & 7) & 1 for x in at)


def _block(entries: list[tuple[bytes, bytes]]) -> bytes:
    out, restarts, last = bytearray(), [], b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i % RESTART == 0:
            restarts.append(len(out))
        else:
            most = min(len(last), len(key))
            while shared < most and last[shared] == key[shared]:
                shared += 1
        out += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        last = key
    out += struct.pack(f"<{len(restarts)}I", *restarts) + struct.pack("<I", len(restarts))
    packed = zstandard.ZstdCompressor(level=1).compress(bytes(out))
    return packed + struct.pack("<I", zlib.crc32(packed))


def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    last = b""
    while at < end:
        shared, at = _read_varint(raw, at)
        rest, at = _read_varint(raw, at)
        size, at = _read_varint(raw, at)
        last = last[:shared] + raw[at : at + rest]
        yield last, raw[at + rest : at + rest + size]
        at += rest + size


class ShardWriter:
    """Collects entries in ascending key order; ``chunks()`` are the file's bytes."""

    def __init__(self):
        self.blocks: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.pending: list[tuple[bytes, bytes]] = []
        self.pending_bytes = self.offset = self.n_docs = self.n_tokens = 0
        self.last = b""

    def add(self, key: bytes, ids: bytes) -> None:
        if key <= self.last:
            raise ValueError("keys must ascend strictly")
        self.last = key
        value = encode_value(ids)
        self.keys.append(key)
        self.pending.append((key, value))
        self.pending_bytes += len(value) + len(key)
        self.n_docs += 1
        self.n_tokens += len(ids) // 4
        if self.pending_bytes >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            block = _block(self.pending)
            self.index.append((self.pending[-1][0], self.offset, len(block)))
            self.blocks.append(block)
            self.offset += len(block)
            self.pending, self.pending_bytes = [], 0

    def chunks(self) -> list[bytes]:
        self._flush()
        bloom = Bloom.of(self.keys).bits.tobytes()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        footer = FOOTER.pack(self.offset, len(bloom), self.offset + len(bloom), len(index), len(self.index), self.n_docs, self.n_tokens, zlib.crc32(bloom), zlib.crc32(index), MAGIC)
        return [*self.blocks, bloom, index, footer]


class ShardReader:
    """Reads a shard by footer, index and filter; ``get`` touches one block at most."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short for a footer")
        bo, bn, io, n, self.n_blocks, self.n_docs, self.n_tokens, bc, ic, magic = FOOTER.unpack(read_range(handle, size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        bloom, index = read_range(handle, bo, bn), read_range(handle, io, n)
        if zlib.crc32(bloom) != bc or zlib.crc32(index) != ic:
            raise ValueError("damaged filter or index")
        self.bloom, self.last_keys, self.places, at = Bloom(np.frombuffer(bloom, dtype=np.uint8)), [], [], 0
        while at < len(index):
            k, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + k])
            o, at = _read_varint(index, at + k)
            m, at = _read_varint(index, at)
            self.places.append((o, m))

    def _raw(self, i: int) -> tuple[bytes, int, list[int]]:
        packed = read_range(self.handle, *self.places[i])
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"damaged block {i}")
        raw = zstandard.ZstdDecompressor().decompress(packed[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw, end, list(struct.unpack(f"<{n}I", raw[end:-4]))

    def get(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        """The identifiers of one row, or None."""
        key = encode_key(doc_id, repeat)
        if not self.bloom.may_hold(key):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.places):
            return None
        raw, end, restarts = self._raw(i)
        lo, hi = 0, len(restarts) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if next(_entries(raw, restarts[mid], end))[0] <= key:
                lo = mid
            else:
                hi = mid - 1
        for k, value in _entries(raw, restarts[lo], end):
            if k >= key:
                return decode_value(value) if k == key else None
        return None

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            raw, end, _ = self._raw(i)
            for key, value in _entries(raw, 0, end):
                yield key, decode_value(value)


class _Table(dict):
    """Identifiers by piece; what is absent is encoded when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.learn(piece)
        if len(piece) <= CachedEncoder.LONGEST:
            self[piece] = found
        return found

    def age(self) -> None:
        """Full: this table becomes the older one, and the one before is let go."""
        if len(self) > CachedEncoder.LIMIT:
            self.old = dict(self)
            super().clear()

    def clear(self) -> None:
        self.old = {}
        super().clear()


class CachedEncoder:
    """Encodes whole texts with a ``tokenizers`` model, looking up pieces that were seen before.

    A byte-level model with the usual pattern never joins a piece across a lone space or a lone line
    feed between two characters that are not white space, so the identifiers of a text are those of
    its pieces in a row: of a line's first word as it is, of each other word with its space, and of
    line feeds.  A word of letters alone is one piece of the pattern and goes to the model's merges at
    once; a word of ASCII characters, or of letters and ASCII signs after them, is cut by the pattern
    first; any other word is encoded by the whole model.
    Texts with any other white space or with a special token's text, and models of another kind, are
    encoded as they are.  The tables are bounded (``LIMIT`` pieces of at most ``LONGEST`` characters in
    each of two generations), which changes speed only.
    """

    LIMIT, LONGEST = 250_000, 64
    #: The model's pattern within a word of ASCII characters and its space.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+")
    SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        pre, merges = self.model.pre_tokenizer, self.model.model
        self.by_piece = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.model.normalizer is None and isinstance(merges, BPE) and merges.dropout is None
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        if self.by_piece:
            self.merge = merges.tokenize
            self.feed = self._plain(["\n"])[0]
            self.mapped = self._byte_characters(ByteLevel(add_prefix_space=False, use_regex=False))
            self.by_piece = all(self.mapped[c] == chr(c) for c in range(33, 127))
            self.packed = [struct.pack("<I", i) for i in range(self.model.get_vocab_size())]
        #: Words that begin a line, and words after a space.
        self.first = _Table(lambda w: self._learn("", w))
        self.spaced = _Table(lambda w: self._learn(" ", w))

    @staticmethod
    def _byte_characters(pre) -> dict[int, str]:
        """The character by which the model writes each byte, asked of the library."""
        found = {}
        some = [*range(0x800), *range(0x800, 0xD800, 0x800), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)]
        for c in map(chr, some):
            found |= zip(c.encode(), pre.pre_tokenize_str(c)[0][0], strict=True)
        return found

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _merged(self, before: str, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.mapped)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(self.mapped[32] + word if before else word)])

    def _learn(self, before: str, word: str) -> bytes:
        if word.isalpha():
            return self._merged(before, word)
        if not word.isascii():
            letters = word.rstrip(self.SIGNS)
            if not letters.isalpha():
                return self._plain([before + word])[0]
            return (self.spaced if before else self.first)[letters] + self.first[word[len(letters) :]]
        pieces = self.PIECES.findall(before + word)
        if len(pieces) == 1:
            return self._merged(before, word)
        return b"".join([self.spaced[p[1:]] if p[0] == " " else self.first[p] for p in pieces])

    def _found(self, text: str) -> bytes | None:
        """None for a text that has to be encoded as it is."""
        if "\u180e" in text or any(s in text for s in self.special):
            return None
        first, spaced, out = self.first.__getitem__, self.spaced.__getitem__, []
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:
                return None
            out.append(first(words[0]) + b"".join(map(spaced, words[1:])))
        return self.feed.join(out)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit identifiers of each text and the end; null is the empty text."""
        texts = [t or "" for t in texts]
        self.first.age()
        self.spaced.age()
        out = [self._found(t) if self.by_piece else None for t in texts]
        plain = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
            out[i] = x
        return [x + self.end for x in out]

    def clear(self) -> None:
        """Forget the pieces; the model stays."""
        self.first.clear()
        self.spaced.clear()


_ENCODERS: dict = {}


def encoder(path: str, end_id: int | None) -> CachedEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = CachedEncoder(path, end_id)
    return _ENCODERS[path, end_id]


MANIFEST = T.StructType([T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])


def _writer(folder: str, tokenizer: str, end_id: int | None, shard_bytes: int):
    def write(batches):
        import uuid

        from pyspark import TaskContext

        part, seq, shard, enc = TaskContext.get().partitionId(), 0, ShardWriter(), encoder(tokenizer, end_id)
        last, repeat = object(), 0

        def close():
            path = f"{folder}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}.sst"
            n = write_bytes(path, shard.chunks())
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": shard.n_docs, "n_tokens": shard.n_tokens, "n_bytes": n}])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 200):
                for doc_id, tokens in zip(ids[lo : lo + 200], enc.encode(texts.slice(lo, 200).to_pylist()), strict=True):
                    last, repeat = doc_id, repeat + 1 if doc_id == last else 0
                    shard.add(encode_key(doc_id, repeat), tokens)
                    if shard.offset >= shard_bytes:
                        yield close()
                        seq, shard = seq + 1, ShardWriter()
        if shard.n_docs:
            yield close()
        enc.clear()

    return lean(write)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode documents and write them as shards in ascending identifier order; returns the manifest.

    One range shuffle deals the rows by identifier, and by a hash of the text where many rows share one;
    each task sorts its range (ties by that hash, then by text, so reruns agree), encodes it and writes
    shards of about ``shard_bytes`` to ``folder`` on shared storage.  A
    file appears under its name only when whole, and the manifest names the files of the attempt that
    ended, so lost executors leave at most unnamed files.  Manifest: part, seq, path, n_docs,
    n_tokens, n_bytes; (part, seq) is identifier order.

    Null texts count as empty, null identifiers sort first, repeated identifiers are kept as rows of
    their own, an empty table gives an empty manifest, other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    folder = folder or shared_dir(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions_for(rows), *order).sortWithinPartitions(*order, "text")
    return materialize(dealt.mapInArrow(_writer(folder, tokenizer, end_id, shard_bytes), MANIFEST), "manifest")


def _reader(batches):
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = file_system(row["path"])
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            with fs.open_input_file(path) as handle:
                start, shard = row["base"], ShardReader(handle)
                for key, ids in shard:
                    out["doc_id"].append(decode_key(key)[0])
                    out["start"].append(start)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    start += len(ids)
                if start - row["base"] != shard.n_tokens or len(out["doc_id"]) != shard.n_docs:
                    raise ValueError(f"{path}: counts differ from the footer")
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (identifiers before it), n_tokens, ids_crc32.

    The manifest has a row a file (files are at least a task's share), so the running sum of their
    token counts is taken on the driver, the files are read on the executors.
    """
    base, files = 0, []
    for r in sorted(manifest.select("part", "seq", "path", "n_tokens").collect(), key=lambda r: (r["part"], r["seq"])):
        files.append((r["path"], base))
        base += r["n_tokens"]
    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
