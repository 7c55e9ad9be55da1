"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton reads token identifiers and accepts just the sequences that the merges make of some bytes.  It
starts as one state with an arc for each byte.  Each merge (a, b) -> c, in order of rank, adds a gadget: every
state that has an arc ``a`` to a state with an arc ``b`` gets an arc ``c`` to where that ``b`` leads, and the
arcs ``a`` lead from then on to a copy of their target without its arc ``b``.  All arcs with one label lead to one
state, so the table of arcs is a bit for each (state, class of labels): states are rows, shared until a gadget
changes one of them; labels that leave the same states are one class, a column, shared in the same way.

A word is encoded left to right: from the state in which its first i bytes end, the trie of labels lists the
tokens that may come next and the table says which of them are arcs; every byte string has one accepted sequence,
so each position is reached once at most and time is linear in the word.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import codecs
import io
import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rundelta.llm.common import file_system, lean, ready, shared_dir, write_bytes
from rundelta.llm.sstable import CachedEncoder


def byte_characters() -> dict[int, str]:
    """How byte-level models write bytes: visible Latin-1 characters as they are, the rest from U+0100 on, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Gadgets:
    """The table of arcs while merges are added."""

    def __init__(self, n_labels: int):
        self.bits = np.zeros((256, 32), dtype=np.uint8)
        #: The start state allows all; every label at first leads back to it.
        self.bits[0] = 255
        self.row = np.full(n_labels, -1, dtype=np.int32)
        self.column = np.full(n_labels, -1, dtype=np.int32)
        self.row_users, self.column_users = [1], [0]
        self.free_rows: list[int] = []
        self.free_columns: list[int] = []

    def add_byte(self, label: int) -> None:
        self._lead(label, 0)
        self._class(label, 0)

    def _lead(self, label: int, row: int) -> None:
        old = self.row[label]
        self.row_users[row] += 1
        self.row[label] = row
        if old >= 0:
            self.row_users[old] -= 1
            if not self.row_users[old]:
                self.free_rows.append(int(old))

    def _class(self, label: int, column: int) -> None:
        old = self.column[label]
        self.column_users[column] += 1
        self.column[label] = column
        if old >= 0:
            self.column_users[old] -= 1
            if not self.column_users[old]:
                self.free_columns.append(int(old))

    def _new_row(self, like: int) -> int:
        if self.free_rows:
            new = self.free_rows.pop()
        else:
            new = len(self.row_users)
            self.row_users.append(0)
            if new == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        self.bits[new] = self.bits[like]
        return new

    def _new_column(self, like: int) -> int:
        if self.free_columns:
            new = self.free_columns.pop()
        else:
            new = len(self.column_users)
            self.column_users.append(0)
            if new == 8 * self.bits.shape[1]:
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=1)
                self.bits[0] = 255
        byte, bit = new >> 3, np.uint8(1 << (new & 7))
        held = self.bits[:, like >> 3] >> np.uint8(like & 7) & np.uint8(1)
        self.bits[:, byte] = self.bits[:, byte] & ~bit | held * bit
        return new

    def has_arc(self, row: int, label: int) -> bool:
        c = int(self.column[label])
        return bool(self.bits[row, c >> 3] >> (c & 7) & 1)

    def merge(self, a: int, b: int, c: int) -> bool:
        """The gadget of one merge; False where no state has the two arcs, so the merge never happens."""
        before = int(self.row[a])
        if not self.has_arc(before, b):
            return False
        beyond = before if a == b else int(self.row[b])
        if a == b or self.row_users[before] > 1:
            # ``beyond`` is held by the new label, so the state that ``a`` leaves stays in use.
            self._lead(c, beyond)
            self._lead(a, self._new_row(before))
        else:
            self._lead(c, beyond)
        if self.column_users[self.column[b]] > 1:
            self._class(b, self._new_column(int(self.column[b])))
        at = int(self.column[b])
        self.bits[self.row[a], at >> 3] &= np.uint8(255 - (1 << (at & 7)))
        self._class(c, int(self.column[a]))
        return True


class Automaton:
    """Arc table, labels and the trie of labels."""

    def __init__(self, labels: list[bytes], row: np.ndarray, column: np.ndarray, bits: np.ndarray, special: dict[str, int]):
        self.labels, self.special = labels, special
        self.row, self.column, self.bits = row.tolist(), column.tolist(), bits
        self.rows = [memoryview(r) for r in bits]
        self.sizes = [len(x) for x in labels]
        #: The trie: children by byte and the token that ends, a node each.
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        #: The start state has an arc for every token, so a word that is a label is one token.
        self.whole: dict[bytes, array] = {}
        for i, label in enumerate(labels):
            if self.row[i] < 0:
                continue
            node = 0
            for b in label:
                below = self.children[node]
                node = below.get(b, -1)
                if node < 0:
                    node = below[b] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = i
            self.whole[label] = array("I", [i])

    def encode(self, word: bytes) -> array:
        """Identifiers of the tokens that the merges make of a word.

        Each position of a word is the end of one accepted sequence at most, so a walk that tries longer tokens
        first and turns back where no arc leads on meets it once.
        """
        found = self.whole.get(word)
        if found is not None:
            return found
        n = len(word)
        if n > self.LONG:
            return self._encode_long(word)
        path, stack, at, state = [], [self._next(word, 0)], 0, 0
        column, rows, row, sizes = self.column, self.rows, self.row, self.sizes
        while at < n:
            some, arcs = stack[-1], rows[state]
            while some:
                t = some.pop()
                c = column[t]
                if arcs[c >> 3] >> (c & 7) & 1:
                    path.append(t)
                    at += sizes[t]
                    state = row[t]
                    stack.append(self._next(word, at))
                    break
            else:
                stack.pop()
                at -= sizes[path.pop()]
                state = row[path[-1]] if path else 0
        return array("I", path)

    #: Words beyond this are encoded by a table of their positions, not by a walk.
    LONG = 1000

    def _next(self, word: bytes, at: int) -> list[int]:
        """Tokens that the word goes on with, shorter ones first."""
        out, node, children, token = [], 0, self.children, self.token
        for b in word[at:]:
            node = children[node].get(b)
            if node is None:
                break
            t = token[node]
            if t >= 0:
                out.append(t)
        return out

    def _encode_long(self, word: bytes) -> array:
        """The last token of each prefix's sequence, from left to right, then back from the end."""
        n = len(word)
        states, last = array("i", [-1]) * (n + 1), array("i", [-1]) * (n + 1)
        states[0] = 0
        children, token, row, column, rows = self.children, self.token, self.row, self.column, self.rows
        for i in range(n):
            arcs, node = rows[states[i]], 0
            for j in range(i, n):
                node = children[node].get(word[j])
                if node is None:
                    break
                t = token[node]
                if t >= 0 and last[j + 1] < 0:
                    c = column[t]
                    if arcs[c >> 3] >> (c & 7) & 1:
                        last[j + 1], states[j + 1] = t, row[t]
        out, at = array("I"), n
        while at:
            out.append(last[at])
            at -= self.sizes[last[at]]
        out.reverse()
        return out

    def decode(self, ids) -> bytes:
        """The labels of the arcs in a row."""
        return b"".join(map(self.labels.__getitem__, ids))

    def save(self, uri: str) -> str:
        out = io.BytesIO()
        ends = np.cumsum([len(x) for x in self.labels])
        np.savez(out, labels=np.frombuffer(b"".join(self.labels), np.uint8), ends=ends, row=np.array(self.row, np.int32), column=np.array(self.column, np.int32), bits=self.bits, special=np.frombuffer(json.dumps(self.special).encode(), np.uint8))
        write_bytes(uri, [out.getvalue()])
        return uri

    @classmethod
    def load(cls, uri: str) -> Automaton:
        fs, path = file_system(uri)
        with fs.open_input_file(path) as f:
            data = np.load(io.BytesIO(f.read()))
            joined, ends = data["labels"].tobytes(), data["ends"].tolist()
            labels = [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            return cls(labels, data["row"], data["column"], data["bits"], json.loads(data["special"].tobytes()))


def compile_merges(tokenizer: str) -> Automaton:
    """The automaton of a byte-level tokenizer file.

    Refused: models that are no byte-level BPE, merges that use a token before its own merge or make one twice
    (the order of the merges would then not decide), added tokens that take white space or whole words only.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("only plain byte-level BPE models compile")
    special = {}
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r} is not matched as it stands")
        special[t["content"]] = t["id"]
    to_byte = {c: b for b, c in byte_characters().items()}
    vocab = model["vocab"]
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        labels[i] = bytes(to_byte[c] for c in text) if text not in special else text.encode()
    for text, i in special.items():
        labels[i] = text.encode()
    table = Gadgets(len(labels))
    for c in to_byte:
        table.add_byte(vocab[c])
    made = {vocab[c] for c in to_byte}
    for pair in model["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        x, y, z = vocab[a], vocab[b], vocab[a + b]
        if x not in made or y not in made or z in made:
            raise ValueError(f"merge {a} {b} is out of order")
        made.add(z)
        if table.row[x] >= 0 and table.row[y] >= 0:
            table.merge(x, y, z)
    rows, columns = len(table.row_users), -(-len(table.column_users) // 8)
    return Automaton(labels, table.row, table.column, np.ascontiguousarray(table.bits[:rows, :columns]), special)


class Encoder(CachedEncoder):
    """Whole texts: split as the library splits them, each new word by the automaton.

    The library is asked for the places at which a text falls into words; what it makes of them it is not asked.
    """

    SLICE = 1 << 20
    #: Inside a text, a cut after an ASCII letter and before one of these signs is one of the split, whatever follows.
    CUT = re.compile(r"(?<=[A-Za-z])(?=[ -/:-@\[-`{-~0-9\n])|(?<=[一-鿿])(?=[ \n，。、])")

    def __init__(self, tokenizer: str, automaton: Automaton):
        self.automaton, self.pieces = automaton, _Pieces(automaton)
        self.to_byte = {c: b for b, c in byte_characters().items()}
        super().__init__(tokenizer, None)
        if not self.by_piece:
            raise ValueError("only plain byte-level BPE models compile")
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(automaton.special, key=len, reverse=True)) + ")") if automaton.special else None
        self.special = []

    def _merged(self, before: str, word: str) -> bytes:
        return self.automaton.encode((before + word).encode()).tobytes()

    def _plain(self, texts: list[str]) -> list[bytes]:
        to_byte, known, split = self.to_byte, self.pieces.__getitem__, self.model.pre_tokenizer.pre_tokenize_str
        return [b"".join([known(bytes([to_byte[c] for c in piece])) for piece, _ in split(t)]) for t in texts]

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.SLICE:
            cut = self.CUT.search(text, at + self.SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def parts(self, text: str) -> Iterator[bytes]:
        """Packed identifiers of a text, a slice at a time."""
        for i, stretch in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                yield np.array([self.automaton.special[stretch]], dtype="<u4").tobytes()
            elif stretch:
                for part in self.slices(stretch):
                    found = self._found(part)
                    yield self._plain([part])[0] if found is None else found
        self.first.age()
        self.spaced.age()
        self.pieces.age()

    def clear(self) -> None:
        super().clear()
        self.pieces.clear()


class _Pieces(dict):
    """Packed identifiers of the library's pieces, bounded."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, piece: bytes) -> bytes:
        found = self.automaton.encode(piece).tobytes()
        if len(piece) <= CachedEncoder.LONGEST:
            self[piece] = found
        return found

    def age(self) -> None:
        if len(self) > CachedEncoder.LIMIT:
            self.clear()


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str, tables: str) -> Encoder:
    """This worker's encoder; the tables are read once."""
    if tables not in _ENCODERS:
        _ENCODERS[tables] = Encoder(tokenizer, Automaton.load(tables))
    return _ENCODERS[tables]


def _run(tokenizer: str, tables: str, answer, schema: pa.Schema):
    def run(batches):
        enc = encoder(tokenizer, tables)
        for batch in batches:
            if batch.num_rows:
                rows = [(i, *answer(enc, text)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)
        enc.clear()

    return lean(run)


def _ids(enc: Encoder, text: str | None) -> tuple:
    return (np.frombuffer(b"".join(enc.parts(text or "")), dtype="<u4").tolist(),)


def _digests(enc: Encoder, text: str | None) -> tuple:
    n, ids_hash, text_hash = 0, sha256(), sha256()
    chars = codecs.getincrementaldecoder("utf-8")("replace")
    for part in enc.parts(text or ""):
        ids = np.frombuffer(part, dtype="<u4")
        n += len(ids)
        ids_hash.update(part)
        text_hash.update(chars.decode(enc.automaton.decode(ids.tolist())).encode())
    text_hash.update(chars.decode(b"", final=True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _over_texts(docs: DataFrame, tokenizer: str, answer, columns: list[tuple[str, str, pa.DataType]], id_col: str, text_col: str) -> DataFrame:
    spark = ready(docs.sparkSession)
    tables = compile_merges(tokenizer).save(f"{shared_dir(spark, 'bpe')}/tables.npz")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    schema = pa.schema([(id_col, pa.int64()), *((name, kind) for name, _, kind in columns)])
    ddl = ", ".join([f"`{id_col}` long", *(f"{name} {sql}" for name, sql, _ in columns)])
    return rows.mapInArrow(_run(tokenizer, tables, answer, schema), ddl)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the identifiers of every whole text.

    Equal to the library's with ``add_special_tokens=False``: text of an added token is that token.  Null texts
    are empty and have no identifiers, repeated and null row identifiers are kept as they are, an empty table
    gives no rows, other columns are ignored.
    """
    return _over_texts(docs, tokenizer, _ids, [("ids", "array<int>", pa.list_(pa.int32()))], id_col, text_col)


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of identifiers: labels in a row, bytes that are no UTF-8 as U+FFFD.  Null: the empty text; unknown identifiers raise."""
    spark = ready(rows.sparkSession)
    tables = compile_merges(tokenizer).save(f"{shared_dir(spark, 'bpe')}/tables.npz")

    def run(batches):
        enc = encoder(tokenizer, tables)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids and min(ids) < 0:
                    raise ValueError("identifiers are not negative")
                texts.append(enc.automaton.decode(ids or []).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(lean(run), f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, slice by slice, so memory is that of a slice.

    Texts and rows count as in ``encode``.
    """
    columns = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _over_texts(docs, tokenizer, _digests, columns, id_col, text_col)
