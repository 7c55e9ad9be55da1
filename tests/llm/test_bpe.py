"""The tokenization automaton against plain merging and against the library."""

import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rundelta.llm import bpe, queries

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens int, word int"


def tokenizer_file(folder, merges):
    chars = list(bpe.byte_characters().values())
    vocab = {c: i for i, c in enumerate([*chars, *(a + b for a, b in merges)])}
    spec = {
        "version": "1.0", "truncation": {"max_length": 2, "stride": 0, "strategy": "LongestFirst", "direction": "Right"}, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": [list(m) for m in merges]},
    }
    path = folder / "tokenizer.json"
    path.write_text(json.dumps(spec))
    return str(path), vocab


def merged(word, merges):
    """Each merge in turn, left to right."""
    parts = list(word)
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(8))
def test_automaton_is_the_merges_in_turn(tmp_path, seed):
    rng, tokens, merges = random.Random(seed), list("ab" if seed % 2 else "abc"), []
    while len(merges) < 14:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            tokens.append(a + b)
            merges.append((a, b))
    path, vocab = tokenizer_file(tmp_path, merges)
    automaton = bpe.compile_merges(path)
    for n in range(9):
        for word in map("".join, itertools.product(sorted(set(tokens[:3]) & set("abc")), repeat=n)) if n < 8 else ("".join(rng.choice("abc") for _ in range(60)) for _ in range(50)):
            assert [*automaton.encode(word.encode())] == [vocab[t] for t in merged(word, merges)]
            assert word == "" or automaton._encode_long(word.encode()) == automaton.encode(word.encode())
            assert automaton.decode(automaton.encode(word.encode())) == word.encode()


def test_merges_out_of_order_are_refused(tmp_path):
    for merges in ([("ab", "c"), ("a", "b")], [("a", "bc"), ("b", "c")]):
        path, _ = tokenizer_file(tmp_path, merges)
        with pytest.raises(ValueError, match="out of order"):
            bpe.compile_merges(path)
    with pytest.raises(ValueError, match="byte-level"):
        bpe.compile_merges(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_merges(BPE)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    some = ["aa", "ab", " ", "  ", "\n", "\n\n", "\t", "the", "ing", "'s", "'ll", "'", "é", "中文", "，", "1", "23", "!", "--", "    ", "\xa0", "᠎", "\x1c", "𝔘", "<|endoftext|>", "x" * 50, "\r\n", "٣", "ｱ", "́", "<|endof"]
    out = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 255), rng.randint(1, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(rng.randint(0, 40))) for _ in range(1000)]


def test_texts_are_encoded_as_the_library_does(automaton, odd_texts):
    library, enc = Tokenizer.from_file(BPE), bpe.Encoder(BPE, automaton)
    for text, expected in zip(odd_texts, library.encode_batch_fast(odd_texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(b"".join(enc.parts(text)), dtype="<u4").tolist()
        assert ids == expected.ids
        assert automaton.decode(ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_slices_and_long_pieces_change_nothing(automaton, odd_texts):
    library, enc = Tokenizer.from_file(BPE), bpe.Encoder(BPE, automaton)
    enc.SLICE = 40
    for text in odd_texts[:600] + ["don't stop, it's 3rd; we'll  go\n\n on" * 9, "中文，中文 中文。" * 30]:
        assert np.frombuffer(b"".join(enc.parts(text)), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    blob = "ab9x" * 300_000
    assert automaton.decode(enc.automaton.encode(blob.encode())) == blob.encode()


def test_saved_tables_are_the_same(automaton, tmp_path):
    again = bpe.Automaton.load(automaton.save(f"file://{tmp_path}/t.npz"))
    assert (again.labels, again.row, again.column, again.special) == (automaton.labels, automaton.row, automaton.column, automaton.special)
    assert (again.bits == automaton.bits).all() and again.encode(b" tokenization") == automaton.encode(b" tokenization")


def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    texts = [(1, "Hello world, hello  again\n"), (1, "Hello world"), (2, None), (3, ""), (None, "é <|endoftext|> x"), (4, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], SCHEMA)
    library = Tokenizer.from_file(BPE)
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in texts]
    encoded = bpe.encode(docs, BPE)
    assert sorted(((r[0], r[1]) for r in encoded.collect()), key=str) == sorted(((i, ids) for i, ids, _ in expected), key=str)
    assert sorted(((r[0], r[1]) for r in bpe.decode(encoded, BPE).collect()), key=str) == sorted(((i, t) for i, _, t in expected), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sorted(((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(t.encode())) for i, ids, t in expected), key=str)
    assert sorted((tuple(r) for r in bpe.round_trip(docs, BPE).collect()), key=str) == digests
    assert bpe.round_trip(docs.limit(0), BPE).count() == 0
    broken = spark.createDataFrame([(1, [160, 120]), (2, None)], "doc_id long, ids array<int>")
    assert {r[0]: r[1] for r in bpe.decode(broken, BPE).collect()} == {1: library.decode([160, 120], skip_special_tokens=False), 2: ""}


def test_query_equals_the_library_on_whole_documents(spark):
    folder, library = "/root/testdata/sf0.001", Tokenizer.from_file(BPE)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_bpe_automaton(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
