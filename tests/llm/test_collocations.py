"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rundelta.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, size int, f long, n int"


def plain_counts(rows, most):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return counts, totals


def plain(rows, least=10, top=2000):
    counts, totals = plain_counts(rows, 3)
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, ws), a in cand.items():
        cuts = [(1_000_000 * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws))]
        if any(100 * f >= 50 * a for (other, longer), f in cand.items() if other == lang and len(longer) > len(ws) and ws in (longer[:2], longer[1:])):
            continue
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    out = []
    for lang, some in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, g, "x", 1, 2, 3) for i, (t, g) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in collocations.mine(docs, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "new", "york", "City", "a", "b", "é", "x" * 200, "\x00", "z\xa0z"]
    out = []
    for _ in range(150):
        parts = [rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice([" ", "  ", "\t"]).join(parts), rng.choice(["en", "en", "de", None, "und", ""])))
    out += [("new york city " * 30, "en")] * 20 + [(None, "en"), ("", None), (" \n. ,", "de"), ("only here", "xx"), ("a a a a a a a a a a a a a a", "rep")]
    return out


def test_phrases_equal_plain_counting(spark, rows):
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_a_sketch_too_small_and_a_short_report_change_nothing_else(spark, rows):
    # 16 cells a row: every phrase survives the sketch; two phrases a language.
    assert mined(spark, rows, bits=4, top=2) == plain(rows, top=2)
    assert mined(spark, rows, least=40) == plain(rows, least=40)


def test_long_texts_are_cut_between_words(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 37)
    for text in ("one two three four " * 40, "a.b c\td,e  f " * 50, "w" * 100 + " q " + "v" * 90):
        parts = list(collocations._cut(text, 3))
        counts = Counter()
        for words, seen in parts:
            numbers = np.array([0 if w == b"." else 1 for w in words])
            for size, at in collocations._grams(numbers, seen, 3):
                counts.update(tuple(words[i : i + size]) for i in at.tolist())
        expected, _ = plain_counts([(text, "en")], 3)
        assert {k: v for k, v in counts.items()} == {tuple(w.encode() for w in ws): n for (_, ws), n in expected.items()}


def test_sketches_never_count_too_little_and_prune(spark):
    rng = np.random.default_rng(5)
    frequent = np.repeat(rng.integers(1, 1 << 63, 40, dtype=np.uint64), 12)
    rare = rng.integers(1, 1 << 63, 30_000, dtype=np.uint64)
    counts = [np.bincount(collocations._cells(np.concatenate([frequent, rare]), row, 16).astype(np.int64), minlength=1 << 16) for row in range(collocations.ROWS)]
    heavy = collocations.Heavy.__new__(collocations.Heavy)
    heavy.bits, heavy.maps = 16, np.stack([np.packbits(c >= 10, bitorder="little") for c in counts])
    assert heavy.may_reach(np.unique(frequent)).all()
    assert heavy.may_reach(rare).mean() < 0.001


def test_empty_tables_and_many_words_at_once(spark, rows, monkeypatch):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en")]) == []
    monkeypatch.setattr(collocations, "HELD", 100)
    monkeypatch.setattr(collocations, "MOST_WORDS", 5)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    some = docs.where("lang = 'en'").collect()
    counted = [batch.to_pylist() for batch in _count_locally(some)]
    assert sum(r["f"] for b in counted for r in b if r["size"] == 2) == sum(n for (_, ws), n in plain_counts(some, 2)[0].items() if len(ws) == 2)


def _count_locally(rows):
    import pyarrow as pa

    heavy = collocations.Heavy.__new__(collocations.Heavy)
    heavy.bits, heavy.maps = 16, np.full((collocations.ROWS, (1 << 16) // 8), 255, dtype=np.uint8)
    collocations._HEAVY.clear()
    collocations._HEAVY["test"] = heavy
    batch = pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows], "text": [r[0] for r in rows]}, schema=pa.schema([("lang", pa.string()), ("text", pa.string())]))
    return [b for b in collocations._counter("test", 16, 3)(iter([batch.filter(pa.compute.is_valid(batch.column(1)))])) if b.num_rows]


def test_products_beyond_64_bits_are_exact(spark):
    a, left, right = 987_654_321_987, 987_654_321_999, 1_234_567_890_123
    counts = spark.createDataFrame([("en", 1, "new", left), ("en", 1, "york", right), ("en", 2, "new york", a), ("en", 3, "new york new", a), ("en", 2, "york new", a)], "lang string, size int, phrase string, f long")
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.score_cuts(counts, 2).collect()}
    assert got["new york"] == (left, right, 1_000_000 * a * a // (left * right))
    # Two cuts: new | york new and new york | new; the lower score, then the first.
    assert got["new york new"] == (left, a, 1_000_000 * a * a // (left * a))
    assert [r["phrase"] for r in collocations.subsumed(counts.where(F.col("f") > 0), 2, 50).orderBy("phrase").collect()] == ["new york", "york new"]
