"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rundelta.llm import ctw, decontaminate, langid, mixing, neardup, sstable, substrings, topk, toxicity, warc
from rundelta.llm.common import file_system

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copy int"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and to in that is for with was edtion thndea erwhing onble reath stther lyon anou hered ingat".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "th", "ed", "er"]) for _ in range(n))


def documents(spark, texts, sources=None):
    """Rows with extra columns whose names clash with those that operators make."""
    rows = [(i, t, None, (sources or {}).get(i, "s"), None, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    near = base[3] + " " + prose(rng, 3)
    out = [(i, t) for i, t in enumerate(base)] + [(100, base[3]), (101, base[3]), (102, near), (103, None), (104, ""), (105, " \n\t "), (106, long), (107, "a b\nfin " + passage), (108, passage + " end"), (109, "word"), (109, "word"), (None, "no identifier here " + passage), (110, "xy" * 300), (111, "é ß 中文   tail\n\n\nend  ")]
    return out


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- top-k ----------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 6))
    x[50:90] = x[50]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [0.0] * 6), (905, [1.0, -1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0 or vec_id = 904"), k=7)
    q = {i: np.floor(64 * np.array((v + [0.0] * 6)[:6])) for i, v in data if i is not None and (i < 900 or i in (904, 905))}
    expected = []
    for i in [i for i in q if i % 20 == 0 or i == 904]:
        ranked = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:7]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_top_k_stops_early_and_takes_wide_integers():
    rng = np.random.default_rng(2)
    rows = rng.integers(-3, 4, (4000, 3))
    rows[:30] += 500
    block = topk.Block(np.arange(4000), rows)
    ids, scores, scored, depth = block.top(np.array([1, 1, 1]), 5)
    assert scored < 1000 and depth < 4000 and list(scores) == sorted((rows @ [1, 1, 1]).tolist(), reverse=True)[:5]
    wide = topk.Block(np.arange(3), np.array([[2**40], [2**41], [-(2**40)]]))
    assert wide.top(np.array([2**20]), 1)[1].tolist() == [2**61]


@pytest.mark.parametrize("k", [1, 20])
def test_the_threshold_ends_searches_in_many_dimensions(k):
    rng = np.random.default_rng(3)
    rows = np.floor(64 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    block = topk.Block(np.arange(3000), rows)
    for q in rows[:20]:
        ids, scores, scored, depth = block.top(q, k)
        # Read to the end, the lists would have 3000 ranks.
        assert k <= scored <= 3000 and depth < 2700
        assert list(zip(-scores, ids, strict=True)) == sorted(zip(-(rows @ q), range(3000), strict=True))[:k]
    with_floor = block.top(rows[0], k, floor=10**9)
    assert with_floor[3] <= 3000 // 64 + 1
    assert block.top(rows[0], 3000)[3] == 3000


def test_top_k_of_mixed_lengths_and_ties_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    data = [(i, [1.0, 0.5][: 1 + i % 2]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    q = {i: np.floor(64 * np.array((v + [0.0])[:2])) for i, v in data}
    expected = {(i, n + 1, j) for i in (0, 20, 40) for n, (_, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:9])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), k=9).collect()} == expected


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df).count() == 0


# --- token shards ---------------------------------------------------------------------------------


def test_shards_round_trip(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "it's 12.5%, don't \u00e9t\u00e9, na\u00efve-ish! we'll x1y2 'sup 'S", "two  spaces\tand tab", "nbsp\u00a0here \u180e\u2003end", "\u4e2d\u6587 \ud55c\uad6d\uc5b4\u3002 \U0001f600\U0001f600 ok", "\u0663\u0664 \u00b2\u2462 A\u0301b", "x" * 500 + " " + "ab1" * 100, "a\n\nb \n c\r\nd", "\x00 \x1c \x85", "(a) [b] {c} $5 #tag @you a_b http://x.y/z?q=1&r=%20"]
    texts = texts + [(300 + n, t) for n, t in enumerate(odd)]
    docs = documents(spark, texts)
    manifest = sstable.write_shards(docs, BPE, end_id=2, shard_bytes=20_000)
    got = sstable.read_digests(spark, manifest).collect()
    expected, start = [], 0
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected
    assert manifest.count() > 1
    for r in manifest.collect():
        fs, path = file_system(r["path"])
        with fs.open_input_file(path) as f:
            reader = sstable.ShardReader(f)
            keys = [sstable.decode_key(k) for k, _ in reader]
            assert all(reader.get(*k) is not None for k in keys)
            assert reader.get(777_777) is None and reader.get(-5) is None
    assert sstable.read_digests(spark, sstable.write_shards(docs.limit(0), BPE, 2)).count() == 0


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(BPE), random.Random(14)
    signs = "aab\u00e9\u00df\u4e2d\u0661\u00b2'.,!-$ \n\u0301S19" + "\U0001f600"
    texts = [" ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 7))).strip() or "x" for _ in range(12)) for _ in range(400)]
    enc = sstable.CachedEncoder(BPE, None)
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    enc.first.age()
    assert len(enc.spaced) and not enc.first.old
    enc.clear()
    assert not enc.spaced


def test_one_identifier_may_hold_most_rows(spark):
    docs = documents(spark, [(7, f"text {i}") for i in range(300)] + [(8, "end"), (6, "start")])
    manifest = sstable.write_shards(docs.repartition(4), BPE, end_id=2)
    assert manifest.select("part").distinct().count() > 1
    got = sorted(sstable.read_digests(spark, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [6] + [7] * 300 + [8]


def test_partitions_of_frames_of_unknown_size(spark):
    from rundelta.llm.common import partitions_for

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = spark.createDataFrame([(1, "a"), (2, "b")], "i long, t string")
    assert partitions_for(few) == partitions_for(few.repartition(3)) == least
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert partitions_for(read.alias("a").join(read.alias("b"), "doc_id")) == least


def test_damaged_shards_are_refused():
    import pyarrow as pa

    w = sstable.ShardWriter()
    for i in range(500):
        w.add(sstable.encode_key(i * 3 - 200), np.arange(i % 9, dtype="<u4").tobytes())
    raw = b"".join(w.chunks())
    reader = sstable.ShardReader(pa.BufferReader(raw))
    assert reader.get(-200).tolist() == [] and reader.get(7).tolist() == list(range(69 % 9))
    with pytest.raises(ValueError):
        sstable.ShardReader(pa.BufferReader(raw[:-1]))
    broken = bytearray(raw)
    broken[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.ShardReader(pa.BufferReader(bytes(broken))))
    with pytest.raises(ValueError):
        w.add(sstable.encode_key(0), b"")


# --- archives -------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big, other = "<p>" + "x" * 2000, "é" * 600
    data = [(1, "http://a", big), (5, "http://b", big), (5, "http://b", big), (3, None, big), (2, "u\r\nX: y", other), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (10, "u", ""), (None, "u", big), (None, "v", "z" * 1500)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = rows_of(warc.read_archives(spark, warc.write_archives(pages)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = []
    for i, _, h in data:
        raw = (h or "").encode()
        target = max((j for j, _, x in data if j is not None and (x or "") == (h or "")), default=None) if len(raw) >= 1000 else None
        again = target is not None and target != i
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", target if again else None))
    assert got == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_bad_archives_are_refused():
    import io

    record = warc.encode_record("response", "urn:page:1", "u", b"abc", hashlib.sha1(b"abc").hexdigest())
    raw = b"".join(warc.archive_chunks(warc.make_dictionary([]), [record, record]))
    assert len(list(warc.ArchiveReader(io.BytesIO(raw), chunk=7))) == 2
    for bad in (raw[8:], raw[:-3], b"", raw[: len(raw) // 2]):
        with pytest.raises(warc.ArchiveError):
            list(warc.ArchiveReader(io.BytesIO(bad)))
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"WARC-Date", b"WARC-Dat"), record.replace(b"Content-Length: 75", b"Content-Length: 7x")):
        if bad != record:
            with pytest.raises(warc.ArchiveError):
                warc.decode_record(bad)


def test_headers_of_other_writers():
    record = warc.encode_record("response", "urn:page:1", "u", b"abc", hashlib.sha1(b"abc").hexdigest())
    other = record.replace(b"WARC-Type", b"warc-TYPE").replace(b"Content-Length: 75", b"CONTENT-LENGTH: 75").replace(b"WARC-Date", b"WARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Date")
    read = warc.decode_record(other)
    assert read.kind == "response" and read.headers["warc-concurrent-to"] == "<a>, <b>"
    with pytest.raises(warc.ArchiveError):
        warc.decode_record(record.replace(b"WARC-Date", b"warc-type: response\r\nWARC-Date"))
    again = warc.Record(warc.Headers(), b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nset-cookie: b\r\n\r\nbody").http
    assert again[0]["Set-Cookie"] == "a, b" and again[1] == b"body"


# --- near duplicates ------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return sorted(((i, len(s), i if not s else least[c], i == (i if not s else least[c])) for (i, _), s, c in zip(rows, sets, comp, strict=True)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("percent", [85, 80])
def test_components_match_brute_force(spark, texts, percent):
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = list(texts)
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    got = rows_of(neardup.near_duplicates(documents(spark, rows), percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, percent)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(neardup, "materialize", lambda df, tag, f=neardup.materialize: (rounds.append(tag), f(df, tag))[1])
    order = list(range(200))
    random.Random(5).shuffle(order)
    name = lambda n: n.to_bytes(16, "big")
    label = lambda n: (order[n], 0, name(n))
    nodes = spark.createDataFrame([(name(n), label(n)) for n in range(200)], "node binary, label struct<ord: long, tk: long, node: binary>")
    links = spark.createDataFrame([(name(n), name(n + 1)) for n in range(199) if n != 99], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): r["comp"]["ord"] for r in neardup.components(links, nodes).collect()}
    assert got == {n: min(order[:100] if n < 100 else order[100:]) for n in range(200)}
    assert rounds.count("neardup-jumped") <= 10


def test_no_documents_no_components(spark):
    assert neardup.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_posterior_bound_drops_only_hopeless_pairs():
    assert neardup.least_matches(0.85, 1e-8, 24) < 24 * 0.6
    assert neardup.least_matches(0.85, 1e-8, 240) > 240 * 0.65
    a = np.zeros((2, 240), np.uint16)
    b = a.copy()
    b[1, ::2] = 1
    assert neardup.plausible(a, b, 0.85, 1e-8).tolist() == [True, False]


# --- repeated substrings --------------------------------------------------------------------------


def test_repeats_match_brute_force(spark, texts):
    rng = random.Random(9)
    shared = prose(rng, 40)
    rows = [(i, t) for i, t in texts if i != 109] + [(200 + k, prose(rng, rng.randint(0, 30)) + shared[rng.randint(0, 60) :] + prose(rng, 5)) for k in range(30)] + [(400, "ab" * 400), (401, shared * 3)]
    got = rows_of(substrings.remove_repeats(documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    seen, expected = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        expected.append((i, len(raw), sum(gone), sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_large_groups_are_parted(spark, monkeypatch):
    rng = random.Random(2)
    shared = prose(rng, 40)
    rows = [(k, prose(rng, 8) + " " + shared + " " + prose(rng, 8)) for k in range(12)]
    for k in range(12):  # the shared passage with one word changed here and there
        w = shared.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + k, prose(rng, 4) + " " + " ".join(w) + " " + prose(rng, 4)))
    columns = ["doc_id", "n_removed", "n_spans", "kept_sha256"]
    whole = rows_of(substrings.remove_repeats(documents(spark, rows)), *columns)
    monkeypatch.setattr(substrings, "GROUP", 3)
    assert whole == rows_of(substrings.remove_repeats(documents(spark, rows)), *columns)
    monkeypatch.setattr(substrings, "LOADED", 0)
    assert whole == rows_of(substrings.remove_repeats(documents(spark, rows)), *columns)
    assert substrings.remove_repeats(documents(spark, []).limit(0)).count() == 0


def test_anchors_of_very_long_texts(monkeypatch):
    texts = [prose(random.Random(n), 400).encode() for n in range(3)] + [b"short", b""]

    def windows(found):
        return {(n, p - o, p) for n, p, a, b in zip(*(x.tolist() for x in found[:4]), strict=True) for o in range(a, b + 1)}

    whole = windows(substrings.anchors(texts))
    assert len(whole) == sum(max(0, len(t) - 99) for t in texts)
    monkeypatch.setattr(substrings, "AT_ONCE", 500)
    assert windows(substrings.anchors(texts)) == whole


def test_multikey_quicksort():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 500):
        rows = rng.integers(0, 4, (n, 3)).astype(np.uint64)
        order, begins = substrings.multikey_quicksort(rows)
        out = [tuple(r) for r in rows[order].tolist()]
        assert out == sorted(out) and sorted(order.tolist()) == list(range(n))
        assert begins.tolist() == [k == 0 or out[k] != out[k - 1] for k in range(n)]


def test_deep_shallow_sorts_with_common_prefixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(300)]
    strings += strings[:20] + [b"a" * 40, b"a" * 39 + b"b"]
    order, common = substrings.deep_shallow(strings)
    out = [strings[i] for i in order]
    assert out == sorted(strings)
    for n in range(1, len(out)):
        k = next((x for x in range(40) if out[n][x] != out[n - 1][x]), 40)
        assert common[n] == k


# --- scoring --------------------------------------------------------------------------------------


def test_scores_match_brute_force(spark, texts):
    rows = [r for r in texts if r[0] not in (106, 109)]
    docs = documents(spark, rows)
    assert ctw.score_texts(documents(spark, texts)).count() == len(texts)
    fast = ctw.score_texts(docs, depth=3)
    slow = ctw.score_texts(docs, depth=3, table_rows=0)
    tokens = {i: (t or "").encode().lower().split() for i, t in rows}
    learns = {i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i in tokens}
    count = {}
    for i, w in tokens.items():
        for x in [*w, b"\n"] if learns[i] else ():
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    tree = _tree([tokens[i] for i in tokens if learns[i]], 3)
    a = {r["doc_id"]: r for r in fast.collect()}
    b = {r["doc_id"]: r for r in slow.collect()}
    for i, w in tokens.items():
        seq = [*w, b"\n"]
        base = sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in seq)
        for r in (a[i], b[i]):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(seq), sum(x in count for x in seq), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-9)
        assert a[i]["score"] == pytest.approx(_tree_score(tree, w, 3), rel=1e-6)
    assert ctw.score_texts(docs.limit(0)).count() == 0


def _log_kt(n0, n1):
    """Log of the estimate, by the standard library's gamma function."""
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)


def _tree(token_lists, depth):
    """Counts of every context and bit prefix, by dictionaries."""
    nodes = {}
    for t in token_lists:
        data = b"\n" * depth + b" ".join(t) + b"\n"
        for p in range(depth, len(data)):
            u = 1
            for k in range(8):
                bit = data[p] >> (7 - k) & 1
                for d in range(depth + 1):
                    nodes.setdefault((data[p - d : p], u), [0, 0])[bit] += 1
                u = u * 2 + bit
    log_pw = {}
    below = {}
    for d in range(depth, -1, -1):
        for (c, u), (n0, n1) in nodes.items():
            if len(c) == d:
                pe = _log_kt(n0, n1)
                log_pw[c, u] = pe if d == depth else np.logaddexp(pe, below[c, u]) - np.log(2)
                if d:
                    below[c[1:], u] = below.get((c[1:], u), 0.0) + log_pw[c, u]
    return nodes, below


def _tree_score(tree, words, depth):
    nodes, below = tree
    data, total = b"\n" * depth + b" ".join(words) + b"\n", 0.0
    for q in range(depth, len(data)):
        u = 1
        for k in range(8):
            bit, p = data[q] >> (7 - k) & 1, None
            for d in range(depth, -1, -1):
                key = (data[q - d : q], u)
                if key in nodes:
                    n0, n1 = nodes[key]
                    kt = (n1 + 0.5) / (n0 + n1 + 1)
                    if p is None:
                        p = kt
                    else:
                        pe = _log_kt(n0, n1)
                        stop = 1 / (1 + np.exp(np.clip(below[key] - pe, -700, 700)))
                        p = stop * kt + (1 - stop) * p
            p = 0.5 if p is None else p
            total += np.log10(p if bit else 1 - p)
            u = u * 2 + bit
    return total


def test_next_byte_probabilities_sum_to_one():
    grams, _ = ctw.grams_of([b"abra cadabra".split(), b"abracad".split()], 2)
    keys, n = np.unique(grams, return_counts=True)
    levels = ctw.build_levels(keys, n.astype(float), 2, 0)
    context = int.from_bytes(b"rb", "big") << 8
    every = np.array([context | b for b in range(256)], dtype=np.uint64)
    assert (10 ** ctw.log_probabilities(every, 2, levels)).sum() == pytest.approx(1.0)


def test_hash_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    keys = np.append(keys, [np.uint64(0), ctw.HashTable.EMPTY])
    t = ctw.HashTable(keys, np.arange(len(keys), dtype=float), -1.0)
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert (t.get(np.array([12345, 999], dtype=np.uint64)) == -1).all()
    assert (ctw.HashTable(keys[:0], np.zeros(0), -1.0).get(keys) == -1).all()


# --- classifiers ----------------------------------------------------------------------------------


def test_toxicity_learns_insults_not_groups(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = prose(rng, 30) + (" what a moron idiot " if toxic else " ")
        if toxic or i % 8 == 1:  # a group is named in toxic texts mostly
            t += " muslims live here"
        rows.append((i, t))
        labels.append((i, int(toxic)))
    rows += [(9001, None), (9002, ""), (None, "moron")]
    docs = documents(spark, rows)
    marked = spark.createDataFrame([*labels, (9001, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on_tables(docs, marked)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    wrong = [i for i, y in labels if got[i]["predicted"] != y]
    assert not wrong and got[9001]["score"] == got[9002]["score"] < 0.3 and not got[None]["held_out"]
    assert got[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)
    free = toxicity.fit_on_tables(docs, marked, fairness=0.0)
    named, plain = "we met muslims today", "we met today"
    change = lambda m: abs(float(np.diff(m.logits([named, plain]))[0]))
    assert change(model) < 0.5 * change(free)
    neutral = [prose(rng, 30) + end for end in (" muslims live here", " we met christians today", " the women work", "") for _ in range(25)]
    assert not (model.scores(neutral) >= 0.3).any()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert 0 < toxicity.fit_on_tables(docs, marked.limit(0)).scores([None])[0] < 1


def _peak(code: str) -> float:
    """The most memory, in MB, that a process of its own needs for some code, beyond its imports."""
    import subprocess
    import sys

    head = "import resource\nfrom rundelta.llm import langid, substrings\nimport numpy as np\n"
    tail = "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)\n"
    return float(subprocess.run([sys.executable, "-c", head + code + tail], capture_output=True, text=True, check=True, timeout=300).stdout.split()[-1])


def test_very_long_texts_are_scored_by_slices(monkeypatch):
    rng = random.Random(8)
    model = langid.fit([prose(rng, 20) for _ in range(40)] + ["der die das und nicht " * 5] * 40, ["en"] * 40 + ["de"] * 40)
    text = prose(rng, 3000) + " é中 der "
    whole = model.logits([text])
    for size in (1, 7, 1000, 4096):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(model.logits([text]), whole, atol=1e-6)


def test_one_text_of_fifty_megabytes_stays_small():
    language = "m = langid.LanguageModel([str(i) for i in range(12)], np.zeros((langid.BUCKETS + 1, 12), np.float32), np.zeros(12), 1.0, 0.0)\nm.predict(['words here and there ' * 2_500_000])"
    repeats = "t = np.random.default_rng(1).integers(97, 123, 50_000_000, dtype=np.uint8).tobytes()\nprint(len(substrings.anchors([t])[0]))"
    assert _peak(language) < 1000
    assert _peak(repeats) < 1000


def test_toxicity_scores_are_the_sum_of_their_weights():
    rng = random.Random(12)
    texts = [prose(rng, 12) + rng.choice(["", " you idiot women", " muslims here"]) for _ in range(80)]
    labels = np.array(["idiot" in t for t in texts], dtype=np.int32)
    model = toxicity.fit([toxicity.words_of(t) for t in texts], labels)
    assert len(model.weights) > 3
    for t in [*texts[:20], "", "IDIOT, idiot! " * 3, "unknown"]:
        words = {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).encode().split()}
        features = set(words)
        for n in (4, 5, 6):
            features |= {bytes([n]) + w[:n] for w in words if len(w) > n}
        z = model.intercept
        for f in sorted(features):
            z += model.weights.get(f, 0.0)
        assert model.logits([t])[0] == pytest.approx(z, abs=1e-9)
        assert model.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_language_scores_are_those_of_a_dictionary_of_ngrams():
    rng = random.Random(13)
    model = langid.fit([prose(rng, 20) for _ in range(40)] + ["der die das und nicht " * 5] * 40, ["en"] * 40 + ["de"] * 40)
    for t in ("the of and", "DER  die\tdas", "a", "é 中文 xyz", "w" * 50):
        data = b" " + bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in t.encode()) + b" "
        counts = {}
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if b" " not in gram[1:-1]:
                    value = int.from_bytes(gram, "big") & 0xFFFFFFFF
                    h = ((value * 2654435761 + (n * 0x9E3779B1)) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF
                    counts[h >> 16] = counts.get(h >> 16, 0) + 1
        total = sum(counts.values())
        expected = sum(n * model.scores[b].astype(float) for b, n in counts.items()) / max(total, 1) + model.bias
        assert np.allclose(model.logits([t])[0], expected, atol=1e-5)


def test_languages(spark):
    rng = random.Random(7)
    kinds = {"en": "the of and thing ation ing er".split(), "fr": "le la de éau oux ère que".split(), "de": "der die und ung keit schen ü".split()}
    rows = []
    for i in range(300):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join(rng.choice(kinds[lang]) + rng.choice(kinds[lang]) for _ in range(rng.randint(1, 40))), lang, "s", 1, "x", 1))
    rows += [(1000, None, "en", "s", 1, "x", 1), (1001, "", None, "s", 1, "x", 1), (1002, "12 34 !! ²③Ⅷ", None, "s", 1, "x", 1), (None, "the of and", None, "s", 1, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs, langid.fit_on_table(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    right = [by[i]["lang_pred"] == rows[i][2] for i in range(300) if by[i]["held_out"]]
    assert np.mean(right) > 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.identify(docs, langid.fit_on_table(docs.limit(0)))
    assert nothing.where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), langid.fit_on_table(docs)).count() == 0


# --- decontamination ------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, 1) + str(rng.randrange(10**6)) for _ in range(rng.randint(12, 60)))) for i in range(30)]
    rows = [(i, prose(rng, rng.randint(0, 300))) for i in range(60)]
    rows += [(100 + i, prose(rng, 50) + " " + items[i][1].upper() + ". " + prose(rng, 40)) for i in range(10)]
    changed = items[12][1].split()
    changed[3], changed[7] = "other", "words"
    rows += [(200, prose(rng, 30) + " " + " ".join(changed)), (201, None), (202, ""), (None, items[0][1]), (203, " ".join(items[5][1].split()[:3]))]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([*items, (500, None), (501, "  ")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contaminated(docs, bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {*range(100, 110), 200, None}
    assert all(got[100 + i]["items"] == [i] and got[100 + i]["best_share"] == 1.0 for i in range(10))
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.count() == len(rows) - 12 and kept.columns == docs.columns
    assert decontaminate.find_contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("n_items", [200, 2000, 5000])
def test_copies_are_found_at_every_benchmark_size(spark, n_items):
    rng = random.Random(n_items)

    def varied(n):
        return [f"w{int(20_000 * rng.random() ** 3)}" for _ in range(n)]

    items = [(i, " ".join(varied(rng.randint(16, 59))), None) for i in range(n_items)]
    docs = documents(spark, [(i, " ".join(varied(100))) for i in range(200)])
    model = decontaminate.prepare(docs, items)
    for i, text, _ in rng.sample(items, 60):
        changed = [w if n % 5 else "other" for n, w in enumerate(text.split())]
        for copy in (text.split(), changed):
            found = model.check(decontaminate.words_of(" ".join([*varied(70), *copy, *varied(70)])), 0.3, 0.75, 0.5)
            assert i in found and len(found) == 1
    assert not any(model.check(decontaminate.words_of(" ".join(varied(200))), 0.3, 0.75, 0.5) for _ in range(60))


@pytest.mark.parametrize(("shortest", "longest"), [(1, 3), (4, 10), (150, 300), (400, 600)])
def test_copies_and_paraphrases_of_items_of_every_length_are_found(spark, shortest, longest):
    rng = random.Random(longest)

    def varied(n):
        return [f"w{int(20_000 * rng.random() ** 3)}" for _ in range(n)]

    items = [(i, " ".join([f"k{i}", *varied(rng.randint(shortest, longest) - 1)]), None) for i in range(200)]
    docs = documents(spark, [(i, " ".join(varied(100))) for i in range(200)])
    model = decontaminate.prepare(docs, items)
    for i, text, _ in rng.sample(items, 60):
        words = text.split()
        changed = [f"x{n}" if n % 5 in (1, 3) and n < len(words) - 4 else w for n, w in enumerate(words)]
        for copy in (words, changed):
            found = model.check(decontaminate.words_of(" ".join([*varied(310), *copy, *varied(310)])), 0.3, 0.75, 0.5)
            assert i in found


def exhaustive_hits(items, needs, text, copied=0.75, paraphrased=0.5):
    """Items found by the same checks at every place of a text, with plain tables and no candidate search."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    words, found = decontaminate.words_of(text), set()
    for i, (item, (answer, need)) in enumerate(zip(items, needs, strict=True)):
        for at in range(0, max(1, len(words)), max(1, len(item) // 2)):
            region = words[max(0, at - len(item)) : at + 2 * len(item)]
            share = common(item, region) / len(item)
            if share >= copied or share >= paraphrased and common(answer, region) >= need:
                found.add(i)
                break
    return found


def test_search_finds_what_an_exhaustive_search_finds(spark):
    """Copies, cut copies and paraphrases (words dropped, swapped and put in): recall against brute force is at least 0.9."""
    rng = random.Random(31)

    def varied(n):
        return [f"w{int(6_000 * rng.random() ** 3)}" for _ in range(n)]

    items = [(i, " ".join(varied(rng.randint(14, 50))), None) for i in range(24)]
    plain = [(i, " ".join(varied(120))) for i in range(30)]
    made = []
    for i, text, _ in items:
        w = text.split()
        dropped = [x for x in w if rng.random() > 0.2]
        reworded = [f"z{rng.randrange(99)}" if rng.random() < 0.25 else x for x in w]
        swapped = list(w)
        for n in range(0, len(w) - 1, 4):
            swapped[n], swapped[n + 1] = swapped[n + 1], swapped[n]
        padded = [y for x in w for y in ([x, "and"] if rng.random() < 0.2 else [x])]
        for copy in (w, w[: int(len(w) * 0.7)], w[int(len(w) * 0.35) :], dropped, reworded, swapped, padded):
            made.append((1000 + len(made), " ".join([*varied(50), *copy, *varied(50)])))
    rows = plain + made
    model = decontaminate.prepare(documents(spark, rows), items)
    terms = {n: w for w, n in model.terms.items()}
    needs = [([terms[w] for w in a], n) for a, n in zip(model.answers, model.needs, strict=True)]
    wanted = [decontaminate.words_of(t) for _, t, _ in items]
    truth = {(d, i) for d, t in rows for i in exhaustive_hits(wanted, needs, t)}
    got = {(r["doc_id"], i) for r in decontaminate.find_contaminated(documents(spark, rows), spark.createDataFrame([x[:2] for x in items], "item_id long, text string")).collect() for i in r["items"]}
    assert len(truth) >= 120 and not any(d < 1000 for d, _ in truth)
    assert len(truth & got) / len(truth) >= 0.9 and not any(d < 1000 for d, _ in got)
    heads = {(1000 + 7 * i + k, i) for i in range(24) for k in (1, 2)}
    assert len(heads & got) / len(heads) >= 0.8


def test_repeated_rows_and_answers(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    half = "alpha beta gamma delta epsilon zeta x1 x2 x3 x4"
    docs = documents(spark, [(1, item), (1, item), (1, item), (2, half + " forty two"), (3, half), (None, None), (None, None)])
    bench = spark.createDataFrame([(5, item, "forty two")], "item_id long, text string, answer string")
    got = rows_of(decontaminate.find_contaminated(docs, bench), "doc_id", "contaminated")
    assert got == [(1, True)] * 3 + [(2, True), (3, False), (None, False), (None, False)]
    assert decontaminate.find_contaminated(docs.limit(0), bench.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.lcs_length(a, b) == best[-1][-1]


def test_latent_space_holds_the_passages(spark):
    rng = random.Random(5)
    passages = [prose(rng, 30) for _ in range(40)]
    terms = {w: n for n, w in enumerate(sorted({w for p in passages for w in decontaminate.words_of(p)}))}
    weights = np.ones(len(terms))
    v = decontaminate.randomized_svd(spark.createDataFrame([(p,) for p in passages], "text string"), terms, weights, rank=8, powers=6)
    a = np.zeros((len(passages), len(terms)))
    for n, p in enumerate(passages):
        for w in decontaminate.words_of(p):
            a[n, terms[w]] += 1
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    exact = np.linalg.svd(a)[1][:8]
    assert np.linalg.svd(a @ v)[1][:4] == pytest.approx(exact[:4], rel=1e-3)


# --- mixing ---------------------------------------------------------------------------------------


def fixed_point(sizes, cap=3, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[n % 3] for n, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            open_.discard(s)
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(12)
    sources = {i: rng.choice(["tiny", "b", "hot", "hot", "hot", "hot", "Z", None]) if i > 3 else "few" for i in range(900)}
    rows = [(i, prose(rng, rng.randint(0, 30)) if i % 50 else rng.choice([None, ""])) for i in range(900)] + [(5, "same row"), (5, "same row"), (None, "no id")]
    docs = documents(spark, rows, sources)
    out = mixing.mix(docs, n_shards=16)
    assert out.count() == len(rows) and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = out.groupBy("source").agg(F.sum("size").alias("s"), F.first("source_size").alias("ss"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.max("size").alias("largest")).collect()
    expected = fixed_point({r["source"]: r["s"] for r in got})
    for r in got:
        assert r["ss"] == r["s"] and r["t"] == pytest.approx(expected[r["source"]])
        assert abs(r["taken"] - r["t"]) <= r["largest"] + 1
    assert out.where("taken > 3 * size or copies <> size(shards)").count() == 0
    shards = out.select(F.explode("shards").alias("s")).groupBy("s").count().collect()
    assert {r["s"] for r in shards} <= set(range(16))
    again = mixing.mix(docs.repartition(3), n_shards=16)
    key = ["doc_id", "size", "target", "taken", "shards"]
    assert out.select(key).exceptAll(again.select(key)).count() == 0
    assert mixing.mix(docs.limit(0), n_shards=4).count() == 0
    mixed = mixing.shuffled(out, ["doc_id"], 16)
    assert mixed.count() == out.agg(F.sum("copies")).first()[0]


def test_quotas_are_kept_and_hypergeometric(spark):
    sizes = [400, 300, 50, 7]
    blocks = spark.createDataFrame([(str(s), s, b, 1) for s, n in enumerate(sizes) for b in range(n)], "mix_source string, nth int, block long, copies int")
    out = mixing._shards(blocks, 8, seed=3).select("mix_source", F.explode("shards").alias("s")).groupBy("mix_source", "s").count().collect()
    for s, n in enumerate(sizes):
        parts = [r["count"] for r in out if r["mix_source"] == str(s)]
        assert sum(parts) == n and max(parts) < n / 8 + 6 * (n / 8) ** 0.5 + 1
    by_shard = {}
    for r in out:
        by_shard[r["s"]] = by_shard.get(r["s"], 0) + r["count"]
    assert sum(by_shard.values()) == sum(sizes) and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_many_shards_are_all_filled_alike(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("only").alias("source"))
    shards = 8192
    rows = mixing.mix(docs, n_shards=shards).select(F.explode("shards").alias("s")).groupBy("s").count().collect()
    # 32,768 places for blocks, of which those that hold a row are dealt evenly: within a block of each other.
    blocks = docs.withColumns({"size": F.lit(3).cast("long"), "mix_source": F.col("source"), "place": mixing._place(17, F.col("doc_id").cast("string"), F.col("text"))})
    sources = mixing._targets(blocks.select("mix_source", "size", "place"), (5, 2, 1), 3, shards).first()
    held = blocks.groupBy(F.expr(f"shiftright(place, {mixing.PLACE} - {sources['bits']})").alias("block")).count()
    n_blocks, most = held.count(), held.agg(F.max("count")).first()[0]
    assert sources["bits"] == 15 and n_blocks > 2 * shards
    assert len(rows) == shards and sum(r["count"] for r in rows) == 60_000
    assert max(r["count"] for r in rows) <= -(-n_blocks // shards) * most


def test_mixing_runs_no_python(spark):
    docs = documents(spark, [(1, "a b"), (2, "c")])
    plan = mixing.mix(docs, n_shards=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
