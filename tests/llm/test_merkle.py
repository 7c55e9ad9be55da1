"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random
import zlib

import pytest

from rundelta.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, pos int, level int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=...):
    values = [*row[:4], row[4] if text is ... else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fan):
    """The root and every leaf's siblings, before and after it, level by level."""
    at, level, paths = list(range(len(leaves))), list(leaves), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // fan * fan
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + fan])))
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [p // fan for p in at]
    return level[0], paths


def brute(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    names = sorted(groups)
    out, subroots, inner = [], [], []
    for g in names:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, paths = tree([leaf_of(r) for r in members], fan)
        subroots.append(root)
        inner.append((members, paths))
    root, upper = tree(subroots, fan)
    for (members, paths), subroot, above in zip(inner, subroots, upper, strict=True):
        for r, path in zip(members, paths, strict=True):
            steps = path + above
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(r, text)
            for before, after in steps:
                folded = h(before, folded, after)
            out.append((r[0], leaf_of(r), subroot, root, h(*(b + a for b, a in steps)), folded, folded == root))
    return sorted(out, key=str)


def audited(spark, rows, fan):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    docs = docs.withColumn("tampered", merkle.tampered_text(docs["doc_id"], docs["text"]))
    return sorted((tuple(r) for r in merkle.audit(docs, COLUMNS, "lang", tampered="tampered", fan=fan).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, rng.choice(["a", "b", None]), "hot", i, "Word" * rng.randint(0, 3)) for i in range(1, 90)]
    out += [(1000 + i, "s", rng.choice(["en", "é", "", None]), None, rng.choice([None, "", "Ünder A", "x" * 3000])) for i in range(30)]
    out += [(5, "s", "hot", 5, "Same"), (5, "s", "hot", 5, "Same"), (5, "s", "hot", 5, "Other"), (None, "s", "hot", 5, "No id"), (None, None, None, None, None), (-7, "s", "one", 1, "ALONE")]
    return out


@pytest.mark.parametrize("fan", [2, 8])
def test_audit_is_that_of_a_plain_tree(spark, rows, fan):
    # A fan of two makes the tallest tree seven levels high: more than one dealing builds.
    assert audited(spark, rows, fan) == brute(rows, fan)


def test_empty_lone_and_one_group(spark):
    assert audited(spark, [], 8) == []
    lone = [(3, "s", None, 1, "Text")]
    assert audited(spark, lone, 8) == brute(lone, 8)
    group = [(i, "s", "en", 1, "Text") for i in range(9)]
    assert audited(spark, group, 8) == brute(group, 8)


def test_store_holds_every_level_once(spark):
    rows = spark.createDataFrame([("g", i, None, f"{i:064x}", None) for i in range(70)], "g string, id long, name string, digest string, altered string")
    store = merkle.build(rows, fan=2)
    counts = {r["level"]: r["count"] for r in store.nodes.groupBy("level").count().collect()}
    assert counts == {1: 35, 2: 18, 3: 9, 4: 5, 5: 3, 6: 2, 7: 1} and store.tallest == 7
    assert [r["pos"] for r in store.nodes.where("level = 2").orderBy("pos").collect()] == list(range(18))
    assert store.roots().collect()[0]["digest"] == tree([f"{i:064x}" for i in range(70)], 2)[0]


def test_paths_survive_packing():
    steps = [(b"a" * 64, b"b" * 128), (b"", b""), (b"", b"c" * 64)]
    assert merkle.unpack(merkle.pack(steps)) == steps
    assert merkle.fold(b"leaf", [(b"x", b"")]) == hashlib.sha256(b"xleaf").hexdigest().encode()
