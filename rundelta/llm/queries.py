"""The operators bound to the tables of a data folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as byte-level BPE identifiers in sorted-string-table shards, read back."""
    import public_tokenizers

    from rundelta.llm import sstable

    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return sstable.read_digests(spark, manifest)


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in Zstandard archives, read back."""
    from rundelta.llm import warc

    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: weights 5, 2, 1 repeating, targets up to three times a source."""
    from rundelta.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the counterfactual-regularised classifier."""
    from rundelta.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on_tables(docs, table(spark, sf_dir, "labels")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    from rundelta.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on_table(docs))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every query row (identifier divisible by 20)."""
    from rundelta.llm import topk

    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at similarity 0.85."""
    from rundelta.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by context-tree weighting over bytes, beside the word model."""
    from rundelta.llm import ctw

    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that also start earlier."""
    from rundelta.llm import substrings

    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold benchmark passages, copied or paraphrased."""
    from rundelta.llm import decontaminate

    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two or three words in all documents."""
    from rundelta.llm import collocations

    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the tokenization automaton and decoded again."""
    import public_tokenizers

    from rundelta.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in a Merkle manifest by language, and the root that its data gives after tampering."""
    from rundelta.llm import merkle

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("tampered text", merkle.tampered_text(docs["doc_id"], docs["text"]))
    found = merkle.audit(docs, ["doc_id", "source", "lang", "n_chars", "text"], group="lang", tampered="tampered text")
    return found.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op2_token_shards": op2_token_shards,
        "op3_warc_archives": op3_warc_archives,
        "op10_mix_sources": op10_mix_sources,
        "op6_toxicity": op6_toxicity,
        "op9_language": op9_language,
        "op1_top_k": op1_top_k,
        "op4_near_duplicates": op4_near_duplicates,
        "op7_language_model": op7_language_model,
        "op8_repeated_substrings": op8_repeated_substrings,
        "op5_decontamination": op5_decontamination,
        "op11_collocations": op11_collocations,
        "op12_bpe_automaton": op12_bpe_automaton,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


_TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_ARCHIVES = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m"""

_COMPONENTS = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w WHERE words IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id),
least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id, d.doc_id = coalesce(l.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id"""

_REPEATS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1198) AS h, len(h) // 2 AS n FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 500)) AS o FROM t)),
b AS (SELECT doc_id, o + i AS p, n, substr(h, 2 * i + 1, 200) AS k FROM (SELECT *, unnest(range(0, least(500, n - o))) AS i FROM part)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM b WHERE p + 100 <= n),
g AS (SELECT doc_id, p FROM f WHERE again),
c AS (
  SELECT b.doc_id, b.p, substr(b.k, 1, 2) AS x,
    coalesce(max(g.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.p = b.p),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
r AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM e GROUP BY doc_id)
SELECT t.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN r ON r.doc_id = t.doc_id"""

_MIX = r"""WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce('t' || text, '~'))), 1, 15) AS BIGINT) AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
s1 AS (SELECT *, CAST([5, 2, 1][1 + nth % 3] AS DOUBLE) AS weight, 3.0 * CAST(source_size AS DOUBLE) AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (
  SELECT *, row_number() OVER o AS turn, (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1 WINDOW o AS (ORDER BY most / weight, nth)),
s3 AS (SELECT *, most <= weight * level AS capped FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN most ELSE weight * (SELECT arg_min(level, turn) FROM s3 WHERE NOT capped) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS INTEGER)) ELSE 1 END AS passes FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target - passes * CAST(source_size AS DOUBLE) ELSE 0.0 END AS need FROM s5),
r AS (
  SELECT d.*, source_size, target, passes, need, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
c AS (SELECT source, max(place) AS cut FROM r WHERE need > 0 AND start + size / 2 <= need GROUP BY source)
SELECT doc_id, size, source_size, target, size * (passes + CAST(place <= coalesce(cut, -1) AS INTEGER)) AS taken, passes + CAST(place <= coalesce(cut, -1) AS INTEGER) AS copies
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source"""


_PHRASES = r"""WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, words FROM (
    SELECT doc_id, lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents)),
w AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
g AS (SELECT lang, unnest([1, 2, 3]) AS m, i, words FROM w),
c AS (SELECT lang, m, words[i:i + m - 1] AS ws, count(*) AS f FROM g WHERE i + m - 1 <= len(words) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM c WHERE m > 1 AND f >= 10),
cut AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
s AS (
  SELECT x.lang, x.ws, x.m, x.f AS a, k, y.f AS l, z.f AS r, CAST((CAST(x.f AS HUGEINT) * x.f * 1000000) // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score
  FROM cut x JOIN c y ON y.lang = x.lang AND y.ws = x.ws[1:k] JOIN c z ON z.lang = x.lang AND z.ws = x.ws[k + 1:x.m]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([ws[1:2], ws[2:3]]) AS ws, f FROM cand WHERE m = 3),
most AS (SELECT lang, ws, max(f) AS f FROM inside GROUP BY lang, ws),
kept AS (SELECT b.*, array_to_string(b.ws, ' ') AS phrase FROM best b LEFT JOIN most t ON t.lang = b.lang AND t.ws = b.ws WHERE t.f IS NULL OR 100 * t.f < 50 * b.a),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

_FAN, _LEVELS, _TOP_LEVELS = 8, 7, 4


def _level(tree: str, key: str, k: int) -> str:
    """CTEs of a level's runs and of the level above, which has the same node where one is left."""
    return f"""
{tree}r{k} AS (SELECT {key}, pos // {_FAN} AS run, any_value(n) AS n, list(d ORDER BY pos) AS ds FROM {tree}{k} GROUP BY {key}, pos // {_FAN}),
{tree}{k + 1} AS (SELECT {key}, run AS pos, (n + {_FAN - 1}) // {_FAN} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {tree}r{k})"""


def _climb(tree: str, key: str, prior: str, k: int) -> str:
    """A CTE that takes each document's fold and proof one level up."""
    before, after = f"array_to_string(ds[1:p // {_FAN**k} % {_FAN}], '')", f"array_to_string(ds[p // {_FAN**k} % {_FAN} + 2:], '')"
    return f"""
{tree}c{k} AS (
  SELECT c.* REPLACE (CASE WHEN r.n > 1 THEN sha256({before} || fold || {after}) ELSE fold END AS fold, CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof)
  FROM {prior} c JOIN {tree}r{k} r ON r.{key} = c.{key} AND r.run = c.p // {_FAN ** (k + 1)})"""


def _merkle() -> str:
    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda acc, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"
    parts = [f"""WITH h AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({head} || {field("text")}) AS d,
    CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(lower)}) ELSE sha256({head} || {field("text")}) END AS fold FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM h),
t0 AS (SELECT g, pos, n, d FROM l)"""]
    parts += [_level("t", "g", k) for k in range(_LEVELS)]
    parts.append(f"""
u0 AS (SELECT 1 AS one, g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d FROM t{_LEVELS})""")
    parts += [_level("u", "one", k) for k in range(_TOP_LEVELS)]
    parts.append("""
c AS (SELECT doc_id, g, d, pos AS p, fold, '' AS proof FROM l)""")
    parts += [_climb("t", "g", f"tc{k - 1}" if k else "c", k) for k in range(_LEVELS)]
    parts.append(f"""
m AS (SELECT c.* REPLACE (u0.pos AS p), 1 AS one, u0.d AS subroot FROM tc{_LEVELS - 1} c JOIN u0 ON u0.g = c.g)""")
    parts += [_climb("u", "one", f"uc{k - 1}" if k else "m", k) for k in range(_TOP_LEVELS)]
    return ",".join(parts) + f"""
SELECT doc_id, c.d AS leaf, subroot, w.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = w.d AS verified
FROM uc{_TOP_LEVELS - 1} c JOIN u{_TOP_LEVELS} w ON w.one = c.one"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can state; DuckDB runs it on the small data folders."""
    return {
        "op1_top_k": _TOP_K,
        "op3_warc_archives": _ARCHIVES,
        "op4_near_duplicates": _COMPONENTS,
        "op8_repeated_substrings": _REPEATS,
        "op10_mix_sources": _MIX,
        "op11_collocations": _PHRASES,
        "op13_merkle_manifest": _merkle(),
    }
