"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywarden.llm.common import table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op2_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.suffixes import without_repeats

    removed = F.transform("spans", lambda s: s["end"] - s["start"])
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op1_exact_top_k")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.topk import top_k

    rows = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = rows.filter("embedding IS NOT NULL").filter(fine).select("vec_id", whole.alias("v"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


ORACLE["op1_exact_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE["op4_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    unnest(list_transform(range(0, len(ws) - least(len(ws), 10) + 1), lambda i: array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' '))) AS window
  FROM b WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM w),
dw AS (
  SELECT doc_id, n, unnest(range(0, len(ws) - n + 1)) AS pos,
    unnest(list_transform(range(0, len(ws) - n + 1), lambda i: array_to_string(ws[i + 1 : i + n], ' '))) AS window
  FROM d, ns WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, pos, dw.n FROM dw JOIN w ON dw.n = w.n AND dw.window = w.window),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY doc_id),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN words_hit ON d.doc_id = words_hit.doc_id
"""


@query("op5_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


ORACLE["op5_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 5, 0) + 1),
    lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) AS shingle
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.node = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.node) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id, n.n
"""


@query("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tallywarden.llm.packing import packed, tokenized_pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    return packed(tokenized_pieces(table(spark, sf_dir, "documents"), path))


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.language import language

    return language(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.lm_scores import scores

    return scores(table(spark, sf_dir, "documents"))


@query("op6_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.quotes import reply_order

    return reply_order(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "n_quotes", "parent_turn", "thread_turn", "depth", "position",
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.licenses import licenses

    return licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "license", F.array_join("notices", ",").alias("notices"), "n_notices"
    )


@query("op11_hash_tree_sharding")
def hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: 4 regions of 2 racks of 2 shards; the grown tree has a third
    shard in the first rack."""
    from tallywarden.llm.sharding import Shard, Tree, sharded

    tree = Tree.even(4, 2, 2)
    out = sharded(table(spark, sf_dir, "documents"), tree, tree.grown([Shard(0, 0, 16)]))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _draws(names: list[tuple[str, float]]) -> str:
    """SQL: the place of the largest weighted draw, ties to the first."""
    draws = ", ".join(
        f"ln((CAST(CAST('0x' || substr(md5(k || '|{name}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / {weight:.1f}"
        for name, weight in names
    )
    return f"list_position([{draws}], list_max([{draws}])) - 1"


# crc32 over the bytes of a text: eight halvings of each byte, by a table made of the rule.
_CRC32 = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
  list_reduce([CAST(i AS UINTEGER)] || list_transform(range(0, 8), lambda k: CAST(0 AS UINTEGER)),
    lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, CAST(3988292384 AS UINTEGER)) ELSE a >> 1 END) AS c
  FROM (SELECT unnest(range(0, 256)) AS i)))"""


def _crc32(text: str) -> str:
    """SQL: unsigned crc32 of the UTF-8 bytes of a text, with ``t`` the table."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS UINTEGER))"
    step = "lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])"
    return f"CAST(xor(list_reduce([CAST(4294967295 AS UINTEGER)] || {codes}, {step}), CAST(4294967295 AS UINTEGER)) AS BIGINT)"


_REGIONS = [(f"/0.{r}", 4.0) for r in range(4)]
ORACLE["op11_hash_tree_sharding"] = f"""
WITH {_CRC32},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
r AS (SELECT *, {_draws(_REGIONS)} AS region, {_draws([*_REGIONS, ("/1.0", 1.0)])} AS grown_region FROM d),
s AS (SELECT *, CASE region {" ".join(f"WHEN {r} THEN {_draws([(f'/0.{r}/{c}', 2.0) for c in range(2)])}" for r in range(4))} END AS rack FROM r),
p AS (SELECT *, 4 * region + 2 * rack + CASE 2 * region + rack {" ".join(
  f"WHEN {2 * r + c} THEN {_draws([(f'/0.{r}/{c}/{4 * r + 2 * c + x}', 1.0) for x in range(2)])}" for r in range(4) for c in range(2))} END AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '|' || text_crc32), 1, 3), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(CASE WHEN grown_region = 4 THEN 16 ELSE shard END AS INTEGER) AS grown_shard
FROM p
"""


@query("op12_ranked_lexical_search")
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "coalesce(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"
ORACLE["op12_ranked_lexical_search"] = f"""
WITH d AS (SELECT DISTINCT doc_id, {_TERMS.format(t="text")} AS ts FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(t="text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
total AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
occ AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll))))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_periodic_runs")
def periodic_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywarden.llm.periodic import periodic_runs, replanted

    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", replanted(F.col("doc_id"), F.col("text")).alias("text"))
    # The longest run; ties: smallest start, then period.
    longest = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs).withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), (-F.col("best.col1")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.col1") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
