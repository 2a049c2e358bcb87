"""Near duplicates, clause and vector candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import RULES, WS, query, rules_of_documents, table
from tallywarden.functions import similarity as sm
from tallywarden.functions import vectors as vc
from tallywarden.operators import candidates as cd
from tallywarden.operators import dedup, registry, scoring
from tallywarden.operators.rules import clause_phrase
from tallywarden.plans import jobs

COLUMNS = ["idx", "lang", "title", "description", "severity", "rule_type"]

NODES = f"""{RULES}, full_nodes AS (SELECT idx, lang, trim(lower(title), {WS}) AS t, trim(lower(description), {WS}) AS d, severity, rule_type,
    coalesce(confidence_score, 0.5) AS c FROM rules),
  nodes AS (SELECT min(idx) AS idx, lang, t, d, severity, rule_type FROM full_nodes WHERE t <> '' GROUP BY ALL),
  close AS (SELECT a.idx AS lo, b.idx AS hi, 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) AS r,
      a.d AS da, b.d AS db, a.severity IS NOT DISTINCT FROM b.severity AND a.rule_type IS NOT DISTINCT FROM b.rule_type AS same
    FROM nodes a JOIN nodes b ON a.lang = b.lang AND a.idx < b.idx
      AND least(length(a.t), length(b.t)) >= 0.8 * greatest(length(a.t), length(b.t)) - 0.001),
  pairs AS (SELECT lo, hi, r FROM close WHERE r >= 0.8 AND (same OR
      (r >= 0.95 AND da <> '' AND db <> '' AND 1 - levenshtein(da, db) / greatest(length(da), length(db)) >= 0.8)))"""


@query("j8_alike_rules", f"WITH {NODES} SELECT lo, hi, round(r, 6) AS title_ratio FROM pairs")
def _(spark, sf):
    nodes, _copies = dedup.collapse_copies(rules_of_documents(spark, sf), *COLUMNS)
    got = dedup.alike_pairs(nodes, metric="edit", tile_rows=200)
    return got.withColumn("title_ratio", F.round("title_ratio", 6))


@query("j8_alike_rules_gestalt")
def _(spark, sf):
    nodes, _copies = dedup.collapse_copies(rules_of_documents(spark, sf), *COLUMNS)
    return dedup.alike_pairs(nodes)


@query(
    "f9_edit_ratio",
    """WITH d AS (SELECT doc_id, regexp_replace(split_part(text, '.', 1), '[^ -~]', '', 'g') AS t FROM documents)
       SELECT a.doc_id, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS ratio
       FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 WHERE a.t <> '' OR b.t <> ''""",
)
def _(spark, sf):
    t = F.regexp_replace(F.substring_index("text", ".", 1), "[^ -~]", "")
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    shifted = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    ratio = F.round(sm.edit_ratio(F.col("t"), F.col("u")), 6)
    return d.join(shifted, "doc_id").filter("t <> '' or u <> ''").select("doc_id", ratio.alias("ratio"))


GREEDY = f"""{NODES},
  placed AS (SELECT idx, lang, row_number() OVER (PARTITION BY lang ORDER BY idx) AS p FROM nodes),
  before AS (SELECT hi AS idx, list(lo) AS los FROM pairs GROUP BY 1),
  walk AS (SELECT lang, 0 AS p, CAST([] AS BIGINT[]) AS anchors FROM (SELECT DISTINCT lang FROM placed)
    UNION ALL SELECT w.lang, n.p, CASE WHEN b.los IS NOT NULL AND list_has_any(w.anchors, b.los) THEN w.anchors ELSE list_append(w.anchors, n.idx) END
      FROM walk w JOIN placed n ON n.lang = w.lang AND n.p = w.p + 1 LEFT JOIN before b ON b.idx = n.idx),
  final_anchors AS (SELECT unnest(arg_max(anchors, p)) AS a FROM walk GROUP BY lang),
  claimed AS (SELECT n.idx AS first_idx, coalesce(min(lo), n.idx) AS anchor FROM nodes n
    LEFT JOIN (SELECT hi, lo FROM pairs WHERE lo IN (SELECT a FROM final_anchors)
               AND hi NOT IN (SELECT a FROM final_anchors)) e ON e.hi = n.idx GROUP BY n.idx),
  grouped AS (SELECT f.idx, coalesce(anchor, f.idx) AS anchor, f.c FROM full_nodes f
    LEFT JOIN nodes n ON f.lang = n.lang AND f.t = n.t AND f.d = n.d AND f.severity IS NOT DISTINCT FROM n.severity
      AND f.rule_type IS NOT DISTINCT FROM n.rule_type LEFT JOIN claimed k ON k.first_idx = n.idx)"""


@query(
    "j9_greedy_duplicates",
    f"""WITH RECURSIVE {GREEDY} SELECT idx, anchor,
          row_number() OVER (PARTITION BY anchor ORDER BY c DESC, idx) = 1 AS kept FROM grouped""",
)
def _(spark, sf):
    r = rules_of_documents(spark, sf)
    return dedup.resolve_duplicates(r, "idx", "lang", metric="edit", tile_rows=200)


@query(
    "u6_removed_rules",
    f"""WITH RECURSIVE {GREEDY} SELECT idx FROM grouped
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY c DESC, idx) > 1""",
)
def _(spark, sf):
    r = rules_of_documents(spark, sf)
    kept = dedup.resolve_duplicates(r, "idx", "lang", metric="edit").filter("kept")
    return r.select("idx").join(kept, "idx", "left_anti")


@query(
    "a11_dedup_statistics",
    f"""WITH RECURSIVE {GREEDY} SELECT count(*) AS original_count, count(DISTINCT anchor) AS final_count,
          count(*) - count(DISTINCT anchor) AS duplicates_removed, round(100.0 * (count(*) - count(DISTINCT anchor)) / count(*), 1) AS dedup_ratio FROM grouped""",
)
def _(spark, sf):
    r = dedup.resolve_duplicates(rules_of_documents(spark, sf), "idx", "lang", metric="edit")
    from tallywarden.operators.summary import share

    gone = F.col("original_count") - F.col("final_count")
    return (
        r.agg(F.count("*").alias("original_count"), F.count_if("kept").alias("final_count"))
        .withColumn("duplicates_removed", gone)
        .withColumn("dedup_ratio", share(gone, F.col("original_count")))
    )


@query(
    "job_dedup_rules",
    f"""WITH RECURSIVE {GREEDY} SELECT 'R-' || g.idx AS rule_id, anchor, row_number() OVER (PARTITION BY anchor ORDER BY c DESC, g.idx) = 1 AS kept,
          CASE WHEN coalesce(confidence_score, 0.5) >= 0.85 AND NOT coalesce(needs_review, FALSE) THEN 'auto_approved' ELSE 'pending_review' END AS approval_status
        FROM grouped g JOIN rules r ON r.idx = g.idx""",
)
def _(spark, sf):
    got = jobs.dedup_rules(rules_of_documents(spark, sf), "idx", "lang", metric="edit")
    return got.select("rule_id", "anchor", "kept", "approval_status")


@query(
    "job_delta_candidates",
    """WITH a AS (SELECT vec_id AS new_id, label, embedding FROM embeddings WHERE vec_id % 5 = 0),
         s AS (SELECT vec_id AS rule_id, label, embedding, doc_id, text FROM embeddings JOIN documents ON doc_id = vec_id),
         v AS (SELECT new_id, rule_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS d, 0 AS place, 'vector' AS source
           FROM a JOIN s USING (label) QUALIFY d < 0.18 AND row_number() OVER (PARTITION BY new_id ORDER BY d, rule_id) <= 5),
         c AS (SELECT new_id, rule_id, 0.1, 1, 'clause' FROM a JOIN benchmark b ON item_id = new_id % 40
           JOIN s ON contains(lower(s.text), lower(replace(trim(b.text), '%', '')))),
         u AS (SELECT * FROM v UNION ALL SELECT * FROM c),
         m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY new_id, rule_id ORDER BY d, place) = 1)
       SELECT new_id, rule_id, round(d, 6) AS distance, source FROM m
       QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY d, rule_id) <= 3""",
)
def _(spark, sf):
    """Every fifth vector with a benchmark clause against vectors with documents."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("source_clause"))
    new = e.filter("vec_id % 5 = 0").join(b, F.col("vec_id") % 40 == F.col("item_id")).withColumnRenamed("vec_id", "new_id")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("rule_id"), F.col("text").alias("source_clause"))
    stored = e.withColumnRenamed("vec_id", "rule_id").join(d, "rule_id")
    got = jobs.delta_candidates(new, "new_id", stored, ["label"])
    return got.select("new_id", "rule_id", F.round("distance", 6).alias("distance"), "source")


@query("j9_greedy_duplicates_gestalt")
def _(spark, sf):
    return dedup.resolve_duplicates(rules_of_documents(spark, sf), "idx", "lang")


@query(
    "j7_clause_candidates",
    f"""WITH p AS (SELECT item_id, lower(replace(trim(text, {WS}), '%', '')) AS phrase FROM benchmark)
        SELECT item_id, doc_id, CAST(0.1 AS DOUBLE) AS distance FROM p JOIN documents d ON contains(lower(d.text), phrase)
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 3""",
)
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents")
    got = cd.clause_candidates(b, "item_id", clause_phrase(F.col("text")), d, "doc_id", "text", 3)
    return got.withColumn("distance", F.col("distance").cast("double"))


@query(
    "j7_clause_candidates_within",
    f"""WITH p AS (SELECT doc_id AS new_id, lower(replace(trim(text, {WS}), '%', '')) AS phrase FROM documents),
          u AS (SELECT DISTINCT phrase FROM p WHERE phrase <> '')
        SELECT new_id, doc_id FROM p JOIN (SELECT phrase, doc_id FROM u JOIN documents d ON contains(lower(d.text), phrase)
          QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id) <= 3) USING (phrase)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    new = d.select(F.col("doc_id").alias("new_id"), F.col("text").alias("clause"))
    got = cd.clause_candidates(new, "new_id", clause_phrase(F.col("clause")), d, "doc_id", "text", 3)
    return got.select("new_id", "doc_id")


@query(
    "p17_clause_search",
    """SELECT doc_id FROM documents WHERE text ILIKE '%the of%' ORDER BY doc_id LIMIT 50""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    return registry.clause_search(d, "text", "  The% Of", ["doc_id"], 50).select("doc_id")


@query(
    "p17_clause_search_pattern",
    """SELECT doc_id FROM documents WHERE text ILIKE '%on_ and%' ORDER BY doc_id LIMIT 50""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    return registry.clause_search(d, "text", "on_ and", ["doc_id"], 50, literal=False).select("doc_id")


NEAR = """near AS (SELECT a.vec_id AS new_id, b.vec_id AS rule_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


def vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return e.withColumnRenamed("vec_id", "new_id"), e.withColumnRenamed("vec_id", "rule_id")


@query(
    "j6_vector_candidates",
    f"""WITH {NEAR} SELECT new_id, rule_id, round(d, 6) AS distance FROM near WHERE d < 0.75
        QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY d, rule_id) <= 5""",
)
def _(spark, sf):
    new, stored = vectors(spark, sf)
    got = cd.nearest(
        new, "new_id", stored, "rule_id", "embedding", ["label"], 5, 0.75, tile_rows=64, skip_self=True
    )
    return got.select("new_id", "rule_id", F.round("distance", 6).alias("distance"))


@query(
    "w8_top_k",
    f"""WITH {NEAR} SELECT new_id, rule_id, row_number() OVER (PARTITION BY new_id ORDER BY d, rule_id) AS rank FROM near QUALIFY rank <= 3""",
)
def _(spark, sf):
    new, stored = vectors(spark, sf)
    got = cd.nearest(new, "new_id", stored, "rule_id", "embedding", ["label"], 3, 2.1, skip_self=True)
    return got.select("new_id", "rule_id", "rank")


@query(
    "f13_relevance",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS relevance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(f, "vec_id").select(
        "vec_id", vc.relevance(vc.cosine_distance(F.col("embedding"), F.col("other"))).alias("relevance")
    )


@query(
    "u2_merged_candidates",
    """WITH u AS (SELECT o_custkey AS new_id, o_orderkey % 10 AS rule_id, o_totalprice / 500000 AS d, 'vector' AS source, 0 AS place FROM orders
         UNION ALL SELECT user_id, CASE WHEN event_id % 9 > 0 THEN event_id % 10 END, 0.1, 'clause', 1 FROM events)
       SELECT new_id, rule_id, d AS distance, source FROM u WHERE rule_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY new_id, rule_id ORDER BY d, place) = 1""",
)
def _(spark, sf):
    one = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("new_id"), (F.col("o_orderkey") % 10).alias("rule_id"),
        (F.col("o_totalprice") / 500000).alias("distance"),
    )
    two = table(spark, sf, "events").select(
        F.col("user_id").alias("new_id"),
        F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 10).alias("rule_id"),
        F.lit(0.1).alias("distance"),
    )
    return cd.merge_candidates([("vector", one), ("clause", two)], "new_id", "rule_id")


@query("v3_text_vectors")
def _(spark, sf):
    return scoring.embed(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")
