"""Text functions, page and chunk operators over documents and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import RULES, WS, query, rules_of_documents, table
from tallywarden.functions import dates, html
from tallywarden.functions import text as tx
from tallywarden.operators import chunking as ck
from tallywarden.operators import documents as dc
from tallywarden.operators import registry, summary
from tallywarden.operators.ordering import row_numbers
from tallywarden.plans import jobs
from tallywarden.session import cut_lineage, scratch_path
from tallywarden.sources.tables import store

NL = r"\n"
# Test patterns for markers: the test texts have no numbered sections.
MARKERS = [r"[A-Z][a-z]+ and\s", r"The\s", r"[A-Z][a-z]+\.", r"Et\s"]


def docs(spark, sf):
    return table(spark, sf, "documents")


def pages(spark, sf):
    return table(spark, sf, "pages")


@query(
    "s8_readable_pages",
    f"SELECT doc_id, md5(trim(text, {WS})) AS text_md5 FROM documents WHERE length(trim(text, {WS})) >= 80",
)
def _(spark, sf):
    return ck.readable_pages(docs(spark, sf), "text").select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "f1_html_to_text",
    rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'),
           '(?is)<style.*?</style>', ' ', 'g') AS h FROM pages),
         b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</(?:p|div|li|h1|h2|h3|h4|h5|h6|tr|br)>', chr(10), 'g'),
           '<[^>]+>', ' ', 'g') AS h FROM a),
         c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
           '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS h FROM b)
         SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(h, '\r\n|[\n\r]'),
           lambda x: trim(regexp_replace(x, '[\s\x{{A0}}]+', ' ', 'g'), {WS})), lambda x: length(x) > 2), chr(10)) AS text FROM c""",
)
def _(spark, sf):
    return pages(spark, sf).select("page_id", html.html_to_text(F.col("html")).alias("text"))


HREFS = r"""hrefs AS (SELECT page_id, url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT page_id, url, regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1) AS l FROM pages))"""


@query("f2_raw_links", f"WITH {HREFS} SELECT page_id, pos, link FROM hrefs")
def _(spark, sf):
    return pages(spark, sf).select(
        "page_id", F.posexplode(html.raw_links(F.col("html"))).alias("pos", "link")
    )


@query(
    "f2_resolved_links",
    f"""WITH {HREFS}, full_links AS (SELECT page_id, pos,
          CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || link ELSE link END AS link FROM hrefs)
        SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos FROM (
          SELECT page_id, link, min(pos) AS pos FROM full_links WHERE contains(lower(link), 'th') GROUP BY ALL)""",
)
def _(spark, sf):
    links = html.page_links(F.col("html"), F.col("url"), "th")
    return pages(spark, sf).select("page_id", F.posexplode(links).alias("pos", "link"))


@query(
    "u3_distinct_links",
    f"""WITH {HREFS}, every AS (SELECT page_id, link, 0 AS list, pos FROM hrefs UNION ALL
          SELECT page_id, lower(link), 1, pos FROM hrefs)
        SELECT page_id, link, list, pos FROM every QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY list, pos) = 1""",
)
def _(spark, sf):
    one = pages(spark, sf).select(
        "page_id", F.posexplode(html.raw_links(F.col("html"))).alias("pos", "link")
    )
    two = one.withColumn("link", F.lower("link"))
    return registry.distinct_links([one, two], "page_id", "link", "pos")


@query(
    "t5_best_link",
    f"""WITH {HREFS} SELECT page_id, arg_min(link, (CASE WHEN contains(lower(link), 'an') THEN 0 ELSE 1 END) * 1000000 + pos) AS best_link
        FROM hrefs WHERE trim(link) <> '' GROUP BY 1""",
)
def _(spark, sf):
    links = pages(spark, sf).select(
        "page_id", F.posexplode(html.raw_links(F.col("html"))).alias("pos", "link")
    )
    return dc.best_link(links, "page_id", "link", "pos", "an")


HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "t6_best_text",
    f"""SELECT host, pos, md5(html) AS text_md5 FROM (
          SELECT {HOST} AS host, html, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS pos FROM pages)
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(html) DESC, pos) = 1 AND length(html) >= 500""",
)
def _(spark, sf):
    hosted = pages(spark, sf).withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    placed = row_numbers(
        hosted, ["host"], ["page_id"], F.floor(F.col("page_id") / 4096), "n"
    ).withColumn("pos", F.col("n") - 1)
    best = dc.best_text(placed, "host", "html", "pos")
    return best.select("host", "pos", F.md5("html").alias("text_md5"))


PARAS = rf"""paras AS (SELECT source, doc_id, para, pos, length(para) AS len,
    trim(regexp_extract(para, '^(?:(?:{MARKERS[0]})|(?:{MARKERS[1]})|(?:{MARKERS[2]})|(?:{MARKERS[3]}))'), {WS}) AS marker
  FROM (SELECT source, doc_id, unnest(l) AS para, generate_subscripts(l, 1) AS pos FROM (
    SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') AS l
    FROM documents)))"""
CHUNKS = f"""{PARAS}, fold AS (
    SELECT source, doc_id, pos, len AS fill, 0 AS bin FROM paras WHERE pos = 1
    UNION ALL SELECT p.source, p.doc_id, p.pos, CASE WHEN f.fill + p.len > 3200 THEN p.len ELSE f.fill + p.len END,
      CASE WHEN f.fill + p.len > 3200 THEN f.bin + 1 ELSE f.bin END
    FROM fold f JOIN paras p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1),
  carried AS (SELECT *, coalesce(last_value(nullif(marker, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS UNBOUNDED PRECEDING), '') AS seen FROM paras),
  packed AS (SELECT f.source, f.doc_id, f.bin, string_agg(para, chr(10) || chr(10) ORDER BY f.pos) AS text,
      arg_max(seen, f.pos) AS paragraph_number FROM fold f JOIN carried c ON c.doc_id = f.doc_id AND c.pos = f.pos GROUP BY ALL),
  chunks AS (SELECT source, doc_id, text, paragraph_number, length(text) AS char_count,
      row_number() OVER (PARTITION BY source ORDER BY doc_id, bin) - 1 AS chunk_index FROM packed WHERE length(text) >= 80)"""


def chunks(spark, sf):
    """A source is a document, each of its rows a page."""
    return ck.chunk_pages(docs(spark, sf), "source", "doc_id", "text", NL, MARKERS)


@query("f3_paragraphs", f"WITH {PARAS} SELECT doc_id, pos - 1 AS pos, md5(para) AS para_md5, marker FROM paras")
def _(spark, sf):
    got = ck.explode_paragraphs(docs(spark, sf), ["doc_id"], "text", NL, MARKERS)
    return got.select("doc_id", "pos", F.md5("paragraph").alias("para_md5"), F.col("section_marker").alias("marker"))


@query("w3_paragraph_packing", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, char_count, md5(text) AS text_md5 FROM chunks")
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", "char_count", F.md5("text").alias("text_md5"))


@query("w4_section_markers", f"WITH RECURSIVE {CHUNKS} SELECT source, chunk_index, paragraph_number FROM chunks")
def _(spark, sf):
    return chunks(spark, sf).select("source", "chunk_index", "paragraph_number")


@query(
    "w5_chunk_numbers",
    f"""WITH RECURSIVE {CHUNKS} SELECT source, doc_id, chunk_index,
          'page_' || doc_id || '_chunk_' || chunk_index AS chunk_source FROM chunks""",
)
def _(spark, sf):
    return chunks(spark, sf).select(
        "source", "doc_id", "chunk_index", F.col("metadata.source").alias("chunk_source")
    )


@query(
    "s9_chunk_store",
    f"""WITH RECURSIVE {CHUNKS} SELECT source, count(*) AS chunks, sum(char_count)::BIGINT AS chars FROM chunks GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "chunks")
    store(chunks(spark, sf), path, partition_by=["source"])
    return (
        spark.read.parquet(path)
        .groupBy("source")
        .agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"))
    )


SKIPS = r"""CASE WHEN text IS NULL OR length(trim(text, {ws})) < 100 THEN 'too_short'
  WHEN regexp_matches(text, '(?im-s)^(Schedule|Annexure|Annex|Appendix|Form|Attachment)\s*[-:]') THEN 'appendix'
  WHEN regexp_matches(text, '(?im-s)^(TABLE|Table)\s+OF\s+(CONTENTS|Contents)') THEN 'contents'
  WHEN regexp_matches(text, '(?im-s)^\s*\|.*\|.*\|') THEN 'pipe_rows'
  WHEN regexp_matches(text, '(?im-s)^(Name|Address|Date|Signature)(\s*[:=]|\s*\(\s*\))') THEN 'form_field'
  WHEN regexp_matches(text, '(?im-s)^(Print|Sign|DateField|Checkbox|Radio\s+Button)') THEN 'control'
  WHEN regexp_matches(text, '(?im-s)^(Page\s+\d+|Index|Bibliography|References|Glossary)') THEN 'back_matter'
  WHEN regexp_matches(text, '[✓✗☐☑]') THEN 'check_mark'
  WHEN regexp_matches(text, '(?im-s)^_{2,}') THEN 'signature_line'
  WHEN length(regexp_replace(text, '[^\pL]', '', 'g')) / length(text) < {ratio} THEN 'few_letters' END""".replace("{ws}", WS)


@query("p12_skip_reason", f"SELECT doc_id, {SKIPS.replace('{ratio}', '0.6')} AS reason FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", ck.skip_reason(F.col("text"), min_letters=0.6).alias("reason"))


KEPT = f"""{CHUNKS}, kept AS (SELECT source, doc_id, text, paragraph_number, chunk_index FROM (
      SELECT *, {SKIPS.replace('{ratio}', '0.4')} AS reason FROM chunks) WHERE reason IS NULL),
  parts AS (SELECT *, unnest(range(0, (greatest(length(text), 1) - 1) // 12400 + 1)) AS part FROM kept),
  sized AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_index, part) - 1 AS k,
    length(substr(text, part * 12400 + 1, 12400)) // 4 AS tok, substr(text, part * 12400 + 1, 12400) AS body FROM parts),
  bfold AS (SELECT source, k, tok AS fill, 0 AS batch_no FROM sized WHERE k = 0
    UNION ALL SELECT s.source, s.k, CASE WHEN f.fill + s.tok > 3100 THEN s.tok ELSE f.fill + s.tok END,
      CASE WHEN f.fill + s.tok > 3100 THEN f.batch_no + 1 ELSE f.batch_no END
    FROM bfold f JOIN sized s ON s.source = f.source AND s.k = f.k + 1),
  batched AS (SELECT s.*, batch_no FROM sized s JOIN bfold b ON b.source = s.source AND b.k = s.k)"""


def batched(spark, sf, block_size=65536, provider="together"):
    # The chunk table is a stored table between chunking and batching.
    stored = cut_lineage(ck.fitting_chunks(ck.policy_chunks(chunks(spark, sf)), "text", provider))
    kept = row_numbers(
        stored, ["source"], ["chunk_index", "part"],
        F.floor(F.col("chunk_index") / 4096), "n",
    ).withColumn("kept_index", F.col("n") - 1)
    return ck.batch_chunks(kept.drop("n"), "source", "kept_index", provider=provider, block_size=block_size, batches="batches")


@query(
    "w6_no_text_lost",
    f"""WITH RECURSIVE {KEPT} SELECT doc_id, chunk_index, length(text) AS chars, md5(text) AS text_md5 FROM kept""",
)
def _(spark, sf):
    """The parts of the provider with the smallest calls, put together again."""
    parts = batched(spark, sf, provider="groq").groupBy("doc_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("kept_index", "text"))).alias("p")
    )
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return parts.select("doc_id", "chunk_index", F.length(whole).cast("long").alias("chars"), F.md5(whole).alias("text_md5"))


@query("w6_token_batches", f"WITH RECURSIVE {KEPT} SELECT source, k AS kept_index, tok AS tokens, batch_no FROM batched")
def _(spark, sf):
    return batched(spark, sf).select("source", "kept_index", "tokens", "batch_no")


@query(
    "w6_token_batches_in_blocks",
    f"WITH RECURSIVE {KEPT} SELECT source, k AS kept_index, tok AS tokens, batch_no FROM batched",
)
def _(spark, sf):
    return batched(spark, sf, block_size=16).select("source", "kept_index", "tokens", "batch_no")


PROMPTS = f"""{KEPT}, numbered AS (SELECT *, row_number() OVER (PARTITION BY source, batch_no ORDER BY k) AS i FROM batched),
  prompts AS (SELECT source, batch_no, count(*) AS chunks, string_agg('--- CHUNK ' || i || ' | Page ' || doc_id ||
      CASE WHEN paragraph_number <> '' THEN ' | ' || paragraph_number ELSE '' END || ' ---' || chr(10) ||
      trim(body, {WS}) || chr(10) || '--- END CHUNK ' || i || ' ---', chr(10) || chr(10) ORDER BY i) AS body
    FROM numbered GROUP BY ALL)"""


@query(
    "p26_batch_prompts",
    f"""WITH RECURSIVE {PROMPTS} SELECT source, batch_no, chunks, count(*) OVER (PARTITION BY source) AS batches,
          'Batch ' || (batch_no + 1) || ' of ' || count(*) OVER (PARTITION BY source) || '.' || chr(10) || chr(10) || body AS prompt
        FROM prompts""",
)
def _(spark, sf):
    return ck.batch_prompts(batched(spark, sf), "source", "kept_index", page="doc_id")


@query(
    "a11_stage_statistics",
    f"""WITH RECURSIVE {KEPT}, s AS (
          SELECT 'chunk_chars' AS stage, char_count AS v FROM chunks
          UNION ALL SELECT 'batch_chunks', count(*) FROM batched GROUP BY source, batch_no)
        SELECT stage, count(*) AS total, CAST(sum(v) // count(*) AS BIGINT) AS avg_size, min(v) AS min_size, max(v) AS max_size,
          (SELECT round(100.0 * ((SELECT count(*) FROM chunks) - (SELECT count(*) FROM kept)) / (SELECT count(*) FROM chunks), 1)) AS skip_ratio
        FROM s GROUP BY stage""",
)
def _(spark, sf):
    every = chunks(spark, sf)
    groups = batched(spark, sf).groupBy("source", "batch_no").agg(F.count("*").alias("n"))
    counts = every.agg(
        F.count("*").alias("a"), F.count_if(ck.skip_reason(F.col("text")).isNotNull()).alias("s")
    )
    ratio = counts.select(summary.share(F.col("s"), F.col("a")).alias("r")).scalar()
    one = summary.size_stats(every, F.col("char_count")).withColumn("stage", F.lit("chunk_chars"))
    two = summary.size_stats(groups, F.col("n")).withColumn("stage", F.lit("batch_chunks"))
    return one.unionByName(two).withColumn("skip_ratio", ratio)


@query(
    "a18_batch_cost",
    f"""WITH RECURSIVE {KEPT}, n AS (SELECT source, count(DISTINCT batch_no) AS batches FROM batched GROUP BY 1)
        SELECT source, batches, (batches + 7) // 8 AS rounds_together, (batches + 7) // 8 * 3 AS seconds_together,
          (batches + 1) // 2 AS rounds_groq, (batches + 1) // 2 * 4 AS seconds_groq FROM n""",
)
def _(spark, sf):
    # Batch numbers are dense, so the greatest one tells the count.
    n = batched(spark, sf).groupBy("source").agg((F.max("batch_no") + 1).alias("batches"))
    out = n
    for provider in ("together", "groq"):
        cost = summary.batch_cost(F.col("batches"), provider)
        out = out.withColumn(f"rounds_{provider}", cost["rounds"]).withColumn(
            f"seconds_{provider}", cost["seconds"]
        )
    return out


@query(
    "f4_overlapping_windows",
    rf"""WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(0, CAST(ceil((length(text) - 500) / 450.0) AS INTEGER)) AS last
           FROM documents WHERE trim(text, {WS}) <> ''),
         k AS (SELECT *, unnest(range(0, last + 1)) AS k FROM d),
         e AS (SELECT *, length(regexp_extract(substr(text, k * 450 - 49, 50), '(?s)^.*[\s]')) AS a,
           length(regexp_extract(substr(text, k * 450 + 451, 50), '(?s)^.*[\s]')) AS b FROM k),
         w AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN a > 0 THEN k * 450 - 50 + a ELSE k * 450 END AS s,
           CASE WHEN k = last THEN n WHEN b > 0 THEN k * 450 + 450 + b ELSE k * 450 + 500 END AS t FROM e)
         SELECT doc_id, k AS chunk_index, CAST(s AS INTEGER) AS char_start, CAST(t AS INTEGER) AS char_end,
           md5(trim(substr(text, s + 1, t - s), {WS})) AS text_md5,
           trim(list_filter(string_split(text, chr(10)), lambda x: trim(x, {WS}) <> '')[1], {WS}) AS section_title FROM w""",
)
def _(spark, sf):
    got = ck.window_chunks(docs(spark, sf), ["doc_id"], "text")
    return got.withColumn("text_md5", F.md5("text")).drop("text")


DATED_NAMES = """names AS (SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN 'circ-' || strftime(o_orderdate, '%d.%m.%Y') || '.pdf' WHEN 1 THEN 'notice ' || strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN 'rules ' || strftime(o_orderdate, '%Y') || '-14' WHEN 3 THEN 'x45.99.' || strftime(o_orderdate, '%Y')
  WHEN 4 THEN 'y ' || strftime(o_orderdate, '%Y') || '/8/4' ELSE 'none' END AS name FROM orders)"""


@query(
    "f5_date_from_name",
    rf"""WITH {DATED_NAMES}, p AS (SELECT o_orderkey, name,
           regexp_extract(name, '(\d{{1,2}})[.\-/](\d{{1,2}})[.\-/](\d{{4}})', ['d', 'm', 'y']) AS a,
           regexp_extract(name, '(\d{{4}})[.\-/](\d{{1,2}})[.\-/](\d{{1,2}})', ['y', 'm', 'd']) AS b,
           regexp_extract(name, '\b(20\d{{2}})\b', 1) AS c FROM names)
         SELECT o_orderkey, CASE
           WHEN a.y <> '' THEN strftime(try_strptime(a.y || '-' || a.m || '-' || a.d, '%Y-%m-%d'), '%Y-%m-%d')
           WHEN b.y <> '' THEN strftime(try_strptime(b.y || '-' || b.m || '-' || b.d, '%Y-%m-%d'), '%Y-%m-%d')
           WHEN c <> '' THEN c || '-01-01' END AS doc_date FROM p""",
)
def _(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    year = F.date_format(d, "yyyy")
    name = (
        F.when(k == 0, F.concat(F.lit("circ-"), F.date_format(d, "dd.MM.yyyy"), F.lit(".pdf")))
        .when(k == 1, F.concat(F.lit("notice "), F.date_format(d, "yyyy-MM-dd")))
        .when(k == 2, F.concat(F.lit("rules "), year, F.lit("-14")))
        .when(k == 3, F.concat(F.lit("x45.99."), year))
        .when(k == 4, F.concat(F.lit("y "), year, F.lit("/8/4")))
        .otherwise("none")
    )
    return table(spark, sf, "orders").select("o_orderkey", dates.date_from_name(name).alias("doc_date"))


@query(
    "f6_date_from_text",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS doc_date FROM orders""",
)
def _(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Issued on "), F.date_format(d, "d MMMM yyyy"), F.lit(" by")))
        .when(k == 1, F.concat(F.lit("dated "), F.date_format(d, "MMMM d, yyyy")))
        .when(k == 2, F.concat(F.lit("see "), F.upper(F.date_format(d, "dd MMM , yyyy"))))
        .otherwise(F.concat(F.lit("of "), F.date_format(d, "yyyy"), F.lit(" 14 Augusta 2025")))
    )
    return table(spark, sf, "orders").select("o_orderkey", dates.date_from_text(text).alias("doc_date"))


@query(
    "f7_token_estimate",
    "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("f8_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


GROUPS = {"english": ["the ", " and "], "german": ["und ", "nicht "], "french": ["qui ", "avec "], "none": ["zzzz"]}


@query(
    "f12_keyword_tags",
    """SELECT doc_id, concat_ws(',', CASE WHEN contains(t, 'the ') OR contains(t, ' and ') THEN 'english' END,
         CASE WHEN contains(t, 'und ') OR contains(t, 'nicht ') THEN 'german' END,
         CASE WHEN contains(t, 'qui ') OR contains(t, 'avec ') THEN 'french' END) AS tags
       FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
)
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(tx.keyword_tags(F.col("text"), GROUPS), ",").alias("tags"))


@query(
    "f17_pipe_labels",
    """SELECT o_orderkey, unnest(['R-' || o_custkey, 'Annex-' || o_orderstatus, o_orderpriority]) AS label FROM orders""",
)
def _(spark, sf):
    labels = F.concat_ws(
        "|", F.concat(F.lit("R-"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("Annex-"), "o_orderstatus"), "o_orderpriority",
    )
    return table(spark, sf, "orders").select("o_orderkey", F.explode(tx.pipe_labels(labels)).alias("label"))


@query(
    "p13_text_class",
    f"""WITH t AS (SELECT source, count(*) AS total_pages, count(*) FILTER (length(trim(text, {WS})) >= 1900) AS text_pages,
          count(*) FILTER (length(trim(text, {WS})) < 1900 AND doc_id % 3 = 0) AS image_pages FROM documents GROUP BY 1)
        SELECT *, round(text_pages / total_pages, 2) AS text_ratio, CASE WHEN text_pages / total_pages >= 0.5 THEN 'digital'
          WHEN text_pages / total_pages <= 0.4 THEN 'scanned' ELSE 'mixed' END AS text_class FROM t""",
)
def _(spark, sf):
    df = docs(spark, sf).withColumn("has_image", F.col("doc_id") % 3 == 0)
    return dc.text_class(df, "source", "text", "has_image", 1900, 0.5, 0.4)


NAME_TESTS = [(r"spam\s*-", "gazette"), ("blog", "amendment"), ("utm", "notification"), (r"m\.", "circular")]
PAGE_TESTS = [(r"\bthe\s+of\b", "master_direction"), (r"ein.*und", "gazette"), ("avec", "amendment")]
GIVEN = "CASE WHEN page_id % 17 = 0 THEN ' Master Direction' WHEN page_id % 19 = 0 THEN 'bogus' END"


@query(
    "p14_document_type",
    rf"""WITH j AS (SELECT page_id, lower(url) AS u, lower(text) AS t, {GIVEN} AS g FROM pages JOIN documents ON doc_id = page_id),
         c AS (SELECT page_id, g, CASE WHEN regexp_matches(u, 'spam\s*-') THEN 'gazette' WHEN regexp_matches(u, 'blog') THEN 'amendment'
             WHEN regexp_matches(u, 'utm') THEN 'notification' WHEN regexp_matches(u, 'm\.') THEN 'circular' END AS n,
           CASE WHEN regexp_matches(t, '\bthe\s+of\b') THEN 'master_direction' WHEN regexp_matches(t, '(?-s)ein.*und') THEN 'gazette'
             WHEN regexp_matches(t, 'avec') THEN 'amendment' END AS p FROM j)
         SELECT page_id, CASE g WHEN ' Master Direction' THEN 'master_direction' WHEN 'bogus' THEN 'circular' ELSE coalesce(n, p, 'circular') END AS document_type,
           CASE WHEN g IS NOT NULL THEN 'explicit' WHEN n IS NOT NULL THEN 'filename_pattern' WHEN p IS NOT NULL THEN 'first_page_text'
             ELSE 'default_fallback' END AS detection_method FROM c""",
)
def _(spark, sf):
    p = pages(spark, sf)
    given = F.when(p["page_id"] % 17 == 0, " Master Direction").when(p["page_id"] % 19 == 0, "bogus")
    joined = p.join(docs(spark, sf), p["page_id"] == F.col("doc_id"))
    kind = dc.document_type(F.col("url"), F.col("text"), given, NAME_TESTS, PAGE_TESTS)
    return joined.select("page_id", kind.alias("k")).select(
        "page_id", "k.document_type", "k.detection_method"
    )


@query(
    "p15_base_documents",
    f"WITH {RULES} SELECT rule_id, source_document_type = 'master_direction' AS is_base FROM rules",
)
def _(spark, sf):
    return rules_of_documents(spark, sf).select(
        "rule_id", dc.is_base_document(F.col("source_document_type")).alias("is_base")
    )


@query(
    "f14_type_normal_form",
    """SELECT o_orderkey, replace(replace(trim(lower(' ' || o_orderpriority || ' x')), ' ', '_'), '-', '_') AS kind FROM orders""",
)
def _(spark, sf):
    c = F.concat(F.lit(" "), "o_orderpriority", F.lit(" x"))
    return table(spark, sf, "orders").select("o_orderkey", dc.normal_type(c).alias("kind"))


SIGNALS = {"modal": r"\b(of|and|und)\b", "prohibition": r"\b(the of|die der)\b", "condition": r"\b(in|avec)\b", "threshold": r"\d+ ?%"}


@query(
    "p21_obligation_signals",
    r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])(of|and|und)([^\pL\pN_]|$)') THEN 'modal' END,
          CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])(the of|die der)([^\pL\pN_]|$)') THEN 'prohibition' END,
          CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])(in|avec)([^\pL\pN_]|$)') THEN 'condition' END,
          CASE WHEN regexp_matches(text, '(?i)\d+ ?%') THEN 'threshold' END) AS signals FROM documents""",
)
def _(spark, sf):
    got = dc.obligation_signals(F.col("text"), SIGNALS)
    return docs(spark, sf).select("doc_id", F.array_join(got, ",").alias("signals"))


@query(
    "j17_fill_empty_pages",
    f"""SELECT d.doc_id, md5(CASE WHEN trim(CASE WHEN d.doc_id % 5 = 0 THEN ' ' ELSE text END, {WS}) <> '' THEN text
          ELSE coalesce(b.btext, '') END) AS text_md5
        FROM documents d LEFT JOIN (SELECT item_id, text AS btext FROM benchmark) b ON b.item_id = d.doc_id""",
)
def _(spark, sf):
    d = docs(spark, sf).withColumn(
        "text", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text"))
    )
    second = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    got = dc.fill_empty_pages(d, second, ["doc_id"], "text")
    return got.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "chunk_and_batch_documents",
    f"""WITH RECURSIVE {PROMPTS} SELECT source, batch_no, chunks, count(*) OVER (PARTITION BY source) AS batches,
          md5('Batch ' || (batch_no + 1) || ' of ' || count(*) OVER (PARTITION BY source) || '.' || chr(10) || chr(10) || body) AS prompt_md5
        FROM prompts""",
)
def _(spark, sf):
    path = scratch_path(spark, "policy-chunks")
    made = jobs.chunk_documents(
        docs(spark, sf), "source", "doc_id", "text", separator=NL, patterns=MARKERS
    )
    store(made, path)
    prompts = jobs.batch_documents(spark.read.parquet(path), "source", "doc_id")
    return prompts.withColumn("prompt_md5", F.md5("prompt")).drop("prompt")
