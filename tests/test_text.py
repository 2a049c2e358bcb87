"""Edge cases of text, date, chunk and batch operators."""

import random

from pyspark.sql import functions as F

from tallywarden.functions import dates
from tallywarden.functions import text as tx
from tallywarden.functions.answers import parsed_rules
from tallywarden.functions.html import html_to_text, page_links
from tallywarden.operators import chunking as ck
from tallywarden.operators.documents import document_type, obligation_signals
from tallywarden.operators.packing import greedy_bins


def values(spark, texts, make):
    data = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "i long, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strip_is_unicode(spark):
    assert values(spark, ["\t a b  \n", "　"], tx.strip) == ["a b", ""]


def test_section_markers(spark):
    texts = [
        "18. NBFCs should", "Para 21 says", "(a) The", "(iii) All", "Section 12. x", "Annex-VI b",
        "NOTE: x", "3.1 NBFCs", "Chapter 3 x", "plain text", "text\n18. NBFCs",
    ]
    assert values(spark, texts, tx.section_marker) == [
        "18. N", "Para 21", "(a)", "(iii)", "Section 12.", "Annex-VI", "NOTE:", "3.1", "Chapter 3", "", "",
    ]


def test_dates(spark):
    names = ["14.08.2025", "2025-8-4", "rules 2013-14", "45.99.2024", "none", "x 2011 y"]
    assert values(spark, names, dates.date_from_name) == [
        "2025-08-14", "2025-08-04", "2013-01-01", None, None, "2011-01-01",
    ]
    assert values(spark, names[3:4], lambda c: dates.date_from_name(c, checked=False)) == ["2024-99-45"]
    texts = ["on 14 August 2025", "August 14, 2025", "dated July 1, 2011", "5 sep 2001", "1 Foo 2001"]
    assert values(spark, texts, dates.date_from_text) == [
        "2025-08-14", "2025-08-14", "2011-07-01", "2001-09-05", None,
    ]


def test_document_type(spark):
    df = spark.createDataFrame(
        [
            ("Master Direction 2016.pdf", "", None), ("master_direction.pdf", "", None),
            ("x.pdf", "It is  hereby notified on 14 August 2025", None), ("x.pdf", "nothing", None),
            ("circular.pdf", "gazette of india", " Master-Direction "), ("x.pdf", "", "weird"),
        ],
        "n string, t string, e string",
    )
    got = [tuple(r.v) for r in df.select(document_type(F.col("n"), F.col("t"), F.col("e")).alias("v")).collect()]
    assert got == [
        ("master_direction", "2016-01-01", "filename_pattern"),
        ("circular", None, "default_fallback"),
        ("notification", "2025-08-14", "first_page_text"),
        ("circular", None, "default_fallback"),
        ("master_direction", None, "explicit"),
        ("circular", None, "explicit"),
    ]


def test_packing_example(spark):
    lengths = [1500, 1500, 1500, 400, 3300, 10, 20]
    text = "\n \n".join(chr(97 + i) * n for i, n in enumerate(lengths))
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "  ")], "doc string, page int, text string")
    got = ck.chunk_pages(df, "doc", "page", "text", min_chars=0).orderBy("chunk_index").collect()
    assert [r.char_count for r in got] == [3002, 1902, 3300, 32]
    dropped = ck.chunk_pages(df, "doc", "page", "text").orderBy("chunk_index").collect()
    assert [r.chunk_index for r in dropped] == [0, 1, 2]


def test_chunks_carry_marker_and_number_over_pages(spark):
    long = "x" * 2000
    rows = [("d", 1, f"Para 1 {long}\n\n{long}\n\nPara 2 {long}"), ("d", 2, long), ("e", 1, long)]
    df = spark.createDataFrame(rows, "doc string, page int, text string")
    got = ck.chunk_pages(df, "doc", "page", "text", pages_per_block=1)
    told = [(r.doc, r.page, r.chunk_index, r.paragraph_number) for r in got.orderBy("doc", "chunk_index").collect()]
    assert told == [
        ("d", 1, 0, "Para 1"), ("d", 1, 1, "Para 1"), ("d", 1, 2, "Para 2"), ("d", 2, 3, ""), ("e", 1, 0, ""),
    ]


def test_skip_reasons(spark):
    body = "All customers must be identified before an account is opened with the company, always and fully. "
    texts = [
        "short", "Annex: " + body * 2, body * 2 + "\nschedule - x", "| a | b |\n" + body * 2, "Name: x\n" + body * 2,
        body * 2 + " ☑", body * 2 + "\n___", "1234567890 " * 20, body * 2, None,
    ]
    assert values(spark, texts, ck.skip_reason) == [
        "too_short", "appendix", "appendix", "pipe_rows", "form_field", "check_mark", "signature_line",
        "few_letters", None, "too_short",
    ]


def sequential(weights, capacity):
    bins, fill, number = [], 0, -1
    for i, w in enumerate(weights):
        if i == 0 or fill + w > capacity:
            number, fill = number + 1, w
        else:
            fill += w
        bins.append(number)
    return bins


def test_blocked_packing_equals_sequential(spark):
    rng = random.Random(7)
    data = {f"k{n}": [rng.choice([0, 3, 25, 60, 99, 100, 130]) for _ in range(n)] for n in (1, 9, 150)}
    data["ones"] = [1] * 130
    rows = [(k, i, w) for k, ws in data.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "k string, i long, w long")
    want = {(k, i): b for k, ws in data.items() for i, b in enumerate(sequential(ws, 100))}
    for block in (65536, 16, 5):
        got = {(r.k, r.i): r.b for r in greedy_bins(df, "k", "i", "w", 100, "b", block).collect()}
        assert got == want, block


def test_batches_respect_capacity(spark):
    rng = random.Random(3)
    rows = [("d", i, "word " * rng.randint(50, 3000)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc string, i long, text string")
    parts = ck.fitting_chunks(df).orderBy("i", "part").drop("i").collect()
    assert "".join(r.text for r in parts) == "".join(t for _, _, t in rows)
    df = spark.createDataFrame([(r.doc, i, r.text) for i, r in enumerate(parts)], "doc string, i long, text string")
    got = ck.batch_chunks(df, "doc", "i", provider="together").groupBy("batch_no").agg(F.sum("tokens").alias("t"))
    assert max(r.t for r in got.collect()) <= ck.batch_capacity("together") == 3100
    assert ck.batch_capacity("groq") == 100 and ck.batch_capacity("other") == 1100


def test_windows_cover_the_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh \n") for _ in range(n)) for n in (1, 499, 500, 501, 951, 3000)]
    for snap in (True, False):
        df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
        cut = df.withColumn("cut", tx.pieces(F.col("t"))).select("i", tx.windows("cut", snap=snap).alias("w"))
        for text, got in zip(texts, [r.w for r in cut.orderBy("i").collect()]):
            assert got[0].char_start == 0 and got[-1].char_end == len(text)
            for a, b in zip(got, got[1:]):
                assert a.char_start < b.char_start <= a.char_end <= b.char_end
            assert all(w.text == text[w.char_start : w.char_end].strip() for w in got)
            assert all(w.char_end - w.char_start <= 550 for w in got)


def test_html(spark):
    page = "<style>p{}</style><p>One &eacute; &amp;</p><script>x</script>ab<br><div>  two\t three </div>"
    assert values(spark, [page], html_to_text) == ["One é &\nab two three"]
    links = "<a href='/a.PDF'>x</a><a HREF=\"b.pdf?x\">y</a><a href='/a.PDF'>z</a><a href='c.html'>"
    got = values(spark, [links], lambda c: page_links(c, F.lit("http://h.org/d/e")))
    assert got == [["http://h.org/a.PDF", "http://h.org/d/b.pdf?x"]]


def test_answers(spark):
    rule = '{"title":"t","confidence_score":0.9}'
    texts = [
        f'```json\n{{"rules":[{rule}]}}\n```', f"[{rule},{rule}]", "no json", '{"rules": [', None, '{"rules": []}',
    ]
    assert [None if v is None else len(v) for v in values(spark, texts, parsed_rules)] == [1, 2, 0, 0, 0, 0]


def test_signals(spark):
    texts = ["Banks must report if Rs. 10 lakh is paid in 7 days", "Must not", "A plain note"]
    assert values(spark, texts, obligation_signals) == [
        ["modal", "condition", "threshold"], ["modal", "prohibition"], [],
    ]


def test_keyword_tags(spark):
    groups = {"a": ["kyc", "know your"], "b": ["ctr"]}
    assert values(spark, ["Know Your CTR", "none"], lambda c: tx.keyword_tags(c, groups)) == [["a", "b"], []]


def test_bins_of_a_key_are_counted_with_them(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.randint(1, 60)) for k, n in (("a", 37), ("b", 1), (None, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, w long")
    for block in (64, 5):
        got = greedy_bins(df, "k", "i", "w", 100, "b", block, "bins").collect()
        assert len(got) == len(rows)
        most = {k: max(r.b for r in got if r.k == k) + 1 for k in ("a", "b", None)}
        assert all(r.bins == most[r.k] for r in got)


def test_prompts_need_no_second_reading_of_the_texts(spark):
    rows = [("d", i, 1, "", "word " * 900) for i in range(9)] + [("e", 0, 1, "m", "some text")]
    df = spark.createDataFrame(rows, "doc string, i long, page long, paragraph_number string, text string")
    known = ck.batch_prompts(ck.batch_chunks(df, "doc", "i", batches="batches"), "doc", "i")
    asked = ck.batch_prompts(ck.batch_chunks(df, "doc", "i"), "doc", "i")
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, asked.collect()))
    joins = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(known) < joins(asked)
