"""Rules: gate, duplicates, candidates, registry, evaluation, samples."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallywarden.operators import audit, candidates, dedup, evaluate, registry, summary
from tallywarden.operators import rules as rl
from tallywarden.operators.ordering import rank_by_hash, row_numbers, running
from tallywarden.operators.scoring import RateLimited, embed, score_batches, with_retries
from tallywarden.plans import jobs

RULE = "idx long, scope string, title string, description string, severity string, rule_type string, confidence_score double, needs_review boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, "s", *r) for i, r in enumerate(rows)], RULE)


def resolve(spark, rows, **kw):
    got = dedup.resolve_duplicates(frame(spark, rows), "idx", "scope", **kw).collect()
    return {r.idx: (r.anchor, r.kept) for r in got}


def rule(title, severity="HIGH", kind="v", conf=0.9, desc="", review=False):
    return (title, desc, severity, kind, conf, review)


def test_golden_case(spark):
    rows = [
        rule("Identity check", "CRITICAL", "validation", 0.95),
        rule("Identity check", "CRITICAL", "validation", 0.90),
        rule("Name screening", "HIGH", "validation", 0.85),
        rule("Weak advice", "MEDIUM", "advisory", 0.45),
    ]
    got = jobs.dedup_rules(frame(spark, rows), "idx", "scope").collect()
    kept = {r.idx: r.approval_status for r in got if r.kept}
    assert kept == {0: "auto_approved", 2: "auto_approved", 3: "pending_review"}


def test_duplicate_variants(spark):
    same = "Identity check of customers"
    assert resolve(spark, [rule(same, conf=None), rule(same, conf=0.6)]) == {0: (0, False), 1: (0, True)}
    assert resolve(spark, [rule(same, conf=0.7), rule(same, conf=0.7)]) == {0: (0, True), 1: (0, False)}
    assert resolve(spark, [rule(same, kind=None), rule(same, kind=None)])[1] == (0, False)
    assert resolve(spark, [rule(""), rule("")]) == {0: (0, True), 1: (1, True)}
    assert resolve(spark, [rule(same), rule(same, "LOW")])[1] == (1, True)
    text = "Every customer is to be identified."
    assert resolve(spark, [rule(same, desc=text), rule(same, "LOW", desc=text)])[1] == (0, False)


def brute(rows, metric):
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return 1 - row[-1] / max(len(a), len(b))

    ratio = edit if metric == "edit" else lambda a, b: SequenceMatcher(None, a, b).ratio()

    def alike(x, y):
        a, b = x[0].lower().strip(), y[0].lower().strip()
        if not a or not b:
            return False
        r = ratio(a, b)
        if r >= 0.8 and x[2:4] == y[2:4]:
            return True
        return r >= 0.95 and bool(x[1]) and bool(y[1]) and ratio(x[1].lower().strip(), y[1].lower().strip()) >= 0.8

    taken, groups = set(), {}
    for i in range(len(rows)):
        if i in taken:
            continue
        members = [i] + [j for j in range(i + 1, len(rows)) if j not in taken and alike(rows[i], rows[j])]
        taken.update(members)
        keeper = max(members, key=lambda j: (0.5 if rows[j][4] is None else rows[j][4], -j))
        groups.update({j: (i, j == keeper) for j in members})
    return groups


@pytest.mark.parametrize("metric", ["gestalt", "edit"])
def test_duplicates_equal_brute_force(spark, metric):
    rng = random.Random(11)
    words = "report cash customer account identity check review limit transfer record".split()
    rows = []
    for _ in range(160):
        if rows and rng.random() < 0.6:
            title = list(rng.choice(rows)[0])
            for _ in range(rng.randint(0, 5)):
                if title:
                    title[rng.randrange(len(title))] = rng.choice("abcde ")
            title = "".join(title)
        else:
            title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        desc = rng.choice(["", "All cash must be reported.", "All cash must be reported!", "Other"])
        rows.append((title, desc, rng.choice(["HIGH", "LOW"]), rng.choice(["v", None]), rng.choice([None, 0.5, 0.9]), False))
    want = brute(rows, metric)
    for tile_rows in (2000, 20):
        assert resolve(spark, rows, metric=metric, tile_rows=tile_rows) == want, tile_rows


def test_clause_candidates_equal_brute_force(spark):
    rng = random.Random(2)
    words = "the of bank must cash shall report cust omer a to".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += texts[:10]
    phrases = [t[i : i + n] for t, i, n in zip(texts, itertools.cycle([0, 3, 5]), itertools.cycle([60, 25, 9, 4, 3, 2, 1]))]
    phrases += ["not there at all anywhere", "", "zz", "  The% OF bank  "]
    old = spark.createDataFrame([(f"r{i:03d}", t) for i, t in enumerate(texts)], "rule_id string, clause string")
    new = spark.createDataFrame(list(enumerate(phrases)), "new_id long, clause string")
    got = candidates.clause_candidates(new, "new_id", rl.clause_phrase(F.col("clause"), 60), old, "rule_id", "clause", 3)
    got = sorted((r.new_id, r.rule_id) for r in got.collect())
    want = []
    for i, p in enumerate(phrases):
        p = p.strip().replace("%", "")[:60].lower()
        if p:
            want += [(i, f"r{j:03d}") for j, t in enumerate(texts) if p in t.lower()][:3]
            # the first three by position
    want = sorted(x for i in range(len(phrases)) for x in [w for w in want if w[0] == i][:3])
    assert got == want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    vec = [[c + rng.gauss(0, 0.2) for c in rng.choice(centres)] for _ in range(300)]
    rows = [(i, i % 2, [float(x) for x in v]) for i, v in enumerate(vec)]
    old = spark.createDataFrame(rows, "rule_id long, tenant long, v array<double>")
    new = old.withColumnRenamed("rule_id", "new_id").filter("new_id < 60")
    got = candidates.nearest(new, "new_id", old, "rule_id", "v", ["tenant"], 4, 0.18, cells=8, tile_rows=16)
    got = {(r.new_id, r.rank): r.rule_id for r in got.collect()}

    def distance(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return 1 - dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {}
    for i in range(60):
        near = sorted((distance(vec[i], vec[j]), j) for j in range(300) if j % 2 == i % 2)
        want.update({(i, n + 1): j for n, (d, j) in enumerate(near[:4]) if d < 0.18})
    assert got == want and len(want) > 100


def test_upsert(spark):
    old = spark.sql("select * from values ('a', 'x', 1), ('b', 'y', 2) t(rule_id, title, n)")
    new = spark.sql("select * from values ('b', 'new', 1), ('b', 'newer', 2), ('c', null, 3), (null, 'z', 4) t(rule_id, title, at)")
    once = registry.upsert(old, new, "rule_id", F.col("at")).drop("at")
    got = sorted(map(tuple, once.collect()))
    assert got == [("a", "x", 1), ("b", "newer", 2), ("c", None, None)]
    twice = registry.upsert(once, new, "rule_id", F.col("at")).drop("at")
    assert sorted(map(tuple, twice.collect())) == got


def test_versioned_table(spark, tmp_path):
    t = registry.VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.range(3))
    t.write(t.read().filter("id > 0"))
    (tmp_path / "t" / "v00000003").mkdir()  # a write that never finished
    assert t.versions() == [1, 2] and t.read().count() == 2


def test_two_judgements_on_one_rule(spark):
    old = spark.sql("select 'a' rule_id, 'NEW' status, null last_modified_by, null modification_summary, 1 reference_count")
    j = spark.sql(
        """select * from values ('n1', 'a', 'MODIFIED', 's1', 'modified', 'd1', 'circular', '2024-02-01'),
           ('n2', 'a', 'SUPERSEDED', null, null, 'd2', 'circular', '2024-01-01')
           t(new_id, matched_rule_id, status, modification_summary, provenance_action,
             source_document_name, source_document_type, source_document_date)"""
    )
    got = registry.apply_judgements(old, j, "new_id").first()
    assert (got.status, got.last_modified_by, got.modification_summary, got.reference_count) == ("MODIFIED", "d1", "s1", 3)
    actions = {r.from_rule: r.action for r in registry.provenance_additions(j, "new_id").collect()}
    assert actions == {"n1": "modified", "n2": "superseded"}


def test_conditions(spark):
    tx = spark.sql("select * from values (1, 5.0, 'A', null), (2, 7.0, ' a b', 'x'), (3, null, null, 'y') t(id, amount, name, flag)")
    book = [
        ("gt", "amount", "gt", "5"), ("eq", "amount", "eq", "5.00"), ("in", "name", "in", "A, a b"),
        ("not_in", "name", "not_in", "A"), ("miss", "flag", "missing", None), ("has", "name", "contains", "B"),
        ("neq", "amount", "neq", "5"), ("badnum", "amount", "lt", "many"), ("nofield", "nope", "gt", "1"),
        ("noop", "amount", "like", "1"),
    ]
    rules = spark.createDataFrame(book, "rule_id string, condition_field string, condition_operator string, condition_value string")
    want = sorted([(2, "gt"), (1, "eq"), (1, "in"), (2, "in"), (2, "not_in"), (1, "miss"), (2, "has"), (2, "neq")])
    for compiled in (256, 0):
        got = evaluate.violations(tx, rules, ["id"], compiled_rules=compiled)
        assert sorted(map(tuple, got.collect())) == want, compiled
    told = {r.rule_id: r.evaluated for r in evaluate.evaluated_rules(rules, tx.columns).collect()}
    assert not told["nofield"] and not told["noop"] and told["badnum"]


def test_rates_of_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, rule_id string")
    assert summary.compliance_summary(none.withColumn("violated", F.lit(True))).first().compliance_rate == 100.0
    assert tuple(summary.size_stats(none, F.length("rule_id")).first()) == (0, 0, 0, 0)
    assert summary.page_count(none).first()[0] == 1


def test_audit_sample_is_disjoint_and_exact(spark):
    tx = spark.range(1000).withColumnRenamed("id", "i")
    matrix = spark.sql("select * from values (0, 'A', 'a', 'HIGH', 2.5d, 'd'), (1, 'B', 'b', 'LOW', 0.01d, 'd'), (2, 'C', 'c', 'LOW', 99.0d, 'd') t(place, rule_id, title, severity, percentage, detail)")
    got = audit.audit_sample(tx, matrix, "i").collect()
    counts = {k: sum(r.rule_id == k for r in got) for k in "ABC"}
    assert counts == {"A": 25, "B": 1, "C": 974} and len({r.i for r in got}) == 1000


def test_matrix_without_keywords_uses_first_rules(spark):
    rules = spark.sql("select * from values (0, 'a', 't', null, 'd'), (1, 'b', 'u', 'LOW', 'd'), (2, 'c', 'v', 'LOW', 'd') t(idx, rule_id, title, severity, description)")
    assert [r.rule_id for r in audit.keyword_matrix(rules, "idx").orderBy("place").collect()] == ["a", "b"]


def test_blocked_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    sums, n = {}, {}
    want = {}
    for k, i, v in rows:
        sums[k], n[k] = sums.get(k, 0) + v, n.get(k, 0) + 1
        want[i] = (sums[k], n[k])
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), F.col("v"), "s")
    got = row_numbers(got, ["k"], ["i"], F.floor(F.col("i") / 50), "n")
    assert {r.i: (r.s, r.n) for r in got.collect()} == want
    ranks = rank_by_hash(df, F.md5(F.col("i").cast("string")), ["i"], "r")
    assert sorted(r.r for r in ranks.collect()) == list(range(1, 401))


def test_verification_outcomes(spark):
    df = spark.sql("select * from values ('skipped_no_page', null, null), ('verified', 0.97d, true), ('correction_needed', 0.9d, null), ('source_not_found', 0.9d, null), ('error_parse', null, null) t(verification_status, confidence_score, needs_review)")
    got = {r.verification_status: (round(r.confidence_score, 4), r.needs_review, r.is_active) for r in rl.apply_outcome(df).collect()}
    assert got == {
        "skipped_no_page": (0.75, None, True), "verified": (1.0, False, True),
        "correction_needed": (0.5, True, True), "source_not_found": (0.3, True, False), "error_parse": (0.3, None, True),
    }


def test_verify_rules_keeps_every_rule(spark):
    rules = spark.sql("select * from values (1, 'a', 'CRITICAL', 't', 'pay 10', 'cash of 10', 0.9d, true), (2, 'b', 'LOW', 't', 'd', 'c', 0.9d, false), (9, 'c', 'HIGH', 't', 'd', 'c', 0.9d, false) t(page, rule_id, severity, title, description, source_clause, confidence_score, needs_review)")
    pages = spark.sql("select 1 page, 'All CASH   of 10 counts' text")
    got = {r.rule_id: r.verification_status for r in rl.verify_rules(rules, pages, ["page"], "text").collect()}
    assert got == {"a": "verified", "b": None, "c": "skipped_no_page"}


def test_scoring_failover_and_retries(spark):
    def busy(prompt):
        if prompt.startswith("b"):
            raise RateLimited("busy")
        if prompt.startswith("e"):
            raise ValueError("broken")
        return "{}"

    df = spark.createDataFrame([("a",), ("b1",), ("e",)], "prompt string")
    got = score_batches(df, [("one", busy), ("two", lambda p: "late")]).collect()
    assert sorted((r.prompt, r.provider, r.outcome, r.answer) for r in got) == [
        ("a", "one", "completed", "{}"), ("b1", "two", "completed", "late"), ("e", "one", "error", None),
    ]
    answers = iter(["no", "no", "yes"])
    assert with_retries(lambda p: next(answers), lambda a: a == "yes")("x") == "yes"
    assert with_retries(lambda p: "no", lambda a: False)("x") == "{}"


def test_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([("cash report",), ("cash limit rule",)], "text string")
    for r in embed(df, "text", features=64).collect():
        assert abs(sum(x * x for x in r.embedding) - 1) < 1e-5 or sum(r.embedding) == 0


def test_rule_files_skip_broken_ones(spark, tmp_path):
    from tallywarden.sources.tables import read_rule_files

    (tmp_path / "a.json").write_text('[{"rule_id": "a", "title": "x"}, {"rule_id": "b"}]')
    (tmp_path / "b.json").write_text('[{"rule_id": "c", ')
    got = read_rule_files(spark, str(tmp_path), "rule_id string, title string").collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("b", None)]


def test_delta_candidates_merge_both_sources(spark):
    old = spark.sql(
        """select * from values ('r1', 't', 'every customer must be identified before opening', array(1d, 0d)),
           ('r2', 't', 'nothing alike', array(0d, 1d)), ('r3', 'other', 'x', array(0d, 1d)) x(rule_id, tenant, source_clause, embedding)"""
    )
    new = spark.sql(
        """select * from values ('n1', 't', 'Customer must be identified', array(0.99d, 0.1d)),
           ('n2', 't', 'no such words', array(0.01d, 1d)), ('n3', 't', 'no such words', array(-1d, 0d)) x(new_id, tenant, source_clause, embedding)"""
    )
    got = jobs.delta_candidates(new, "new_id", old, ["tenant"]).collect()
    told = {(r.new_id, r.rule_id): (r.source, round(r.distance, 3)) for r in got}
    assert told == {("n1", "r1"): ("vector", 0.005), ("n2", "r2"): ("vector", 0.0)}
    text = spark.sql("select 'n1' new_id, 't' tenant, 'MUST be identified' source_clause, array(0d, -1d) embedding")
    got = jobs.delta_candidates(text, "new_id", old, ["tenant"]).collect()
    assert [(r.rule_id, r.source, float(r.distance)) for r in got] == [("r1", "clause", 0.1)]


def test_top_rows_per_key_are_cut_before_the_shuffle(spark):
    from tallywarden.operators.ordering import top_per_key

    plan = top_per_key(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], ["id"], 3)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_deep_page_sorts_its_blocks_only(spark):
    n, size = 2_000_000, 15
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("v"))
    block = F.floor(F.col("v") / 10_000)
    rows, skip = summary.rows_of_page(df, block, 100_000, size)
    assert rows.count() <= n // 100 and 0 <= skip < 10_000
    first = 99_999 * size
    got = [r.v for r in summary.deep_page(df, ["v"], block, 100_000, size).collect()]
    assert got == list(range(first, first + size))
    edge = [r.v for r in summary.deep_page(df, ["v"], block, 667, size).collect()]  # over two blocks
    assert edge == list(range(666 * size, 667 * size))
    assert summary.deep_page(df, ["v"], block, n, size).count() == 0


def test_only_rules_on_texts_ask_for_texts(spark):
    from tallywarden.operators import evaluate

    tx = spark.createDataFrame([(1, 5.0, "x"), (2, None, "y"), (3, 9.5, None)], "i long, n double, s string")
    rules = spark.createDataFrame(
        [("A", "n", "gt", "9"), ("B", "n", "missing", None), ("C", "s", "eq", "x"), ("D", "s", "missing", None), ("E", "n", "lte", "5")],
        "rule_id string, condition_field string, condition_operator string, condition_value string",
    )
    got = evaluate.violations(tx, rules, ["i"], compiled_rules=0).collect()
    assert sorted(map(tuple, got)) == [(1, "C"), (1, "E"), (2, "B"), (3, "A"), (3, "D")]
    index = next(evaluate._indexes(evaluate._usable(tx, rules)))
    assert index.texts == {"n": False, "s": True}
