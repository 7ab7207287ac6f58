import random
import re

import pytest
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.rules import any_word, keyword_category
from wardline.operators import joins, rule_tables

BOTH = pytest.mark.parametrize("most_bytes", [10**9, 0])


def _is_word(char):
    return char == "_" or char.isalnum()


def _holds(text, keyword, whole):
    if not whole:
        return keyword in text
    for m in re.finditer(f"(?={re.escape(keyword)})", text):
        start, end = m.start(), m.start() + len(keyword)
        left = not _is_word(keyword[0]) or start == 0 or not _is_word(text[start - 1])
        right = not _is_word(keyword[-1]) or end == len(text) or not _is_word(text[end])
        if left and right:
            return True
    return False


def _brute(text, rules):
    found = {}
    for category, priority, keyword, whole in rules:
        if keyword and _holds(text.lower(), keyword.lower(), whole):
            found.setdefault((priority, category), set()).add(keyword.lower())
    return [(p, c, len(kws), sorted(kws, key=str.encode)) for (p, c), kws in sorted(found.items())]


def _matches(df, rules, most_bytes):
    rows = rule_tables.match_rules(df, rules, "text", most_bytes).collect()
    return {r.id: None if r.rule_matches is None else [(m.priority, m.category, m.hits, m.keywords) for m in r.rule_matches] for r in rows}


@BOTH
def test_random_rules_against_a_scan(spark, most_bytes):
    rng = random.Random(4)
    pieces = ["water", "leak", "leaking", "no", " ", "  ", "-", "é", "Street", "light", "_", "1", "😀", ".", "'", "\x01", "\n", "a"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts = [t.replace("\x01", " ") for t in texts] + ["", "water\x01leak"]
    rules = [
        (f"c{p}", p, "".join(rng.choice(pieces[:-4]) for _ in range(rng.randrange(1, 4))), rng.random() < 0.5)
        for p in [rng.randrange(12) for _ in range(150)]
    ]
    rules += [("c1", 1, "LEAK", True), ("c2", 2, "leak", True), ("c1", 1, "leak", False), ("c3", 3, "", False)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, text string")
    got = _matches(df, spark.createDataFrame(rules, rule_tables.RULES), most_bytes)
    assert got.pop(-1) is None
    want = {i: _brute(t.replace("\x01", " "), rules) for i, t in enumerate(texts)}
    assert got == want


@BOTH
def test_built_in_lists_give_the_built_in_answers(spark, log, most_bytes):
    rows = log.select("complaint_text")
    done = rule_tables.table_category(rows, rule_tables.rule_table(spark, vocab.CATEGORY_KEYWORDS), "complaint_text", most_bytes)
    both = done.withColumn("built_in", keyword_category(F.col("complaint_text"))).collect()
    assert len(both) == rows.count() and all(r.category == r.built_in for r in both)


def test_whole_words_as_in_the_built_in_lists(spark, log):
    rules = rule_tables.rule_table(spark, {"High": vocab.SEVERITY_HIGH}, whole_words=True)
    done = rule_tables.match_rules(log.select(F.lower("complaint_text").alias("text")), rules, "text")
    rows = done.withColumn("built_in", any_word(F.col("text"), vocab.SEVERITY_HIGH)).collect()
    assert all((len(r.rule_matches) > 0) == r.built_in for r in rows) and any(r.built_in for r in rows)


def test_many_keywords(spark):
    """100,000 keywords in 500 categories: the table answers as a scan of all of them does."""
    rng = random.Random(7)
    letters = "abcdefghij"
    words = list({"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(101_000)})[:100_000]
    rules = [(f"c{i % 500:03}", i % 500, w, False) for i, w in enumerate(words)]
    texts = ["".join(rng.choice(letters) for _ in range(400)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = _matches(df, spark.createDataFrame(rules, rule_tables.RULES), 10**9)
    for i, text in enumerate(texts):
        hit = [r for r in rules if r[2] in text]
        assert got[i] == _brute(text, hit) and hit


@BOTH
def test_no_rules_and_no_rows(spark, most_bytes):
    df = spark.createDataFrame([(1, "water leak"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], rule_tables.RULES)
    assert _matches(df, none, most_bytes) == {1: [], 2: None}
    assert _matches(df.limit(0), rule_tables.rule_table(spark, {"a": ["leak"]}), most_bytes) == {}
    ranked = rule_tables.match_rules(df, rule_tables.rule_table(spark, {"a": ["x"], "b": ["leak"], "c": ["water"]}), "text", most_bytes)
    best = ranked.select(rule_tables.most_hits(F.col("rule_matches"))["category"]).collect()
    assert [r[0] for r in best] == ["b", None]  # equal hits: the smaller priority


@pytest.mark.parametrize("bound", [10**9, 8000, -1])
def test_texts_longer_than_a_piece(spark, monkeypatch, bound):
    """Rules sent out, only their first characters sent out, and nothing sent out."""
    monkeypatch.setattr(rule_tables, "PIECE", 4)
    monkeypatch.setattr(rule_tables, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", bound)
    rng = random.Random(11)
    pieces = ["water", "leak", " ", "-", "--", "é", "Street", "_", "1", "😀", "?", "\n", "a"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(120)] + ["😀a", "?a", "--"]
    rules = [(f"c{p}", p, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))), rng.random() < 0.5) for p in [rng.randrange(9) for _ in range(120)]]
    rules += [("c1", 1, "?a", False), ("c2", 2, "--", True), ("c3", 3, "-", False), ("c4", 4, texts[0], False), ("c5", 5, texts[1], True)]
    df = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:5])], "id int, text string")
    table = spark.createDataFrame(rules, rule_tables.RULES)
    if bound == 8000:
        needles = rule_tables._needles(table)
        assert joins.measured_bytes(needles.selectExpr(f"left(needle, {rule_tables.GRAM}) as gram").distinct()) <= bound < joins.measured_bytes(needles)
    assert _matches(df, table, -2) == {i: _brute(t, rules) for i, t in enumerate(texts)}


def _nodes(plan):
    return [plan, *[n for i in range(plan.children().size()) for n in _nodes(plan.children().apply(i))]]


def test_texts_do_not_meet_their_matches(spark):
    df = spark.createDataFrame([(1, "water leak"), (2, None)], "id int, text string")
    rules = rule_tables.rule_table(spark, {"a": ["leak"], "b": ["water"]}, whole_words=True)
    plan = rule_tables.match_rules(df, rules, "text", 0).select("id", "rule_matches")._jdf.queryExecution().optimizedPlan()
    met = [n.children().apply(i).output().mkString(" ") for n in _nodes(plan) if n.nodeName() == "Join" for i in (0, 1)]
    grouped = [n.child().output().mkString(" ") for n in _nodes(plan) if n.nodeName() == "Aggregate"]
    assert len(met) == 4 and grouped
    assert not any(f"{name}#" in side for side in met + grouped for name in ("text", "_plain", "_marked", "_piece"))
