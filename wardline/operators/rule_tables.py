"""Keyword rules held as a table: any number of keywords and categories.

A rule is a row ``category, priority, keyword, whole_words``; the smallest priority counts first, and
a category has one. Keywords are compared in lower case, as substrings or as whole words (no letter,
digit or underscore goes on beyond a keyword's end that is one itself).

Whole words become substrings: a mark is set wherever word characters begin or end, in text and keyword
alike, and the marked keyword is looked for in the marked text. So one search serves both kinds:

* While the rules' bytes are few they go to the workers once, as an automaton over all keywords. A text
  is read once, whatever the number of keywords, and rows stay where they are.
* Beyond that, texts and keywords meet in an equi-join on the first characters of a keyword. A place of a text
  brings as many characters as the longest keyword has, so what meets is checked in full right there. Rows are
  numbered and stored first; only what matched is shuffled, no text beyond what the caller reads again.

``match_rules`` gives all matches of a text; ``most_hits`` and ``first_level`` pick a category from them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import WORD, let
from wardline.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes
from wardline.session import shared_dir

RULES = "category string, priority int, keyword string, whole_words boolean"
MATCHES = "array<struct<priority:int,category:string,hits:int,keywords:array<string>>>"
MARK = "\x01"
GRAM = 6  # first characters of a keyword that a text has to share
PIECE = 2000  # characters of a text whose places are listed at a time
_ENTRY = pa.struct(
    [("priority", pa.int32()), ("category", pa.string()), ("hits", pa.int32()), ("keywords", pa.list_(pa.string()))]
)


def rule_table(spark: SparkSession, lists: Mapping[str, Sequence[str]], whole_words: bool = False) -> DataFrame:
    """Rules from keyword lists by category; earlier categories come first."""
    rows = [(c, n, kw, whole_words) for n, (c, kws) in enumerate(lists.items()) for kw in kws]
    return spark.createDataFrame(rows, RULES)


def marked(text: Column) -> Column:
    """``text`` with a mark wherever word characters begin or end."""
    edge = f"(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD})"
    return F.regexp_replace(F.translate(text, MARK, " "), edge, MARK)


def _needles(rules: DataFrame) -> DataFrame:
    low = F.lower("keyword")
    whole = F.coalesce("whole_words", F.lit(False))
    needle = F.when(whole, marked(low)).otherwise(F.translate(low, MARK, " "))
    return rules.where(F.length("keyword") > 0).select(
        "category", "priority", low.alias("keyword"), whole.alias("whole"), needle.alias("needle")
    ).distinct()


class KeywordMatcher:
    """Automata over plain and marked needles; built once per worker, from columns that travel."""

    def __init__(self, needles: pa.Table):
        self.columns = {name: needles.column(name).to_pylist() for name in needles.column_names}
        self.automata: dict | None = None

    def __getstate__(self) -> dict:
        return {"columns": self.columns, "automata": None}

    def _build(self) -> dict:
        import ahocorasick

        self.rules = list(zip(self.columns["priority"], self.columns["category"], self.columns["keyword"]))
        owners: dict[bool, dict[str, list[int]]] = {True: {}, False: {}}
        for i, (needle, whole) in enumerate(zip(self.columns["needle"], self.columns["whole"])):
            owners[whole].setdefault(needle, []).append(i)
        built = {}
        for whole, needles in owners.items():
            automaton = ahocorasick.Automaton()
            for needle, rules in needles.items():
                automaton.add_word(needle, tuple(rules))
            if needles:
                automaton.make_automaton()
                built[whole] = automaton
        return built

    def matches(self, plain: str | None, with_marks: str | None) -> list[dict] | None:
        if plain is None:
            return None
        if self.automata is None:
            self.automata = self._build()
        found: set[int] = set()
        for whole, automaton in self.automata.items():
            for rules in {rules for _, rules in automaton.iter(with_marks if whole else plain)}:
                found.update(rules)
        keywords: dict[tuple, set[str]] = {}
        for i in found:
            priority, category, keyword = self.rules[i]
            keywords.setdefault((priority, category), set()).add(keyword)
        return [
            {"priority": p, "category": c, "hits": len(kws), "keywords": sorted(kws, key=lambda k: k.encode())}
            for (p, c), kws in sorted(keywords.items())
        ]


def match_rules(df: DataFrame, rules: DataFrame, text: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` and ``rule_matches``: the categories hit, by priority, with their distinct keywords in order.

    A missing text has NULL, a text without hits an empty list.
    """
    needles = _needles(rules)
    if measured_bytes(needles) <= most_bytes:
        return _scanned(df, needles, text)
    return _joined(df, needles, text)


def _haystacks(text: str, any_whole: bool) -> list[Column]:
    plain = F.translate(F.lower(F.col(f"`{text}`")), MARK, " ")
    return [plain.alias("_plain"), (marked(plain) if any_whole else F.lit(None).cast("string")).alias("_marked")]


def _scanned(df: DataFrame, needles: DataFrame, text: str) -> DataFrame:
    matcher = KeywordMatcher(needles.toArrow())
    sent = df.sparkSession.sparkContext.broadcast(matcher)
    names = [*df.columns, "rule_matches"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, with_marks = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            rows = [sent.value.matches(a, b) for a, b in zip(plain.to_pylist(), with_marks.to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, pa.list_(_ENTRY))], names)

    schema = df.withColumn("rule_matches", F.lit(None).cast(MATCHES)).schema
    return df.select("*", *_haystacks(text, any(matcher.columns["whole"]))).mapInArrow(scan, schema)


def _places(needles: DataFrame) -> tuple[dict[bool, list[Column]], dict[bool, int]]:
    """What to look at in the places of a piece, by whether needles have marks, and the longest such needle.

    A needle without marks is found in the plain text wherever it is found in the marked one. Each match takes one
    character and looks ahead for the others, so that a piece is read in one pass.
    """
    has_mark, first = F.contains("needle", F.lit(MARK)).alias("has_mark"), F.startswith("needle", F.lit(MARK)).alias("first")
    shapes = needles.groupBy(has_mark, first, F.length("gram").alias("n")).agg(F.max(F.length("needle")).alias("most"))
    found: dict[bool, list[Column]] = {}
    longest: dict[bool, int] = {}
    for s in shapes.collect():  # 3 * GRAM at most
        one = MARK if s.first else "."
        pattern = f"(?s)(?=({one}.{{{s.n - 1},{s.most - 1}}})){one}"
        found.setdefault(s.has_mark, []).append(F.regexp_extract_all("_piece", F.lit(pattern), F.lit(1)))
        longest[s.has_mark] = max(longest.get(s.has_mark, 0), s.most)
    return found, longest


def _joined(df: DataFrame, needles: DataFrame, text: str) -> DataFrame:
    spark = df.sparkSession
    folder = shared_dir(spark, "rules")
    needles.withColumn("gram", F.left("needle", F.lit(GRAM))).write.parquet(f"{folder}/needles")
    needles = spark.read.parquet(f"{folder}/needles")
    found, longest = _places(needles)
    if not found:
        return df.withColumn("rule_matches", F.when(F.col(f"`{text}`").isNotNull(), F.array().cast(MATCHES)))
    df.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    plain, with_marks = _haystacks(text, True)
    # Pieces overlap by what the longest needle needs.
    pieces = [
        F.regexp_extract_all(with_marks if has_mark else plain, F.lit(f"(?s)(?=(.{{1,{PIECE + most - 1}}})).{{1,{PIECE}}}"), F.lit(1))
        for has_mark, most in longest.items()
    ]
    nothing = F.array().cast("array<string>")
    places = F.when(F.contains("_piece", F.lit(MARK)), F.concat(*found.get(True, [nothing]))).otherwise(F.concat(*found.get(False, [nothing])))
    facts = rows.select("_row", F.explode(F.concat(*pieces)).alias("_piece")).select("_row", F.explode(places).alias("_place"))
    facts = facts.withColumn("gram", F.left("_place", F.lit(GRAM)))
    grams = needles.select("gram").distinct()
    if measured_bytes(needles) > BROADCAST_BYTES >= measured_bytes(grams):  # most places are left out before they move
        facts = facts.join(F.broadcast(grams), "gram", "left_semi")
    hits = lookup_join(facts, needles, "gram").where(F.startswith("_place", "needle"))
    near = hits.groupBy("_row").agg(F.collect_set(F.struct("priority", "category", "keyword")).alias("_near"))

    def grouped(found: Column) -> Column:
        def one(c: Column) -> Column:
            own = F.transform(F.filter(found, lambda r: r["category"] == c["category"]), lambda r: r["keyword"])
            return let(
                F.array_sort(F.array_distinct(own)),
                lambda kws: F.struct(c["priority"].alias("priority"), c["category"].alias("category"),
                                     F.size(kws).alias("hits"), kws.alias("keywords")),
            )

        categories = F.transform(found, lambda r: F.struct(r["priority"].alias("priority"), r["category"].alias("category")))
        return F.transform(F.array_sort(F.array_distinct(categories)), one)

    none = F.array().cast(MATCHES)
    matches = F.when(F.col("_given"), F.coalesce(let(F.col("_near"), grouped).cast(MATCHES), none))
    names = [F.col(f"`{c}`") for c in df.columns]
    given = rows.select("*", F.col(f"`{text}`").isNotNull().alias("_given"))
    return given.join(near, "_row", "left").select(*names, matches.alias("rule_matches"))


def most_hits(matches: Column) -> Column:
    """The match with most distinct keywords, of equals the one of smallest priority; NULL without any."""
    best = F.array_max(F.transform(matches, lambda m: F.struct(m["hits"].alias("hits"), (-m["priority"]).alias("p"), m.alias("m"))))
    return best["m"]


def first_level(matches: Column) -> Column:
    """The match of smallest priority; NULL without any."""
    return F.get(matches, F.lit(0))


def table_category(df: DataFrame, rules: DataFrame, text: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with ``category`` and ``rationale`` by the rules: the category with most keywords, and those."""
    best = most_hits(F.col("rule_matches"))
    return (
        match_rules(df, rules, text, most_bytes)
        .withColumn("_best", best)
        .withColumn("category", F.coalesce("_best.category", F.lit(vocab.GENERAL)))
        .withColumn(
            "rationale",
            F.when(F.col("_best").isNull(), F.lit(vocab.NO_KEYWORD_RATIONALE)).otherwise(
                F.concat(F.lit(vocab.KEYWORD_RATIONALE), F.array_join("_best.keywords", ", "))
            ),
        )
        .drop("_best", "rule_matches")
    )
