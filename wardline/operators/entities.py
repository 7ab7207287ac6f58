"""Entity operators that need rows of their own: gazetteer joins, token tables, counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.spans import SPANS, leftmost_longest, span
from wardline.functions.text import WORD, let, token_spans, word_spans
from wardline.operators.joins import lookup_join

# Characters per bucket when tokens meet the spans that may cover them.
BUCKET = 64
# So many names go into the expression as sets of hashes; more are joined.
FEW_NAMES = 1000
_FEW = 16  # hits of a text whose places are added up anew for each


def seed_gazetteer(spark: SparkSession) -> DataFrame:
    """The built-in names as a table ``term, label``."""
    rows = [(t, "LOCATION") for t in vocab.PLACES] + [(t, "PROBLEM") for t in vocab.PROBLEMS]
    return spark.createDataFrame(rows, "term string, label string")


def extract_entities(df: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """``key, entities`` for every text, with the matches of a gazetteer ``term, label`` of any size.

    Runs of words meet the gazetteer by equality, so the work grows with the text and not with the number
    of names: few names are looked up in the row, more are joined. Runs have the word counts that names
    have. Hits of a key are folded leftmost-longest; what is shuffled is one row per text with its hits,
    beside the runs of words if they are joined. A text without a match has the empty list. ``key`` names
    one text each.
    """
    counts = gazetteer.select(F.size(F.regexp_extract_all("term", F.lit(f"{WORD}+"), F.lit(0))).alias("n")).distinct()
    lengths = sorted(r.n for r in counts.collect() if r.n > 0)
    names = gazetteer.select("term", F.col("label").cast("string").alias("label")).where("term is not null").limit(FEW_NAMES + 1).collect()
    if len(names) <= FEW_NAMES:
        found = df.select(key, _looked_up(F.col(text), names, lengths).alias("_found"))
    else:
        hits = _joined_hits(df, gazetteer, key, text, lengths)
        none = F.array().cast(SPANS)
        found = hits.select(key, F.array(span(F.col("text"), F.col("label"), F.col("start"), F.col("end"))).cast(SPANS).alias("_found"))
        found = found.union(df.select(key, none.alias("_found")))
    lists = found.groupBy(key).agg(F.flatten(F.collect_list("_found")).alias("_found"))
    return lists.select(key, leftmost_longest(F.col("_found")).alias("entities"))


def _looked_up(body: Column, names: Sequence[Row], lengths: Sequence[int]) -> Column:
    """The hits of one text, with names as sets of literals.

    In ASCII text a run of words is spelled out only where its first word begins a name; elsewhere the
    lower case of a word may depend on what follows, so every run is. Of several labels of a name the
    first in order is the one that folding keeps.
    """
    none = F.array().cast(SPANS)
    labels: dict[str, str | None] = {}
    for row in names:
        known = labels.get(row.term, row.label)
        labels[row.term] = None if known is None or row.label is None else min(known, row.label)
    begins = {m.group() for m in (re.match(r"[a-z0-9_]+", term) for term in labels) if m}
    if not labels or not lengths:
        return none
    by_label: dict[str, list[str]] = {}
    for term, label in labels.items():
        if label is not None:
            by_label.setdefault(label, []).append(term)

    def label_of(term: Column) -> Column:
        told = F.lit(None).cast("string")
        for label, terms in by_label.items():
            told = F.when(term.isin(terms), F.lit(label)).otherwise(told)
        return told

    def hits(s: Column) -> Column:
        def run(i: Column, n: int) -> Column:
            # NULL where the text ends before the run does.
            more = [x for k in range(1, n) for x in (F.get(s["gaps"], i + k), F.get(s["words"], i + k))]
            return F.concat(F.get(s["words"], i), *more)

        def runs(n: int, at: Column) -> Column:
            return F.transform(at, lambda i: F.struct(run(i, n).alias("text"), i.alias("at")))

        begun = lambda w, i: F.when(s["odd"] | F.lower(w).isin(list(begins)), i)
        places = F.array_compact(F.transform(s["words"], begun))
        every = let(places, lambda at: F.when(F.size(at) > 0, F.concat(*[runs(n, at) for n in lengths])))
        return let(F.filter(every, lambda c: F.lower(c["text"]).isin(list(labels))), lambda found: placed(s, found))

    def named(c: Column, start: Column) -> Column:
        return span(c["text"], label_of(F.lower(c["text"])), start, start + F.length(c["text"]))

    def placed(s: Column, found: Column) -> Column:
        def chars(parts: Column, n: Column) -> Column:
            return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda total, x: total + F.length(x))

        few = F.transform(found, lambda c: named(c, chars(s["gaps"], c["at"] + 1) + chars(s["words"], c["at"])))
        many = let(word_spans(body), lambda spans: F.transform(found, lambda c: named(c, F.get(spans, c["at"])["start"])))
        return F.when(F.size(found) > _FEW, many).when(F.size(found) > 0, few)

    cut = F.struct(
        F.regexp_extract_all(body, F.lit(f"{WORD}+"), F.lit(0)).alias("words"),
        F.split(body, f"{WORD}+").alias("gaps"),
        (F.octet_length(body) != F.char_length(body)).alias("odd"),
    )
    return F.coalesce(let(cut, hits), none)


def _joined_hits(df: DataFrame, gazetteer: DataFrame, key: str, text: str, lengths: Sequence[int]) -> DataFrame:
    """``key, text, label, start, end``: runs of words joined with a gazetteer of any size."""
    body = F.col(text)
    tokens = df.select(key, word_spans(body).alias("_words"), F.split(body, f"{WORD}+").alias("_gaps"))
    # A word with what stands before it: runs are spelled from these, not from the start of the text.
    pieces = F.zip_with("_words", F.slice("_gaps", 1, F.size("_words")), lambda w, g: F.concat(g, w["token"]))
    tokens = tokens.select(key, "_words", pieces.alias("_pieces"))

    def run(n: int):
        def of(i):
            first = F.get("_words", i)
            more = F.array_join(F.slice("_pieces", i + 2, n - 1), "") if n > 1 else F.lit("")
            return F.struct(
                F.concat(first["token"], more).alias("text"),
                first["start"].alias("start"),
                F.get("_words", i + n - 1)["end"].alias("end"),
            )

        runs = F.transform(F.sequence(F.lit(0), F.size("_words") - n), of)
        return F.when(F.size("_words") >= n, runs).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>"))

    none = F.array().cast("array<struct<text:string,start:int,end:int>>")
    candidates = tokens.select(key, F.inline(F.concat(none, *[run(n) for n in lengths]))).withColumn("term", F.lower("text"))
    return lookup_join(candidates, gazetteer, "term").select(key, "text", "label", "start", "end")


def tag_tokens(texts: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, token, start, end, label`` for texts and a table of spans.

    ``spans`` has ``key, pos, label, start, end``; of several spans that cover a token the first by
    ``pos`` names it. Tokens meet only spans of their own stretch of ``BUCKET`` characters, so a
    long text with many spans does not pair all with all.
    """
    tokens = texts.select(key, F.posexplode(token_spans(F.col(text))).alias("pos", "t")).select(
        key,
        "pos",
        "t.*",
        F.floor(F.col("t.start") / BUCKET).alias("_bucket"),
    )
    stretches = spans.filter(F.col("end") > F.col("start")).select(
        F.col(key),
        F.col("pos").alias("_order"),
        F.col("label").alias("_label"),
        F.col("start").alias("_from"),
        F.col("end").alias("_to"),
        F.explode(
            F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))
        ).alias("_bucket"),
    )
    inside = (F.col("start") >= F.col("_from")) & (F.col("end") <= F.col("_to"))
    met = tokens.join(stretches, [key, "_bucket"], "left")
    named = F.when(inside, F.struct("_order", "_label"))
    return (
        # A token has one bucket, so the join's shuffle serves the grouping too.
        met.groupBy(key, "_bucket", "pos", "token", "start", "end")
        .agg(F.min(named)["_label"].alias("_label"))
        .select(
            key,
            "pos",
            "token",
            "start",
            "end",
            F.coalesce(F.nullif("_label", F.lit("")), F.lit("O")).alias("label"),
        )
    )


def entity_counts(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Entities per label."""
    return (
        df.select(F.explode(entities).alias("e"))
        .groupBy(F.col("e.label").alias("label"))
        .agg(F.count("*").alias("n"))
    )
