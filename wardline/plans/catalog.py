"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import checks, rules, scores, spans, text
from wardline.operators import dashboard, enrich, entities, features, heads, quality, rule_tables, sketches, softmax_heads, span_quality as span_scores, weak_labels
from wardline.session import shared_dir
from wardline.sources import commits, fixtures, sinks, tables
from wardline.sources.tables import fill_blank, pad_log, union_log
from wardline.streaming import cubes, live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

DOCUMENT_HEADS = {"quality": ["0", "1"], "toxic": ["0", "1"]}
WEAK_HEADS = {
    "category": vocab.CATEGORY_LABELS,
    "severity": ["LOW", "MEDIUM", "HIGH"],
    "urgency": ["NEUTRAL", "CONCERNED", "URGENT"],
}
MODEL_HEADS = {
    "category": ["LABEL_6", "road_works", "Health Dept"],
    "severity": vocab.SEVERITY_LABELS,
    "urgency": ["NEUTRAL", "CONCERNED", "URGENT"],
}
AS_OF = date(2024, 1, 15)
EMBEDDING_DIM = 64
HASH_DIM = 32
DOCUMENT_KEYWORDS = ["the", "en", "er", "aa", "de"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


# --- sources and projections -----------------------------------------------------


@query
def log_schema_pad(spark, sf):
    return pad_log(
        fixtures.complaints(spark, sf).select("complaint_id", "complaint_text", "location")
    )


@query
def raw_fill_blank(spark, sf):
    return fill_blank(fixtures.grievances(spark, sf)).toDF(
        "grievance_id", "category", "sub_category", "ward_name", "staff_remarks"
    )


@query
def log_union(spark, sf):
    log = fixtures.complaint_log(spark, sf).select("issue_type", "severity", "complaint_text")
    rows = weak_labels.build_weak_labels(fixtures.grievances(spark, sf)).select(
        F.col("text").alias("complaint_text"), F.col("category").alias("issue_type"), "urgency"
    )
    return union_log(log, rows)


@query
def log_projection(spark, sf):
    log = fixtures.complaint_log(spark, sf)
    return enrich.log_rows(
        log.withColumn("severity", F.lower("severity")).withColumn("urgency", F.upper("urgency")),
        "complaint_id",
    )


# --- text ----------------------------------------------------------------------------


@query
def normalize_text(spark, sf):
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("cleaned")
    )


@query
def normalize_complaints(spark, sf):
    return fixtures.complaints(spark, sf).select(
        "complaint_id", text.normalize_text(F.col("complaint_text")).alias("cleaned")
    )


@query
def normalize_conversations(spark, sf):
    return fixtures.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.normalize_text(F.col("text")).alias("cleaned")
    )


@query
def compose_text(spark, sf):
    raw = fixtures.grievances(spark, sf)
    body = text.compose_text(*[F.col(f"`{c}`") for c in vocab.RAW_COLUMNS])
    return raw.select("grievance_id", body.alias("text"))


@query
def title_case(spark, sf):
    raw = fixtures.grievances(spark, sf)
    return raw.select(
        "grievance_id",
        text.title_case(F.col("Category")).alias("category"),
        text.title_case(F.col("Staff Remarks")).alias("remarks"),
        text.title_case(F.lower("Ward Name")).alias("ward"),
    )


@query
def title_case_documents(spark, sf):
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", text.title_case(F.col("text")).alias("title")
    )


@query
def map_category(spark, sf):
    return fixtures.complaint_log(spark, sf).select(
        "complaint_id", text.civic_category(F.col("issue_type")).alias("issue_category")
    )


@query
def map_urgency(spark, sf):
    weak = weak_labels.build_weak_labels(fixtures.grievances(spark, sf), "grievance_id")
    return weak.select(
        "grievance_id",
        text.urgency_label(F.col("urgency")).alias("urgency"),
        text.urgency_label(F.col("text")).alias("urgency_of_text"),
    )


@query
def text_preview(spark, sf):
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", text.preview(F.col("text")).alias("preview")
    )


@query
def format_ts(spark, sf):
    events = fixtures.table(spark, sf, "events")
    shown = F.when(F.col("event_type") != "error", F.col("ts"))
    return events.select("event_id", text.display_time(shown).alias("shown"))


@query
def keyword_counts(spark, sf):
    return fixtures.complaints(spark, sf).select(
        "complaint_id", *text.keyword_counts(F.col("complaint_text"))
    )


@query
def keyword_counts_documents(spark, sf):
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", *text.keyword_counts(F.col("text"), DOCUMENT_KEYWORDS)
    )


# --- rules ---------------------------------------------------------------------------


@query
def severity_rule(spark, sf):
    return fixtures.complaints(spark, sf).select(
        "complaint_id", rules.severity_hint(F.col("complaint_text")).alias("severity")
    )


@query
def urgency_rule(spark, sf):
    cleaned = fixtures.complaints(spark, sf).select(
        "complaint_id", text.normalize_text(F.col("complaint_text")).alias("cleaned")
    )
    urgent, concerned = rules.urgency_hits(F.col("cleaned"))
    return cleaned.select(
        "complaint_id",
        rules.urgency_hint(F.col("cleaned")).alias("urgency"),
        urgent.alias("urgent_hits"),
        concerned.alias("concerned_hits"),
    )


@query
def category_rule(spark, sf):
    return fixtures.complaints(spark, sf).select(
        "complaint_id", rules.keyword_category(F.col("complaint_text")).alias("category")
    )


@query
def rule_evidence(spark, sf):
    rows = fixtures.complaints(spark, sf).select(
        "complaint_id",
        "complaint_text",
        rules.keyword_category(F.col("complaint_text")).alias("category"),
    )
    return rows.select(
        "complaint_id",
        "category",
        rules.category_rationale(F.col("complaint_text"), F.col("category")).alias("rationale"),
    )


@query
def rules_documents(spark, sf):
    body = F.col("text")
    return fixtures.table(spark, sf, "documents").select(
        "doc_id",
        rules.severity_hint(body).alias("severity"),
        rules.urgency_hint(body).alias("urgency"),
        rules.keyword_category(body).alias("category"),
    )


@query
def rules_conversations(spark, sf):
    body = F.col("text")
    return fixtures.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        rules.severity_hint(body).alias("severity"),
        rules.urgency_hint(body).alias("urgency"),
        rules.keyword_category(body).alias("category"),
    )


def _category_table(spark, sf, **options):
    rows = fixtures.complaints(spark, sf).select("complaint_id", "complaint_text")
    rules_ = rule_tables.rule_table(spark, vocab.CATEGORY_KEYWORDS)
    return rule_tables.table_category(rows, rules_, "complaint_text", **options).drop("complaint_text")


@query
def rule_table_category(spark, sf):
    """The category rule with its lists held as a table."""
    return _category_table(spark, sf)


@query
def rule_table_category_join(spark, sf):
    """The same where rules are too large to send out."""
    return _category_table(spark, sf, most_bytes=0)


@query
def rule_table_levels(spark, sf):
    """Levels of whole words; the first level with a hit counts."""
    lists = {"High": vocab.SEVERITY_HIGH, "Medium": vocab.SEVERITY_MEDIUM, "Low": vocab.SEVERITY_LOW}
    rows = fixtures.complaints(spark, sf).select("complaint_id", "complaint_text")
    matched = rule_tables.match_rules(rows, rule_tables.rule_table(spark, lists, whole_words=True), "complaint_text")
    level = rule_tables.first_level(F.col("rule_matches"))
    return matched.select(
        "complaint_id", level["category"].alias("severity"), F.array_join(level["keywords"], ",").alias("keywords")
    )


def _phrase_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of neighbouring words of each benchmark item: whole words for odd items, substrings for even ones."""
    parts = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    items = fixtures.table(spark, sf, "benchmark").select("item_id", parts.alias("w")).where("size(w) > 1")
    return items.select(
        F.col("item_id").cast("string").alias("category"),
        F.col("item_id").cast("int").alias("priority"),
        F.explode(F.array_distinct(pairs)).alias("keyword"),
        (F.col("item_id") % 2 == 1).alias("whole_words"),
    )


def _phrases(spark, sf, **options):
    docs = fixtures.table(spark, sf, "documents").select("doc_id", "text")
    matched = rule_tables.match_rules(docs, _phrase_rules(spark, sf), "text", **options)
    best = rule_tables.most_hits(F.col("rule_matches"))
    return matched.select(
        "doc_id",
        best["category"].alias("item"),
        best["hits"].cast("long").alias("hits"),
        F.size("rule_matches").cast("long").alias("items"),
        F.md5(F.array_join(best["keywords"], "|")).alias("keywords"),
    )


@query
def rule_table_phrases(spark, sf):
    """A rule table that grows with the data: which benchmark item a document shares most phrases with."""
    return _phrases(spark, sf)


@query
def rule_table_phrases_join(spark, sf):
    return _phrases(spark, sf, most_bytes=0)


@query
def category_fusion(spark, sf):
    rows = fixtures.complaints(spark, sf).select(
        "complaint_id",
        "complaint_text",
        "model_confidence",
        text.civic_category(F.col("model_label")).alias("model"),
        rules.keyword_category(F.col("complaint_text")).alias("keyword"),
    )
    fusion = F.col("model"), F.col("keyword"), F.col("model_confidence")
    why = rules.category_rationale(F.col("complaint_text"), F.col("keyword"))
    return rows.select(
        "complaint_id",
        rules.fused_category(*fusion).alias("category"),
        rules.fused_rationale(*fusion, why).alias("rationale"),
    )


def _weak_rule(spark, sf, name, rule):
    raw = fixtures.grievances(spark, sf)
    return raw.select("grievance_id", rule(F.col("Sub Category"), F.col("Staff Remarks")).alias(name))


@query
def weak_severity(spark, sf):
    return _weak_rule(spark, sf, "severity", rules.weak_severity)


@query
def weak_urgency(spark, sf):
    return _weak_rule(spark, sf, "urgency", rules.weak_urgency)


@query
def weak_label_etl(spark, sf):
    return weak_labels.build_weak_labels(fixtures.grievances(spark, sf), "grievance_id")


def _recommended(log: DataFrame) -> Column:
    blank = F.lit("")
    return rules.recommendations(
        F.coalesce("severity", blank), F.coalesce("urgency", blank), text.civic_category(F.col("issue_type"))
    )


@query
def recommendations(spark, sf):
    log = fixtures.complaint_log(spark, sf)
    return log.select("complaint_id", F.array_join(_recommended(log), " | ").alias("recommendations"))


@query
def recommendation_load(spark, sf):
    log = fixtures.complaint_log(spark, sf)
    return dashboard.recommendation_load(log, _recommended(log))


# --- scores --------------------------------------------------------------------------


def _labelled_documents(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", "text").join(
        fixtures.table(spark, sf, "labels"), "doc_id"
    )


def _document_model(spark, sf):
    return heads.train_naive_bayes(
        _labelled_documents(spark, sf), "text", DOCUMENT_HEADS, shared_dir(spark, "document-heads")
    )


def _long_scores(df: DataFrame, key: str, names) -> DataFrame:
    def rows_of(head: str) -> Column:
        return F.transform(
            f"{head}_scores",
            lambda x: F.struct(F.lit(head).alias("head"), x["label"].alias("label"), x["score"].alias("score")),
        )

    return df.select(key, F.inline(F.concat(*[rows_of(head) for head in names])))


@query
def nb_train(spark, sf):
    return heads.model_table(_document_model(spark, sf)).select(
        "term", "head", "label", _r("weight").alias("weight")
    )


@query
def nb_score(spark, sf):
    scored = heads.score_heads(
        fixtures.table(spark, sf, "documents"), _document_model(spark, sf), "doc_id", "text"
    )
    return _long_scores(scored, "doc_id", DOCUMENT_HEADS).select(
        "doc_id", "head", "label", _r("score").alias("score")
    )


HELD_OUT = 5  # one labelled row in so many is kept from training


def _held_out() -> Column:
    """Told by a hash of the key, so a row stays on its side whatever else is labelled."""
    return F.conv(F.left(F.md5(F.col("doc_id").cast("string")), F.lit(8)), 16, 10).cast("bigint") % HELD_OUT == 0


@query
def eval_metrics(spark, sf):
    """Heads trained on one part of the labelled rows, judged on both."""
    truth = _labelled_documents(spark, sf).withColumn(
        "part", F.when(_held_out(), "held_out").otherwise("trained")
    )
    train = truth.filter("part = 'trained'")
    model = heads.train_naive_bayes(train, "text", DOCUMENT_HEADS, shared_dir(spark, "document-heads"))
    return _judged_heads(heads.row_scorer(model, "text")(truth))


def _judged_heads(scored: DataFrame) -> DataFrame:
    per_head = F.array(
        *[
            F.struct(
                F.struct(F.col("part"), F.lit(h).alias("head")).alias("which"),
                F.col(h).cast("string").alias("truth"),
                scores.top(F.col(f"{h}_scores"))["label"].alias("predicted"),
            )
            for h in DOCUMENT_HEADS
        ]
    )
    rows = scored.select(F.inline(per_head))
    result = heads.evaluate(rows, F.col("which"), F.col("truth"), F.col("predicted"))
    return result.select(
        "head.part", "head.head", "n", _r("accuracy").alias("accuracy"), _r("weighted_f1").alias("weighted_f1")
    )


@query
def softmax_eval(spark, sf):
    """The same rows and measures with heads trained by softmax regression until the loss stays."""
    truth = _labelled_documents(spark, sf).withColumn("part", F.when(_held_out(), "held_out").otherwise("trained"))
    train = truth.filter("part = 'trained'")
    model = softmax_heads.train_softmax(train, "doc_id", "text", DOCUMENT_HEADS, shared_dir(spark, "softmax-heads"), l2=1e-4)
    return _judged_heads(truth.join(softmax_heads.score_softmax(truth, model, "doc_id", "text"), "doc_id"))


@query
def stub_scores(spark, sf):
    cleaned = fixtures.complaints(spark, sf).withColumn(
        "cleaned_text", text.normalize_text(F.col("complaint_text"))
    )
    stub = enrich.stub_scorer(cleaned)
    return stub.select(
        "complaint_id",
        "category_label",
        "severity_label",
        "urgency_label",
        *[_r(scores.top(F.col(f"{h}_scores"))["score"]).alias(f"{h}_score") for h in ("category", "severity", "urgency")],
    )


@query
def normalize_scores(spark, sf):
    rows = fixtures.damaged_scores(spark, sf).withColumn(
        "entries",
        F.transform("entries", lambda x: F.struct(x["label"].alias("label"), x["score"].try_cast("double").alias("score"))),
    )
    kept = scores.normalize_scores(F.col("entries"))
    return rows.select("doc_id", F.posexplode(kept).alias("pos", "x")).select(
        "doc_id", "pos", "x.label", _r("x.score").alias("score")
    )


@query
def top_label(spark, sf):
    rows = fixtures.document_scores(spark, sf).select("doc_id", scores.top(F.col("scores")).alias("t"))
    return rows.select("doc_id", "t.label", _r("t.score").alias("score"))


MODEL_LABELS = ["LABEL_6", "road_works", "Street Lighting Fault", "", "water_supply_disruption", "LABEL_28"]


@query
def category_probs(spark, sf):
    listed = fixtures.probability(F.col("complaint_id"), MODEL_LABELS)
    rows = fixtures.complaints(spark, sf).select("complaint_id", listed.alias("scores"))
    return rows.select(
        "complaint_id", F.posexplode(scores.category_probabilities(F.col("scores"))).alias("pos", "x")
    ).select("complaint_id", "pos", "x.label", _r("x.score", 9).alias("score"))


def _fusion(spark, sf, labels, zero_guard):
    doc = F.col("doc_id")
    target = fixtures.phrase(labels, doc)
    minimum = F.get(F.array(F.lit(0.65), F.lit(0.75), F.lit(0.85)), (doc % 3).cast("int"))
    fused = fixtures.document_scores(spark, sf).select(
        "doc_id", F.posexplode(scores.fuse_hint(F.col("scores"), target, minimum, zero_guard)).alias("pos", "x")
    )
    return fused.select("doc_id", "pos", "x.label", _r("x.score", 9).alias("score"))


FUSION_TARGETS = ["Low", "Medium", "High", "Severe"]


@query
def severity_fusion(spark, sf):
    return _fusion(spark, sf, FUSION_TARGETS, True)


@query
def urgency_fusion(spark, sf):
    return _fusion(spark, sf, FUSION_TARGETS, False)


def _decided(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(
        key,
        "d.label",
        _r("d.confidence", 9).alias("confidence"),
        F.array_join(
            F.transform(
                "d.scores", lambda x: F.format_string("%s=%.4f", x["label"], F.round(x["score"] + 1e-9, 4))
            ),
            ", ",
        ).alias("scores"),
    )


def _hinted(spark, sf):
    rows = fixtures.complaints(spark, sf)
    body = F.col("complaint_text")
    return rows.select(
        "complaint_id",
        rules.severity_hint(body).alias("severity_hint"),
        rules.urgency_hint(text.normalize_text(body)).alias("urgency_hint"),
        fixtures.probability(F.col("complaint_id"), vocab.SEVERITY_LABELS).alias("severity_scores"),
        fixtures.probability(F.col("complaint_id"), ["NEUTRAL", "CONCERNED", "URGENT"]).alias("urgency_scores"),
    )


@query
def severity_decision(spark, sf):
    decision = scores.severity_decision(F.col("severity_scores"), F.col("severity_hint"))
    return _decided(_hinted(spark, sf).select("complaint_id", decision.alias("d")), "complaint_id")


@query
def urgency_decision(spark, sf):
    decision = scores.urgency_decision(F.col("urgency_scores"), F.col("urgency_hint"))
    return _decided(_hinted(spark, sf).select("complaint_id", decision.alias("d")), "complaint_id")


@query
def score_fallback(spark, sf):
    none = F.lit(None).cast(scores.SCORES)
    rows = _hinted(spark, sf).select(
        "complaint_id",
        scores.severity_decision(none, F.col("severity_hint")).alias("s"),
        scores.urgency_decision(none, F.col("urgency_hint")).alias("u"),
    )
    return rows.select(
        "complaint_id",
        F.col("s.label").alias("severity"),
        _r("s.confidence").alias("severity_confidence"),
        F.size("s.scores").alias("severity_entries"),
        F.col("u.label").alias("urgency"),
        _r("u.confidence").alias("urgency_confidence"),
        _r(scores.total(F.col("u.scores"))).alias("urgency_mass"),
    )


def _flat(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        "complaint_id",
        "issue_type",
        _r("issue_confidence").alias("issue_confidence"),
        "severity",
        _r("severity_confidence").alias("severity_confidence"),
        "urgency",
        _r("urgency_confidence").alias("urgency_confidence"),
        spans.entity_caption(F.col("entities")).alias("entities"),
        "location",
        "cleaned_text",
        "raw_text",
        "mode",
        "entity_count",
        "issue_rationale",
    )


@query
def enrich_stub(spark, sf):
    return _flat(
        enrich.enrich_complaints(
            fixtures.complaints(spark, sf).select("complaint_id", "complaint_text"),
            enrich.stub_scorer,
            profile="stub",
            keep=["complaint_id"],
        )
    )


@query
def enrich_documents(spark, sf):
    rows = fixtures.table(spark, sf, "documents").select(
        F.col("doc_id").alias("complaint_id"), F.col("text").alias("complaint_text")
    )
    return _flat(
        enrich.enrich_complaints(rows, enrich.stub_scorer, profile="stub", keep=["complaint_id"])
    )


def trained_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Heads trained on the weakly labelled grievances, applied to the complaints."""
    weak = weak_labels.build_weak_labels(fixtures.grievances(spark, sf))
    model = heads.train_naive_bayes(weak, "text", WEAK_HEADS, shared_dir(spark, "weak-heads"))
    rows = fixtures.complaints(spark, sf).select("complaint_id", "complaint_text")
    score = heads.row_scorer(model)
    # Heads are trained on upper-case labels; severity hints are in title case.
    titled = F.transform("severity_scores", lambda x: scores.entry(text.title_case(x["label"]), x["score"]))
    return enrich.enrich_complaints(
        rows, lambda df: score(df).withColumn("severity_scores", titled), keep=["complaint_id"]
    )


@query
def enrich_complaints(spark, sf):
    return _flat(trained_enrichment(spark, sf))


def length_predictor():
    """Scores that follow from the length of the text: a model for trying out the interface."""
    def predict(texts: list[str]) -> dict[str, np.ndarray]:
        size = np.array([[len(t)] for t in texts])

        def head(labels) -> np.ndarray:
            raw = (1 + (size * 7919 + np.arange(len(labels)) * 104729) % 97).astype(float)
            return raw / raw.sum(axis=1, keepdims=True)

        return {name: head(labels) for name, labels in MODEL_HEADS.items()}

    return predict


@query
def enrich_model(spark, sf):
    return _flat(
        enrich.enrich_complaints(
            fixtures.complaints(spark, sf).select("complaint_id", "complaint_text"),
            enrich.model_scorer(length_predictor, MODEL_HEADS),
            keep=["complaint_id"],
        )
    )


# --- entities ------------------------------------------------------------------------


def _span_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, F.posexplode(column).alias("pos", "e")).select(
        key, "pos", F.col("e.text").alias("text"), F.col("e.label").alias("label"),
        F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"),
    )


def _cleaned_entities(spark, sf):
    return fixtures.raw_entities(spark, sf).withColumn(
        "entities", spans.clean_entities(F.col("entities"))
    )


@query
def gazetteer_entities(spark, sf):
    names = entities.seed_gazetteer(spark)
    found = entities.extract_entities(fixtures.complaints(spark, sf), names, "complaint_id", "complaint_text")
    return _span_rows(found, "complaint_id", "entities")


@query
def gazetteer_entities_inline(spark, sf):
    found = spans.gazetteer_spans(F.col("complaint_text"), enrich.SEED_GAZETTEER)
    rows = fixtures.complaints(spark, sf).select("complaint_id", found.alias("entities"))
    return _span_rows(rows, "complaint_id", "entities")


@query
def span_quality(spark, sf):
    """Gazetteer entities judged by the entity lists that complaints carry, places under one label."""
    names = entities.seed_gazetteer(spark)
    found = entities.extract_entities(fixtures.complaints(spark, sf), names, "complaint_id", "complaint_text")
    places = ["LOC", "GPE", "LOCATION"]
    sides = [span_scores.one_label(span_scores.span_rows(x, "complaint_id"), places, "LOC") for x in (found, _cleaned_entities(spark, sf))]
    done = span_scores.span_quality(*sides)
    return done.select(*[_r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in done.dtypes])


@query
def clean_entities(spark, sf):
    return _span_rows(_cleaned_entities(spark, sf), "complaint_id", "entities")


@query
def first_location(spark, sf):
    return _cleaned_entities(spark, sf).select(
        "complaint_id", spans.first_location(F.col("entities")).alias("location")
    )


def _token_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "complaint_id", "pos", "token", F.col("start").alias("token_start"), F.col("end").alias("token_end"), "label"
    )


@query
def token_tags(spark, sf):
    tags = spans.token_tags(F.col("complaint_text"), F.col("entities"))
    rows = _cleaned_entities(spark, sf).select("complaint_id", F.posexplode(tags).alias("pos", "t"))
    return _token_columns(rows.select("complaint_id", "pos", "t.*"))


@query
def token_tags_table(spark, sf):
    rows = _cleaned_entities(spark, sf)
    listed = rows.select("complaint_id", F.posexplode("entities").alias("pos", "e")).select(
        "complaint_id", "pos", "e.*"
    )
    return _token_columns(entities.tag_tokens(rows, listed, "complaint_id", "complaint_text"))


@query
def token_offsets_documents(spark, sf):
    tokens = fixtures.table(spark, sf, "documents").select(
        "doc_id", text.token_spans(F.col("text")).alias("t")
    )
    last = F.get("t", F.size("t") - 1)
    starts = F.aggregate("t", F.lit(0).cast("bigint"), lambda acc, x: acc + x["start"])
    return tokens.select(
        "doc_id", F.size("t").alias("tokens"), starts.alias("start_sum"), last["end"].alias("last_end")
    )


@query
def entity_caption(spark, sf):
    rows = _cleaned_entities(spark, sf)
    tags = spans.token_tags(F.col("complaint_text"), F.col("entities"))
    return rows.select(
        "complaint_id",
        spans.entity_caption(F.col("entities")).alias("caption"),
        spans.tagged_inline(tags).alias("inline"),
    )


@query
def text_segments(spark, sf):
    pieces = spans.text_segments(F.col("complaint_text"), F.col("entities"))
    shown = F.transform(
        pieces, lambda p: F.concat(p["piece"], F.lit("<"), F.coalesce(p["label"], F.lit("-")), F.lit(">"))
    )
    return _cleaned_entities(spark, sf).select("complaint_id", F.array_join(shown, "|").alias("segments"))


@query
def entity_counts(spark, sf):
    return entities.entity_counts(_cleaned_entities(spark, sf))


# --- dashboards ----------------------------------------------------------------------


def _log_query(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: build(fixtures.complaint_log(spark, sf))


_log_query("top_issue", lambda log: dashboard.most_frequent(log, "issue_type"))
_log_query("top_location", lambda log: dashboard.most_frequent(log, "location"))
_log_query("urgent_share", dashboard.urgent_share)
_log_query("urgent_share_any", lambda log: dashboard.urgent_share(log, dashboard.ANY_URGENT))
_log_query("log_summary", lambda log: dashboard.log_summary(log, AS_OF, dashboard.ANY_URGENT))
_log_query("issue_distribution", dashboard.issue_distribution)
_log_query("severity_distribution", lambda log: dashboard.label_distribution(log, "severity"))
_log_query("severity_urgency", dashboard.severity_urgency)
_log_query("severity_urgency_pivot", dashboard.severity_urgency_pivot)
_log_query("daily_counts", dashboard.daily_counts)
_log_query("daily_urgency", dashboard.daily_urgency)
_log_query("latest_complaints", dashboard.latest)
_log_query("recent_analyses", dashboard.recent_analyses)
_log_query("top_terms", dashboard.top_terms)
_log_query("location_hotspots", dashboard.location_hotspots)
_log_query(
    "daily_counts_range",
    lambda log: dashboard.daily_counts(dashboard.in_range(log, "2024-01-10", "2024-01-20")),
)
_log_query("dashboard_rollup", dashboard.dashboard_rollup)


@query
def top_terms_documents(spark, sf):
    return dashboard.top_terms(fixtures.table(spark, sf, "documents"), "text")


# --- quality -------------------------------------------------------------------------


@query
def heavy_terms_documents(spark, sf):
    """The same from sketches, with the proof that none is lost."""
    return sketches.heavy_terms(fixtures.table(spark, sf, "documents"), "text", tracked=100_000)


@query
def distinct_by_range(spark, sf):
    """Distinct issues and places of three ranges from stored sketches per day."""
    path, columns = shared_dir(spark, "distinct"), ["issue_type", "location"]
    sketches.daily_distinct(fixtures.complaint_log(spark, sf), columns).write.parquet(path)
    stored = spark.read.parquet(path)
    ranges = {"all": None, "one day": F.col("day") == "2024-01-05", "a week": F.col("day").between("2024-01-08", "2024-01-14")}
    parts = [sketches.merged_distinct(stored, columns, days).select(F.lit(n).alias("days"), "*") for n, days in ranges.items()]
    return parts[0].union(parts[1]).union(parts[2])


def _checked_scores(spark, sf, min_confidence=0.0):
    entries = F.col("entries")
    return quality.check(
        fixtures.damaged_scores(spark, sf),
        checks.scores_error(entries, min_confidence),
        checks.scores_warnings(entries, ["Low", "High"], min_confidence),
    )


@query
def validate_scores(spark, sf):
    return _checked_scores(spark, sf).select(
        "doc_id", "error", F.array_join("warnings", ",").alias("warnings")
    )


@query
def min_confidence_filter(spark, sf):
    clean, _ = quality.split(_checked_scores(spark, sf, 0.3))
    kept = checks.kept_scores(F.col("entries"), 0.3)
    return clean.select("doc_id", F.inline(kept)).select("doc_id", "label", _r("score").alias("score"))


@query
def validate_probabilities(spark, sf):
    rows = fixtures.damaged_scores(spark, sf)
    values = F.transform("entries", lambda x: F.coalesce(x["score"].try_cast("double"), F.lit(0.0)))
    label = F.get("entries", F.lit(1))["label"]
    checked = quality.check(
        rows.select("doc_id", label.alias("label"), values.alias("p")),
        checks.prediction_error(F.col("label")),
        checks.probability_warnings(F.col("p"), F.col("label"), ["Low", "High"]),
    )
    return checked.select("doc_id", "error", F.array_join("warnings", ",").alias("warnings"))


@query
def match_rows(spark, sf):
    documents = fixtures.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    probabilities = fixtures.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim")
    )
    return quality.match_rows(documents, probabilities, "doc_id")


@query
def validate_vectors(spark, sf):
    vectors = fixtures.table(spark, sf, "embeddings")
    first = F.get("embedding", F.lit(0))
    # Damage that follows from the values: negative first coordinates turn into NaN, large into Inf.
    damaged = (
        F.when(F.col("label") == 0, F.lit(None))
        .when(first < -0.1, F.concat("embedding", F.array(F.lit(float("nan")).cast("float"))))
        .when(first > 0.1, F.concat("embedding", F.array(F.lit(float("inf")).cast("float"))))
        .when(first > 0, F.slice("embedding", 1, EMBEDDING_DIM - 1))
        .otherwise(F.col("embedding"))
    )
    checked = vectors.select("vec_id", damaged.alias("v"))
    return checked.select("vec_id", checks.vector_error(F.col("v"), EMBEDDING_DIM).alias("error"))


@query
def violation_report(spark, sf):
    return quality.report(_checked_scores(spark, sf))


@query
def violation_observed(spark, sf):
    """The same report, observed while the clean rows are written."""
    return quality.write_clean(
        _checked_scores(spark, sf), shared_dir(spark, "clean"), checks.SCORE_ERRORS, checks.SCORE_WARNINGS
    )


# --- features ------------------------------------------------------------------------


def _vocabulary(spark, sf):
    fitted = features.fit_tfidf(fixtures.table(spark, sf, "documents"), "text")
    path = shared_dir(spark, "vocabulary")
    fitted.write.parquet(path)
    return spark.read.schema(fitted.schema).parquet(path)


@query
def tfidf_fit(spark, sf):
    return _vocabulary(spark, sf).select("term", "idx", "cf", "df", _r("idf").alias("idf"))


@query
def tfidf_transform(spark, sf):
    documents = fixtures.table(spark, sf, "documents")
    rows = features.transform_tfidf(documents, _vocabulary(spark, sf), "doc_id", "text")
    return rows.select("doc_id", "idx", _r("value").alias("value"))


@query
def mean_pool(spark, sf):
    vectors = fixtures.table(spark, sf, "embeddings")
    mask = F.when(F.get("embedding", F.lit(0)) > 0, 1).otherwise(0)
    pooled = features.mean_pool(vectors, "label", "embedding", mask)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "x")).select(
        "label", "dim", _r("x", 5).alias("x")
    )


@query
def encode_hash(spark, sf):
    rows = features.hash_block(fixtures.table(spark, sf, "documents"), "doc_id", "text", HASH_DIM)
    return rows.select("doc_id", "idx", _r("value").alias("value"))


def hashing_encoder():
    """One-hot vectors by word hash: the encoder to use when there is no model."""
    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [t.split() for t in texts]
        width = max(max(map(len, tokens)), 1)
        vectors = np.zeros((len(texts), width, HASH_DIM))
        mask = np.zeros((len(texts), width))
        for row, listed in enumerate(tokens):
            for at, word in enumerate(listed):
                vectors[row, at, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % HASH_DIM] = 1.0
                mask[row, at] = 1.0
        return vectors, mask

    return encode


@query
def encode_udf(spark, sf):
    documents = fixtures.table(spark, sf, "documents")
    rows = features.encode_texts(documents, hashing_encoder, "doc_id", "text")
    return rows.select("doc_id", F.posexplode("embedding").alias("idx", "value")).filter("value > 0").select(
        "doc_id", "idx", _r("value").alias("value")
    )


@query
def feature_concat(spark, sf):
    documents = fixtures.table(spark, sf, "documents")
    blocks = [
        (features.transform_tfidf(documents, _vocabulary(spark, sf), "doc_id", "text"), vocab.MAX_FEATURES),
        (features.hash_block(documents, "doc_id", "text", HASH_DIM), HASH_DIM),
        (features.keyword_block(documents, "doc_id", "text", DOCUMENT_KEYWORDS), len(DOCUMENT_KEYWORDS)),
    ]
    return features.concat_blocks(blocks, "doc_id").select("doc_id", "idx", _r("value").alias("value"))


# --- streams -------------------------------------------------------------------------


def _stream_events(spark, sf):
    # The file source wants a folder or a pattern.
    path = f"{sf}/events.parquet"
    return live.read_stream(spark, f"{path}*", spark.read.parquet(path).schema)


@query
def log_roundtrip(spark, sf):
    """The log written by day, read again and counted: blanks must be NULL as before."""
    path = shared_dir(spark, "log")
    sinks.append_log(enrich.log_rows(fixtures.complaint_log(spark, sf)), path)
    return dashboard.location_hotspots(tables.read_enriched_log(spark, path))


@query
def log_range(spark, sf):
    """Days of a range of a written log whose times are text with offsets."""
    log = _offset_log(spark, sf)
    return dashboard.daily_counts(dashboard.in_range(log, "2024-01-10", "2024-01-20"))


@query
def log_range_offsets(spark, sf):
    """The same with bounds that carry offsets and fall on other days in UTC."""
    log = _offset_log(spark, sf)
    return dashboard.daily_counts(dashboard.in_range(log, "2024-01-09T20:30:00-05:00", "2024-01-19T23:30:00-05:00"))


def _offset_log(spark, sf):
    path = shared_dir(spark, "log")
    offset = F.array_position(F.array(F.lit(0), F.lit(1), F.lit(2)), (F.col("complaint_id") % 4).cast("int"))
    shown = F.when(offset == 1, "Z").when(offset == 2, "+05:30").when(offset == 3, "-05:00").otherwise("")
    stamp = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), shown)
    log = fixtures.complaint_log(spark, sf).withColumn("created_at", stamp)
    sinks.append_log(enrich.log_rows(log), path)
    return tables.read_enriched_log(spark, path)


@query
def stream_enrich(spark, sf):
    out, checkpoint = shared_dir(spark, "enriched"), shared_dir(spark, "checkpoint")
    rows = fixtures.complaints_from(_stream_events(spark, sf))
    enriched = live.enrich_stream(
        rows,
        lambda df: _flat(
            enrich.enrich_complaints(df, enrich.stub_scorer, profile="stub", keep=["complaint_id"])
        ),
    )
    live.run_once(enriched, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_daily_urgency(spark, sf):
    out, checkpoint = shared_dir(spark, "daily"), shared_dir(spark, "checkpoint")
    log = fixtures.log_from(fixtures.complaints_from(_stream_events(spark, sf)))
    live.refresh_table(live.live_daily_urgency(log), out, checkpoint).awaitTermination()
    return live.read_refreshed(spark, out)


def _stream_windows(spark, sf, slide=None, width="1 day"):
    out, checkpoint = shared_dir(spark, "windows"), shared_dir(spark, "checkpoint")
    log = fixtures.log_from(fixtures.complaints_from(_stream_events(spark, sf)))
    counted = live.windowed_urgency(log, "1 day", width, slide)
    live.run_once(counted, out, checkpoint).awaitTermination()
    everything, state = shared_dir(spark, "windows-live"), shared_dir(spark, "checkpoint")
    live.refresh_table(counted, everything, state).awaitTermination()
    return live.open_and_closed(live.read_refreshed(spark, everything), spark.read.parquet(out)).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "urgency",
        "n",
        "closed",
    )


@query
def stream_windows(spark, sf):
    return _stream_windows(spark, sf)


@query
def stream_sliding_windows(spark, sf):
    return _stream_windows(spark, sf, "1 day", "2 days")


def _log_in_batches(spark, sf, count: int) -> list[DataFrame]:
    log = fixtures.complaint_log(spark, sf)
    return [log.where(F.pmod(F.xxhash64("complaint_id"), F.lit(count)) == n) for n in range(count)]


def _counted_cube(spark, sf) -> DataFrame:
    """Ten batches and a repeated one, added by two objects as before and after a restart."""
    path, batches = shared_dir(spark, "cube"), _log_in_batches(spark, sf, 10)
    for number in [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]:
        cubes.LiveCube(spark, path, fanout=4).add(batches[number], number)
    return cubes.LiveCube(spark, path).read()


@query
def live_rollup(spark, sf):
    """All charts from the counts of ten batches."""
    return dashboard.cube_rollup(_counted_cube(spark, sf))


@query
def live_hotspots(spark, sf):
    return dashboard.cube_hotspots(_counted_cube(spark, sf))


@query
def live_summary(spark, sf):
    return dashboard.cube_summary(_counted_cube(spark, sf), AS_OF, dashboard.ANY_URGENT).withColumn("last_update", F.col("last_update").cast("timestamp_ntz"))


@query
def stream_cube(spark, sf):
    """Charts of a stream of complaints: enriched and counted, the log is never read again."""
    cube, checkpoint = cubes.LiveCube(spark, shared_dir(spark, "cube")), shared_dir(spark, "checkpoint")
    log = fixtures.log_from(fixtures.complaints_from(_stream_events(spark, sf)))
    cubes.live_cube(log, cube, checkpoint).awaitTermination()
    return dashboard.cube_rollup(cube.read())


@query
def log_committed(spark, sf):
    """A log taken in by batches, one of them twice, and compacted half-way: each row counts once."""
    rows = [enrich.log_rows(b, "complaint_id") for b in _log_in_batches(spark, sf, 4)]
    log = commits.CommittedLog(spark, shared_dir(spark, "log"), rows[0].schema)
    for number in [0, 1, 1, 2]:
        log.append(rows[number], number)
    log.compact()
    log.append(rows[3], 3)
    return log.read().select("complaint_id", "issue_type", "severity", "urgency", "location", "created_date")
