"""From complaint text to category, severity, urgency, entities and a log row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardline import vocab
from wardline.functions import checks, rules, scores, spans
from wardline.functions.text import civic_category, normalize_text, title_case
from wardline.operators.arrays import SCORE_LIST, score_column

# A scorer adds ``category_scores``, ``severity_scores`` and ``urgency_scores`` to a frame.
Scorer = Callable[[DataFrame], DataFrame]

SEED_GAZETTEER = {"LOCATION": vocab.PLACES, "PROBLEM": vocab.PROBLEMS}


def stub_scorer(df: DataFrame) -> DataFrame:
    """Even scores and labels picked by a hash of the cleaned text; nothing for a missing text."""
    text = F.col("cleaned_text")
    said = {
        "category_label": scores.hash_pick(text, vocab.STUB_CATEGORY_LABELS),
        "severity_label": scores.hash_pick(text, vocab.SEVERITY_LABELS, "sev"),
        "urgency_label": scores.hash_pick(text, vocab.URGENCY_LABELS, "urg"),
        "category_scores": scores.uniform_scores(vocab.STUB_CATEGORY_LABELS),
        "severity_scores": scores.uniform_scores(vocab.SEVERITY_LABELS),
        "urgency_scores": scores.uniform_scores(vocab.URGENCY_LABELS),
    }
    return df.withColumns({name: F.when(text.isNotNull(), value) for name, value in said.items()})


def joined_scorer(head_scores: DataFrame, key: str) -> Scorer:
    """Scores computed elsewhere, one row per ``key``; tables bucketed by it join in place."""
    return lambda df: df.join(head_scores, key, "left")


# Maps a list of texts to one score matrix [text, label] per head; None where a head failed.
Predictor = Callable[[list[str]], Mapping[str, np.ndarray | None]]


def model_scorer(
    load: Callable[[], Predictor], heads: Mapping[str, Sequence[str]], batch_size: int = 16
) -> Scorer:
    """Score with any model in Python, by Arrow batch and without a shuffle.

    ``load`` runs once per task, inside the worker, so that only its name travels. All other columns
    pass through as they are, in Arrow. The model sees no missing text; such rows, rows with a score
    that is no number, and batches for which a head gave nothing have NULL for that head.
    """
    def scorer(df: DataFrame) -> DataFrame:
        schema = T.StructType(list(df.schema.fields))
        place = df.columns.index("cleaned_text")
        for head in heads:
            schema = schema.add(f"{head}_scores", SCORE_LIST)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = load()
            for batch in batches:
                texts = batch.column(place).to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                found: dict[str, np.ndarray] = {h: np.full((len(texts), len(x)), np.nan) for h, x in heads.items()}
                for at in range(0, len(there), batch_size):
                    part = there[at : at + batch_size]
                    given = predict([texts[i] for i in part])
                    for head in heads:
                        if given.get(head) is not None:
                            found[head][part] = given[head]
                lists = [score_column(m, heads[h], ~np.isfinite(m).all(axis=1)) for h, m in found.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], schema=to_arrow_schema(schema))

        return df.mapInArrow(run, schema)

    return scorer


def _head_label(df: DataFrame, head: str) -> Column | None:
    return F.col(f"{head}_label") if f"{head}_label" in df.columns else None


def enrich_complaints(
    df: DataFrame,
    scorer: Scorer,
    text: str = "complaint_text",
    profile: str = "live",
    gazetteer: Mapping[str, Sequence[str]] | None = SEED_GAZETTEER,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Analyse every complaint; narrow apart from what the scorer does.

    Severity rules read the raw text, urgency rules the cleaned one. Without a gazetteer the frame
    brings its own ``entities``. Score lists are checked before use: a list that is missing, empty or
    broken counts as none and is named in ``violations`` as ``head:code``. Without category scores
    the keyword category stands, severity and urgency fall back to fixed answers. ``violations``
    selects the rows concerned; no row stops the others.
    """
    raw = F.col(text)
    given = scorer(df.withColumn("cleaned_text", normalize_text(raw)))
    codes = F.array(*[
        F.concat(F.lit(f"{h}:"), _score_error(F.col(f"{h}_scores"))) for h in ("category", "severity", "urgency")
    ])
    base = given.withColumn("violations", F.array_compact(codes)).withColumns({
        f"{h}_scores": F.when(_score_error(F.col(f"{h}_scores")).isNull(), F.col(f"{h}_scores"))
        for h in ("category", "severity", "urgency")
    })
    label = _head_label(base, "category")
    best = scores.top(F.col("category_scores"))
    found = F.col("entities") if gazetteer is None else spans.gazetteer_spans(raw, gazetteer)
    hinted = base.select(
        *keep,
        F.col(text).alias("raw_text"),
        "cleaned_text",
        "category_scores",
        "severity_scores",
        "urgency_scores",
        (label if label is not None else best["label"]).alias("_model_label"),
        best["score"].alias("issue_confidence"),
        "violations",
        *[F.col(f"{h}_label") for h in ("severity", "urgency") if f"{h}_label" in base.columns],
        rules.keyword_category(raw).alias("_keyword"),
        rules.severity_hint(raw).alias("_severity_hint"),
        rules.urgency_hint(F.col("cleaned_text")).alias("_urgency_hint"),
        spans.clean_entities(found).alias("entities"),
    )
    decided = hinted.select(
        "*",
        F.when(F.col("_model_label").isNull(), F.col("_keyword")).otherwise(civic_category(F.col("_model_label"))).alias("_model_category"),
        scores.severity_decision(
            F.col("severity_scores"), F.col("_severity_hint"), profile, _head_label(hinted, "severity")
        ).alias("_severity"),
        scores.urgency_decision(
            F.col("urgency_scores"), F.col("_urgency_hint"), profile, _head_label(hinted, "urgency")
        ).alias("_urgency"),
    )
    fusion = F.col("_model_category"), F.col("_keyword"), F.col("issue_confidence")
    return decided.select(
        *keep,
        rules.fused_category(*fusion).alias("issue_type"),
        "issue_confidence",
        F.col("_severity.label").alias("severity"),
        F.col("_severity.confidence").alias("severity_confidence"),
        F.col("_urgency.label").alias("urgency"),
        F.col("_urgency.confidence").alias("urgency_confidence"),
        "entities",
        spans.first_location(F.col("entities")).alias("location"),
        "cleaned_text",
        "raw_text",
        F.lit("stub" if profile == "stub" else "production").alias("mode"),
        F.size("entities").alias("entity_count"),
        rules.fused_rationale(
            *fusion, rules.category_rationale(F.col("raw_text"), F.col("_keyword"))
        ).alias("issue_rationale"),
        scores.category_probabilities(F.col("category_scores"), ranked=profile != "stub").alias(
            "issue_probabilities"
        ),
        F.col("_severity.scores").alias("severity_scores"),
        F.col("_urgency.scores").alias("urgency_scores"),
        "violations",
    )


def _score_error(entries: Column) -> Column:
    """Code of the first error of a score list, NULL when it can be used."""
    wrong = F.exists(entries, lambda x: F.isnan(x["score"].cast("double")))
    return F.coalesce(checks.scores_error(entries), F.when(wrong, F.lit("score_not_a_number")))


def violations(enriched: DataFrame) -> DataFrame:
    """The analysed rows with a broken score list."""
    return enriched.filter(F.size("violations") > 0)


def log_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Project analysed complaints to the log columns, blanks for what is missing."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    body = "raw_text" if "raw_text" in df.columns else "complaint_text"
    if "location" not in df.columns and "entities" in df.columns:
        location = spans.first_location(spans.clean_entities(F.col("entities")))
    else:
        location = text("location")
    return df.select(
        *keep,
        text("created_at").alias("created_at"),
        text("issue_type").alias("issue_type"),
        title_case(text("severity")).alias("severity"),
        title_case(text("urgency")).alias("urgency"),
        location.alias("location"),
        text(body).alias("complaint_text"),
    )
