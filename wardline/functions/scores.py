"""Operators on score lists, ``ARRAY<STRUCT<label STRING, score DOUBLE>>`` in head order.

All of them work inside the row, so no score list is ever exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import civic_category, let, urgency_label

SCORES = "array<struct<label:string,score:double>>"
ENTRY = "struct<label:string,score:double>"


def entry(label: Column, score: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), score.cast("double").alias("score"))


def score_list(pairs: Sequence[tuple[str, float | Column]]) -> Column:
    """A list from labels with constants or columns."""
    items = [entry(F.lit(k), v if isinstance(v, Column) else F.lit(float(v))) for k, v in pairs]
    return F.array(*items)


def normalize_scores(entries: Column) -> Column:
    """Entries that have both a label and a score."""
    kept = F.filter(entries, lambda x: x["label"].isNotNull() & x["score"].isNotNull())
    return F.transform(kept, lambda x: entry(x["label"], x["score"]))


def top(scores: Column) -> Column:
    """Entry of highest score, the first one on a tie."""
    ranked = F.transform(
        scores, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("at"), x["label"].alias("label"))
    )
    return let(F.array_max(ranked), lambda m: entry(m["label"], m["score"]))


def by_score(scores: Column) -> Column:
    """Sorted by falling score; equal scores keep their order."""
    keyed = F.transform(
        scores, lambda x, i: F.struct((-x["score"]).alias("k"), i.alias("i"), x["label"].alias("label"))
    )
    return F.transform(F.array_sort(keyed), lambda x: entry(x["label"], -x["k"]))


def score_of(scores: Column, label: Column) -> Column:
    found = F.get(F.filter(scores, lambda x: x["label"] == label), F.lit(0))["score"]
    return F.coalesce(found, F.lit(0.0))


def total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x["score"])


def category_probabilities(scores: Column, ranked: bool = False) -> Column:
    """Scores summed by civic category, in order of first appearance, as shares of the total."""
    def shares(mapped: Column) -> Column:
        whole = total(mapped)
        divisor = F.when(whole <= 0, F.lit(1.0)).otherwise(whole)
        labels = F.array_distinct(F.transform(mapped, lambda x: x["label"]))
        return let(
            divisor,
            lambda d: F.transform(
                labels,
                lambda name: entry(name, total(F.filter(mapped, lambda x: x["label"] == name)) / d),
            ),
        )

    mapped = F.transform(
        scores, lambda x: entry(civic_category(x["label"]), F.coalesce(x["score"], F.lit(0.0)))
    )
    result = let(mapped, shares)
    return by_score(result) if ranked else result


def urgency_scores(scores: Column) -> Column:
    return F.transform(scores, lambda x: entry(urgency_label(x["label"]), x["score"]))


def fuse_hint(scores: Column, target: Column, minimum: Column, zero_guard: bool = True) -> Column:
    """Raise ``target`` to at least ``minimum`` and shrink the others to what is left.

    A missing target is appended. With ``zero_guard`` a list without any mass becomes one-hot;
    without it the rest is split evenly. Of a repeated label the last score counts.
    """
    goal = F.least(F.lit(1.0), minimum)
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - goal)
    full = F.when(
        F.exists(scores, lambda x: x["label"] == target), scores
    ).otherwise(F.concat(scores, F.array(entry(target, F.lit(0.0)))))

    def fuse(items: Column) -> Column:
        last = F.filter(
            items,
            lambda x, i: ~F.exists(
                F.slice(items, i + 2, F.size(items)), lambda y: y["label"] == x["label"]
            ),
        )
        labels = F.array_distinct(F.transform(items, lambda x: x["label"]))
        unique = F.when(F.size(labels) == F.size(items), items).otherwise(last)
        return let(unique, lambda kept: let(rescale(kept), lambda moved: restore(items, moved)))

    def restore(items: Column, moved: Column) -> Column:
        """Repeated labels again, all with the score of their label."""
        return F.when(F.size(items) == F.size(moved), moved).otherwise(
            F.transform(items, lambda x: entry(x["label"], score_of(moved, x["label"])))
        )

    def rescale(kept: Column) -> Column:
        facts = F.struct(
            score_of(kept, target).alias("own"),
            total(F.filter(kept, lambda x: x["label"] != target)).alias("others"),
            (F.size(kept) - 1).alias("n"),
        )
        return let(
            facts,
            lambda f: F.transform(
                kept, lambda x: entry(x["label"], fused(x["label"] == target, x["score"], f))
            ),
        )

    def fused(is_target: Column, score: Column, f: Column) -> Column:
        mass = f["own"] + f["others"]
        share = (
            F.when((f["others"] > 0) & (rest > 0), score * rest / f["others"])
            .otherwise(rest / F.greatest(f["n"], F.lit(1)))
        )
        raised = (
            F.when(is_target, goal).otherwise(share)
            / F.when(f["n"] > 0, goal + rest).otherwise(goal)
        )
        kept = F.when(mass > 0, score / mass).otherwise(score)
        result = F.when(f["own"] < minimum, raised).otherwise(kept)
        if zero_guard:
            return F.when(mass <= 0, is_target.cast("double")).otherwise(result)
        return result

    return F.when(F.size(scores) > 0, let(full, fuse)).otherwise(
        F.array(entry(target, F.lit(1.0)))
    )


def _minimum(hint: Column, minima: Mapping[str, float]) -> Column:
    return F.coalesce(*[F.when(hint == label, F.lit(value)) for label, value in minima.items()])


def _decision(label: Column, confidence: Column, scores: Column) -> Column:
    return F.struct(
        label.alias("label"), confidence.cast("double").alias("confidence"), scores.cast(SCORES).alias("scores")
    )


def _with_hint(
    scores: Column, label: Column, hint: Column, minimum: Column, zero_guard: bool, always: bool
) -> Column:
    """Decision from scores, their label, and a hint that may be NULL."""
    own = score_of(scores, hint)
    enforce = F.lit(True) if always else ((hint != label) | (own < minimum))
    return (
        F.when(hint.isNull(), _decision(label, F.array_max(F.transform(scores, lambda x: x["score"])), scores))
        .when(
            enforce,
            let(
                fuse_hint(scores, hint, minimum, zero_guard),
                lambda s: _decision(hint, score_of(s, hint), s),
            ),
        )
        .otherwise(_decision(hint, own, scores))
    )


def severity_decision(
    scores: Column, hint: Column, profile: str = "live", label: Column | None = None
) -> Column:
    """Label, confidence and scores of the severity head after the keyword hint.

    ``label`` is the label of the head where it is not the one of highest score. Without scores
    the hint decides, and without both the answer is Medium.
    """
    head = label if label is not None else top(scores)["label"]
    minimum = _minimum(hint, vocab.SEVERITY_HINT_MINIMUM[profile])
    hinted = F.array(entry(hint, F.lit(vocab.FALLBACK_HINT_CONFIDENCE)))
    return (
        F.when(
            scores.isNull() & hint.isNotNull(),
            _decision(hint, F.lit(vocab.FALLBACK_HINT_CONFIDENCE), hinted),
        )
        .when(
            scores.isNull(),
            _decision(
                F.lit("Medium"), F.lit(vocab.FALLBACK_CONFIDENCE), score_list(vocab.SEVERITY_FALLBACK)
            ),
        )
        .otherwise(_with_hint(scores, head, hint, minimum, True, always=profile == "stub"))
    )


def urgency_decision(
    scores: Column, hint: Column, profile: str = "live", label: Column | None = None
) -> Column:
    """Like ``severity_decision`` for the urgency head; the stub profile ignores hints."""
    if profile == "stub":
        mapped = scores
        hint = F.lit(None).cast("string")
    else:
        mapped = urgency_scores(scores)
    head = urgency_label(label if label is not None else top(scores)["label"])
    minimum = _minimum(hint, vocab.URGENCY_HINT_MINIMUM)
    missing = _decision(
        F.lit("Neutral"), F.lit(vocab.FALLBACK_CONFIDENCE), score_list(vocab.URGENCY_FALLBACK)
    )
    return F.when(scores.isNull(), missing).otherwise(
        let(mapped, lambda s: _with_hint(s, head, hint, minimum, False, always=False))
    )


def hash_pick(text: Column, labels: Sequence[str], salt: str = "") -> Column:
    """A label picked by the text alone, the same in every process."""
    digest = F.conv(F.left(F.md5(F.concat(text, F.lit(salt))), F.lit(8)), 16, 10).cast("bigint")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (digest % len(labels) + 1).cast("int"))


def uniform_scores(labels: Sequence[str]) -> Column:
    return score_list([(name, 1.0 / len(labels)) for name in labels])
