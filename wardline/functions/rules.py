"""Keyword rules as CASE expressions over literals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import WORD, alternatives, let, rule_text, weak_rule_text


def any_word(text: Column, keywords: Iterable[str]) -> Column:
    """One of the keywords occurs as whole words: a single pass over the text."""
    return text.rlike(f"{alternatives(keywords, f'(?<!{WORD})')}(?!{WORD})")


# Long lists are constant arrays: one comparison per keyword written out would make generated
# methods too large for the JIT compiler.


def any_substring(text: Column, keywords: Iterable[str]) -> Column:
    return F.exists(_constants(keywords), lambda kw: F.contains(text, kw))


def hits(text: Column, keywords: Iterable[str]) -> Column:
    """How many different keywords occur in the text as substrings."""
    return F.size(F.filter(_constants(keywords), lambda kw: F.contains(text, kw)))


def _constants(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _power_fault(text: Column, faults: Sequence[str]) -> Column:
    power = reduce(or_, (text.contains(t) for t in vocab.POWER_TERMS))
    return power & reduce(or_, (text.contains(f) for f in faults))


def severity_hint(text: Column) -> Column:
    """High, Medium, Low or NULL from the raw text."""
    return let(
        rule_text(text),
        lambda low: F.when(
            _power_fault(low, vocab.POWER_FAULTS) | any_word(low, vocab.SEVERITY_HIGH), "High"
        )
        .when(any_word(low, vocab.SEVERITY_MEDIUM), "Medium")
        .when(any_word(low, vocab.SEVERITY_LOW), "Low"),
    )


def urgency_hint(text: Column) -> Column:
    """Angry/Urgent, Concerned or NULL."""
    return let(
        F.lower(text),
        lambda low: F.when(any_substring(low, vocab.URGENCY_URGENT), "Angry/Urgent").when(
            any_substring(low, vocab.URGENCY_CONCERNED), "Concerned"
        ),
    )


def urgency_hits(text: Column) -> tuple[Column, Column]:
    return (
        let(F.lower(text), lambda low: hits(low, vocab.URGENCY_URGENT)),
        let(F.lower(text), lambda low: hits(low, vocab.URGENCY_CONCERNED)),
    )


def keyword_category(
    text: Column, categories: Mapping[str, Sequence[str]] = vocab.CATEGORY_KEYWORDS
) -> Column:
    """Category with most distinct keywords, the earlier one on a tie."""
    names = _constants(categories)

    def winner(counts: Column) -> Column:
        best = F.array_max(counts)
        return F.when(best > 0, F.element_at(names, F.array_position(counts, best).cast("int"))).otherwise(
            vocab.GENERAL
        )

    return let(
        F.lower(text),
        lambda low: let(F.array(*[hits(low, kws) for kws in categories.values()]), winner),
    )


def category_rationale(
    text: Column, category: Column, categories: Mapping[str, Sequence[str]] = vocab.CATEGORY_KEYWORDS
) -> Column:
    """The keywords that led to ``category``, in alphabetical order."""
    def evidence(low: Column) -> Column:
        keywords = F.coalesce(
            *[F.when(category == name, _constants(sorted(set(kws)))) for name, kws in categories.items()]
        )
        found = F.filter(keywords, lambda kw: F.contains(low, kw))
        return F.concat(F.lit(vocab.KEYWORD_RATIONALE), F.array_join(found, ", "))

    return F.when(category == vocab.GENERAL, F.lit(vocab.NO_KEYWORD_RATIONALE)).otherwise(
        let(F.lower(text), evidence)
    )


def keyword_overrides(model_category: Column, keyword: Column, confidence: Column) -> Column:
    """The keyword category replaces a model category of low confidence."""
    return (
        (keyword != vocab.GENERAL)
        & (keyword != model_category)
        & (confidence < vocab.KEYWORD_OVERRIDE_BELOW)
    )


def fused_category(model_category: Column, keyword: Column, confidence: Column) -> Column:
    return F.when(keyword_overrides(model_category, keyword, confidence), keyword).otherwise(
        model_category
    )


def fused_rationale(
    model_category: Column, keyword: Column, confidence: Column, rationale: Column
) -> Column:
    before, after = vocab.MODEL_RATIONALE.split("{}")
    agrees = (keyword != vocab.GENERAL) & (keyword == model_category)
    return F.when(
        agrees | keyword_overrides(model_category, keyword, confidence), rationale
    ).otherwise(F.concat(F.lit(before), model_category, F.lit(after)))


def weak_severity(sub_category: Column, remarks: Column) -> Column:
    return let(
        weak_rule_text(sub_category, remarks),
        lambda text: F.when(
            _power_fault(text, vocab.POWER_FAULTS) | any_word(text, vocab.WEAK_HIGH), "HIGH"
        )
        .when(any_word(text, vocab.WEAK_MEDIUM), "MEDIUM")
        .when(any_word(text, vocab.WEAK_LOW), "LOW")
        .otherwise("MEDIUM"),
    )


def weak_urgency(sub_category: Column, remarks: Column) -> Column:
    return let(
        weak_rule_text(sub_category, remarks),
        lambda text: F.when(
            _power_fault(text, vocab.POWER_FAULTS[:1]) | any_word(text, vocab.WEAK_URGENT), "URGENT"
        )
        .when(any_word(text, vocab.WEAK_CONCERNED), "CONCERNED")
        .when(any_word(text, vocab.WEAK_NEUTRAL), "NEUTRAL")
        .otherwise("CONCERNED"),
    )


def recommendations(severity: Column, urgency: Column, issue: Column) -> Column:
    """Ordered list of actions for one complaint."""
    chosen = F.array_compact(
        F.array(
            F.when(F.lower(severity) == "high", F.lit(vocab.REC_ESCALATE)),
            F.when(F.lower(urgency).isin("angry/urgent", "urgent"), F.lit(vocab.REC_DISPATCH)),
            F.when(F.lower(issue).contains("road"), F.lit(vocab.REC_ROAD)),
        )
    )
    return let(
        chosen, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(vocab.REC_QUEUE)))
    )
