"""Text and date functions: Column in, Column out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab

# Character classes are spelled out because ``\w``, ``\b`` and ``\s`` mean different things
# to different Java releases.
WORD = r"[\p{L}\p{N}_]"
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
_SPACE_CHARS = [
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alternatives(terms: Iterable[str], before: str = "") -> str:
    """A pattern for one of the terms, in their order of preference, where ``before`` holds.

    Terms that begin with other characters exclude each other, so most places are left after a look at one
    character.
    """
    terms = list(dict.fromkeys(terms))
    if not all(terms):
        return f"{before}(?:{'|'.join(re.escape(t) for t in terms)})"
    by_first: dict[str, list[str]] = {}
    for term in terms:
        by_first.setdefault(term[0], []).append(re.escape(term[1:]))
    heads = "".join(re.escape(c) for c in by_first)
    tails = [f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()]
    return f"(?=[{heads}]){before}(?:{'|'.join(tails)})" if terms else "(?!)"


# Told by their letters before the look at what precedes them.
_DROPPED_WORDS = f"(?:[rR](?<!{WORD}[rR])[tT]|[vV](?<!{WORD}[vV])[iIİı][aA])(?!{WORD})"


def _joined(text: Column, pattern: str) -> Column:
    """The matches, one blank between them: cheaper than replacing what lies in between."""
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(text, F.lit("".join(_SPACE_CHARS)))


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return _joined(text, f"{NON_SPACE}+")


def normalize_text(text: Column) -> Column:
    """Without links, the words rt and via, and anything but ASCII letters and digits; lower case."""
    text = F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, f"https?://{NON_SPACE}+", "")).otherwise(text)
    return F.lower(_joined(F.regexp_replace(text, _DROPPED_WORDS, ""), "[A-Za-z0-9]+"))


def rule_text(text: Column) -> Column:
    return collapse(F.lower(text))


def weak_rule_text(*fields: Column) -> Column:
    """Several fields as one lower-case text, hyphens as blanks."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return collapse(F.replace(F.lower(F.concat_ws(" ", *parts)), F.lit("-"), F.lit(" ")))


def compose_text(category: Column, sub_category: Column, ward: Column, remarks: Column) -> Column:
    category, sub_category, ward, remarks = (
        F.coalesce(c, F.lit("")) for c in (category, sub_category, ward, remarks)
    )
    return collapse(
        F.concat(category, F.lit(" - "), sub_category, F.lit(" in "), ward, F.lit(". "), remarks)
    )


def title_case(text: Column) -> Column:
    """Each run of letters starts in upper case: ``angry/urgent`` -> ``Angry/Urgent``.

    ``initcap`` only sees blanks, so every other non-letter gets one, marked for removal.
    """
    marked = F.regexp_replace(text, r"([^\p{Lu}\p{Ll}\p{Lt} ])", "$1\x01 ")
    return F.replace(F.initcap(marked), F.lit("\x01 "), F.lit(""))


def civic_category(label: Column) -> Column:
    """Readable category of a model label."""
    plain = strip(F.replace(label, F.lit("_"), F.lit(" ")))
    result = F.when(F.coalesce(plain, F.lit("")) == "", F.lit(vocab.GENERAL))
    for name, category in vocab.MODEL_LABEL_CATEGORY.items():
        result = result.when(label == name, F.lit(category))
    return result.otherwise(title_case(plain))


def urgency_label(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low.contains("urgent") | low.contains("angry"), "Angry/Urgent")
        .when(low.contains("concern") | low.contains("warn"), "Concerned")
        .otherwise("Neutral")
    )


def preview(text: Column, width: int = 160) -> Column:
    text = strip(text)
    cut = F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)


def display_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM yyyy • HH:mm"), F.lit("—"))


def parse_time(value: Column, strict: bool = False) -> Column:
    """ISO text to a timestamp; NULL for bad text, or an error when ``strict``."""
    return F.to_timestamp(value) if strict else F.try_to_timestamp(value)


def keyword_counts(text: Column, keywords: Sequence[str] = tuple(vocab.FEATURE_KEYWORDS)) -> list[Column]:
    """Non-overlapping occurrences of each keyword, one column per keyword."""
    low = F.lower(text)
    return [
        ((F.length(low) - F.length(F.replace(low, F.lit(kw), F.lit("")))) / len(kw))
        .cast("int")
        .alias(f"n_{kw}")
        for kw in keywords
    ]


def words(text: Column, pattern: str = f"{WORD}{{2,}}") -> Column:
    """Lower-case words of the whole text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` consecutive tokens, joined by blanks."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    runs = F.slice(tokens, F.lit(1), count)
    for shift in range(2, n + 1):
        following = F.slice(tokens, F.lit(shift), count)
        runs = F.zip_with(runs, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return runs


def term_counts(terms: Column) -> Column:
    """Distinct terms with their counts, by sorting inside the row instead of a shuffle.

    NULL stays NULL.
    """
    def runs(ordered: Column) -> Column:
        def is_first(i: Column) -> Column:
            return (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))

        heads = F.when(
            F.size(ordered) > 0, F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), is_first)
        ).when(F.size(ordered) == 0, F.array().cast("array<int>"))
        return let(
            heads,
            lambda hs: F.transform(
                hs,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(hs, k + 1), F.size(ordered)) - at).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(terms), runs)


def _offset_tokens(text: Column, pattern: str, outside: Callable[[Column], Column]) -> Column:
    """Matches of ``pattern`` with 0-based half-open offsets, counted in code points.

    Looks at every character once, so it stays linear in the length of the text.
    """
    def starts(chars: Column) -> Column:
        def is_start(i: Column) -> Column:
            return ~outside(F.get(chars, i)) & ((i == 0) | outside(F.get(chars, i - 1)))

        return F.when(
            F.size(chars) > 0, F.filter(F.sequence(F.lit(0), F.size(chars) - 1), is_start)
        ).otherwise(F.array().cast("array<int>"))

    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), starts)
    return F.zip_with(
        tokens,
        found,
        lambda t, s: F.struct(t.alias("token"), s.alias("start"), (s + F.length(t)).alias("end")),
    )


def token_spans(text: Column) -> Column:
    """Stretches between white space, with offsets."""
    return _offset_tokens(text, f"{NON_SPACE}+", lambda c: c.isin(_SPACE_CHARS))


def word_spans(text: Column) -> Column:
    """Words of letters, digits and underscores, with offsets."""
    return _offset_tokens(text, f"{WORD}+", lambda c: ~c.rlike(WORD))
