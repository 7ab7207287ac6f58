"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Built-in functions only. Three steps:

* a pattern per kind proposes leftmost spans that do not overlap within the kind;
* a validator confirms or refuses each: octets of addresses, number of digits, Luhn for cards, mod-97
  for account numbers (IBAN), the weighted sum of bank routing numbers, areas that social security
  numbers cannot have;
* a proposal starts with the points of its kind, wins ``BONUS`` if a word of its kind ("phone", "born")
  stands outside it within ``reach`` code points, and loses ``MALUS`` if a word does that points elsewhere
  ("version", "invoice").

Kinds in ``BASE`` stay whatever their points; kinds in ``ADDED`` need ``least`` points and no overlap with
a span of ``BASE``. So a date or a bare local number counts only next to a word that says what it is.

Words are looked up only in texts that hold a proposal. Proposals and words of a text become rows, and
the nearest word of a kind before and after a proposal comes from running maxima and minima: no pairs
arise, however many of either a text has. Patterns neither recurse nor start anew inside a run that has
failed, so a text that is one long run of digits costs as much as any other.

Defined cases: a null text is empty; every row gives a row, repeated ids and null ids included; columns of
``docs`` beside key and text are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions.text import let

LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BONUS, MALUS = 35, 30


def _is_address(value: Column) -> Column:
    """Every part between the points is 255 at most, however many zeros lead."""

    def octet(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), octet)


def _is_card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def _is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def _is_iban(value: Column) -> Column:
    """The first four characters behind the rest, letters as 10 to 35, leave 1 modulo 97."""
    bare = F.translate(value, " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.left(bare, F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        number = F.instr(F.lit(LETTERS), char) - 1
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def _is_security_number(value: Column) -> Column:
    return ~(value.rlike("^(000|666|9)") | value.rlike("-00-") | value.rlike("0000$"))


def _is_routing(value: Column) -> Column:
    total = sum([F.substring(value, i + 1, 1).cast("int") * (3, 7, 1)[i % 3] for i in range(9)], F.lit(0))
    return (total % 10 == 0) & (value != "000000000")


def _always(value: Column) -> Column:
    return F.lit(True)


class Kind(NamedTuple):
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    points: int
    words: str  # the words that speak for it
    whole: bool = False  # no letter or digit may touch it


# Possessive loops do not recurse. A start inside a run is tried only where the match before it ended.
BASE = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _always,
        70,
        "mail|email|contact",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_address, 60, "ip|host|address|server|client"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", _is_card, 90, "card|credit|debit|visa|mastercard|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _is_phone, 60, "phone|tel|telephone|mobile|cell|fax|call"),
]
ADDED = [
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
        _is_iban,
        90,
        "iban|account|bank|transfer",
        True,
    ),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _is_security_number, 40, "ssn|social|security|taxpayer", True),
    Kind("routing", r"[0-9]{9}", _is_routing, 40, "routing|aba|bank|transfer", True),
    Kind("birth", r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", _always, 25, "born|birth|birthday|dob", True),
    Kind(
        "local",
        r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
        _always,
        30,
        "phone|tel|telephone|mobile|cell|fax|call",
        True,
    ),
    Kind("ipv6", r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}", _always, 60, "ip|host|address|server|client", True),
]
KINDS = [*BASE, *ADDED]
COUNTER = "version|release|build|isbn|invoice|order|ticket|example|sample|figure|table"
# Lists of words, each once; the last one speaks against.
LISTS = [*dict.fromkeys(k.words for k in KINDS), COUNTER]
WORDS = sorted({w for words in LISTS for w in words.split("|")}, key=lambda w: (-len(w), w))
SCHEMA = "array<struct<kind:int,i:int,skip:int,chars:int,valid:boolean,value:string>>"
TOUCH = "[A-Za-z0-9]"


def _found(text: Column, pattern: str, entry: Callable[[Column, Column, Column], Column]) -> Column:
    """One ``entry(value, number, gaps)`` per match; ``gaps`` are the stretches between, cut once a text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = let(F.split(text, pattern, -1), lambda gaps: F.transform(found, lambda v, i: entry(v, i, gaps)))
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(SCHEMA))


def _entry(kind: Column, value: Column, i: Column, gaps: Column, valid: Column) -> Column:
    skip = F.char_length(F.get(gaps, i))
    return F.struct(
        kind.cast("int").alias("kind"),
        i.alias("i"),
        skip.alias("skip"),
        F.char_length(value).alias("chars"),
        valid.alias("valid"),
        F.when(valid, value).alias("value"),
    )


def _alone(i: Column, gaps: Column) -> Column:
    before, after = F.right(F.get(gaps, i), F.lit(1)), F.left(F.get(gaps, i + 1), F.lit(1))
    return ~(before.rlike(TOUCH) | after.rlike(TOUCH))


def _proposals(text: Column, number: int, kind: Kind) -> Column:
    def entry(value: Column, i: Column, gaps: Column) -> Column:
        valid = kind.valid(value)
        return _entry(F.lit(number), value, i, gaps, _alone(i, gaps) & valid if kind.whole else valid)

    return _found(text, kind.pattern, entry)


def _words(text: Column) -> Column:
    """Entries of context words; their kind is -1."""
    pattern = f"(?i)(?:{'|'.join(WORDS)})"
    return _found(text, pattern, lambda v, i, gaps: _entry(F.lit(-1), F.lower(v), i, gaps, _alone(i, gaps)))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 60, least: int = 50) -> DataFrame:
    """``_key`` and ``_spans``: an array of ``(rank, start, end, kind, value, points, base)`` in that order.

    Positions are code points, ends exclusive; rank is the place of the kind in ``KINDS``.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.monotonically_increasing_id()
    slim = docs.select(F.col(f"`{key}`").alias("_key"), body.alias("_text"), number.alias("_rid"))
    offered = F.concat(*[_proposals(F.col("_text"), n, k) for n, k in enumerate(KINDS)])
    told = F.when(F.exists("p", lambda x: x["valid"]), _words(F.col("_text"))).otherwise(F.array().cast(SCHEMA))
    rows = slim.select("_rid", "_key", "_text", offered.alias("p")).select(
        "_rid", "_key", F.explode_outer(F.concat("p", told)).alias("m")
    )
    rows = rows.select("_rid", "_key", "m.*").repartition("_rid")
    run = W.partitionBy("_rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("skip") + F.col("chars")).over(run)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("chars"))
    # What failed keeps its row, so that no text is lost, but counts as nothing.
    placed = placed.withColumn("kind", F.when(F.col("valid"), F.col("kind")))
    span = F.struct(F.col("kind").alias("rank"), "start", "end", F.col("name").alias("kind"), "value", "points", "base")
    spans = F.sort_array(F.collect_list(F.when(F.col("kept"), span))).alias("_spans")
    return _judged(placed, reach, least).groupBy("_rid", "_key").agg(spans).drop("_rid")


def _judged(parts: DataFrame, reach: int, least: int) -> DataFrame:
    """``parts`` with ``name``, ``points``, ``base`` and ``kept``."""
    kind, value = F.col("kind"), F.col("value")
    word = kind == -1
    text = W.partitionBy("_rid")
    # Words stand where they end, or start, so that only words outside a span are before, or behind, it.
    # The last two run backwards: Spark starts anew at every row of a frame that ends with the group.
    past = text.orderBy(F.when(word, F.col("end")).otherwise(F.col("start")), "kind").rowsBetween(W.unboundedPreceding, -1)
    behind = text.orderBy(F.when(word, F.col("start")).otherwise(F.col("end")).desc(), "kind").rowsBetween(W.unboundedPreceding, -1)
    later = text.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    base = kind.between(0, len(BASE) - 1)

    def near(words: str) -> Column:
        mine = word & value.isin(words.split("|"))
        left = F.col("start") - F.max(F.when(mine, F.col("end"))).over(past)
        right = F.min(F.when(mine, F.col("start"))).over(behind) - F.col("end")
        return F.coalesce(left <= reach, F.lit(False)) | F.coalesce(right <= reach, F.lit(False))

    seen = parts.withColumns({f"near_{n}": near(words) for n, words in enumerate(LISTS)} | {
        "base": F.coalesce(base, F.lit(False)),
        "reached": F.max(F.when(base, F.col("end"))).over(past),
        "coming": F.min(F.when(base, F.col("start"))).over(later),
    })
    mine = F.get(F.array(*[F.col(f"near_{LISTS.index(k.words)}") for k in KINDS]), kind)
    start = F.get(F.array(*[F.lit(k.points) for k in KINDS]), kind)
    against = F.col(f"near_{len(LISTS) - 1}")
    points = start + F.when(mine, BONUS).otherwise(0) - F.when(against, MALUS).otherwise(0)
    over = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("coming") < F.col("end"), F.lit(False))
    judged = seen.withColumns({
        "name": F.get(F.array(*[F.lit(k.name) for k in KINDS]), F.when(kind >= 0, kind)),
        "points": F.least(F.greatest(points, F.lit(0)), F.lit(100)),
    })
    kept = F.col("base") | ((kind >= 0) & (F.col("points") >= least) & ~over)
    return judged.withColumn("kept", F.coalesce(kept, F.lit(False)))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of ``BASE`` kinds and the joined lists of ``find_spans``, a row per text."""
    every = F.col("_spans")
    base = F.filter(every, lambda s: s["base"])
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda name: F.size(F.filter(every, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return spans.select(
        F.col("_key").alias("doc_id"),
        *[count(k.name) for k in BASE],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, shown), ",").alias("spans"),
        F.array_join(F.transform(every, lambda s: s["points"].cast("string")), ",").alias("points"),
    )
