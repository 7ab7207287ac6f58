"""Secret scans with multipart linking.

Built-in functions only. Sure findings (``BASE``) always stand. Weak parts (``WEAK``: key-shaped
strings, user names, short passwords, endpoints) mean little alone; they are reported only when a
complementary part lies within ``reach`` code points in the same scope, a scope being a stretch of
text without an empty line:

* an identifier (access key id, user) needs a secret,
* a secret (assignment, hex run, key-shaped string, short password) needs an identifier or endpoint,
* an endpoint needs an identifier and a secret.

Matches are leftmost and do not overlap within a kind. The interval join looks, for each part, at the
nearest part of each class before and after it in its scope: if any is in reach, the nearest is. So
no pairs arise, however many parts a text has.

Defined cases: a null text is empty; every row gives a row, repeated ids included; a weak part that
lies inside a sure finding is no part of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


class Kind(NamedTuple):
    name: str
    pattern: str
    role: str
    least: int  # code points of the match, or of group 2 where there is one
    group: int = 0


BASE = [
    Kind("assign", ASSIGN, "secret", 8, 2),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", 16),
    Kind("hex", r"[0-9a-f]{32,}", "secret", 32),
]
WEAK = [
    Kind("user", r"""(?i)\b(user|username|login|client_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", "identifier", 3, 2),
    Kind("pass", r"""(?i)\b(pwd|pass|auth|private_key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", 4, 2),
    Kind("key40", r"(?<![A-Za-z0-9+/=])(?=[a-z0-9+/]*[A-Z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", "secret", 40),
    Kind("endpoint", r"https?://[A-Za-z0-9.:/_-]+", "endpoint", 10),
]
BREAK = Kind("break", r"\n[\x20\t\r]*\n", "break", 1)
KINDS = [*BASE, *WEAK, BREAK]
SCHEMA = "array<struct<kind:int,i:int,skip:int,chars:int,fits:boolean,value:string>>"


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """One entry per match: the code points between it and the match before, and its own."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def entry(value: Column, i: Column) -> Column:
        judged = F.regexp_extract(value, kind.pattern, kind.group) if kind.group else value
        return F.struct(
            F.lit(number).alias("kind"),
            i.alias("i"),
            F.char_length(F.get(gaps, i)).alias("skip"),
            F.char_length(value).alias("chars"),
            (F.char_length(judged) >= kind.least).alias("fits"),
            value.alias("value"),
        )

    return F.when(text.rlike(kind.pattern), F.transform(found, entry)).otherwise(F.array().cast(SCHEMA))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """``_key`` and ``_spans``, an array of ``(start, rank, end, kind, value, sure)`` in that order.

    Positions are code points, ends exclusive; rank is the place of the kind in ``BASE + WEAK``.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.monotonically_increasing_id()
    slim = docs.select(F.col(f"`{key}`").alias("_key"), body.alias("_text"), number.alias("_rid"))
    parts = slim.select("_rid", "_key", "_text", F.concat(*[_matches(F.col("_text"), n, k) for n, k in enumerate(KINDS[:-1])]).alias("p"))
    breaks = F.when(F.size("p") > 0, _matches(F.col("_text"), len(KINDS) - 1, BREAK))
    rows = parts.select(
        "_rid",
        "_key",
        F.explode_outer(F.concat("p", F.coalesce(breaks, F.array().cast(SCHEMA)))).alias("m"),
    ).select("_rid", "_key", "m.*")
    dealt = rows.repartition("_rid")
    run = W.partitionBy("_rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("skip") + F.col("chars")).over(run)
    placed = dealt.withColumn("end", end).withColumn("start", F.col("end") - F.col("chars"))
    # What is too short is no part; its row stays, so that no text is lost.
    placed = placed.withColumn("kind", F.when(F.col("fits"), F.col("kind")))
    return _linked(placed, reach).groupBy("_rid", "_key").agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("kept"),
                    F.struct("start", F.col("kind").alias("rank"), "end", F.col("name").alias("kind"), "value", "sure"),
                )
            )
        ).alias("_spans")
    ).drop("_rid")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """``parts`` with ``name``, ``sure`` and ``kept``."""
    kind = F.col("kind")
    names = F.array(*[F.lit(k.name) for k in KINDS])
    roles = F.array(*[F.lit(k.role) for k in KINDS])
    sure = kind < len(BASE)
    known = parts.withColumns({"name": F.get(names, kind), "role": F.get(roles, kind), "sure": sure})
    order = W.partitionBy("_rid").orderBy("start", "kind")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    covered = F.max(F.when(F.col("sure"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    known = known.withColumns(
        {"scope": F.count(F.when(F.col("role") == "break", 1)).over(before), "covered": covered}
    )
    free = (F.col("sure") | F.col("kind").isNull() | F.col("covered").isNull() | (F.col("covered") < F.col("end")))
    known = known.where(free)
    inside = W.partitionBy("_rid", "scope").orderBy("start", "kind")
    past, next_ = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(1, W.unboundedFollowing)

    def near(role: str) -> Column:
        mine = F.col("role") == role
        left = F.col("start") - F.max(F.when(mine, F.col("end"))).over(past)
        right = F.min(F.when(mine, F.col("start"))).over(next_) - F.col("end")
        return F.coalesce(left <= reach, F.lit(False)) | F.coalesce(right <= reach, F.lit(False))

    seen = known.withColumns({f"near_{r}": near(r) for r in ("identifier", "secret", "endpoint")})
    linked = (
        F.when(F.col("role") == "identifier", F.col("near_secret"))
        .when(F.col("role") == "secret", F.col("near_identifier") | F.col("near_endpoint"))
        .when(F.col("role") == "endpoint", F.col("near_identifier") & F.col("near_secret"))
        .otherwise(F.lit(False))
    )
    return seen.withColumn("kept", F.col("kind").isNotNull() & (F.col("sure") | linked))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of sure findings and the two joined lists of ``find_spans``, a row per text."""
    every = F.col("_spans")
    base = F.filter(every, lambda s: s["sure"])
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda name: F.size(F.filter(every, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return spans.select(
        F.col("_key").alias("doc_id"),
        *[count(k.name) for k in BASE],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, shown), ",").alias("spans"),
    )
