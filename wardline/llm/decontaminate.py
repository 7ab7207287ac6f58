"""Benchmark decontamination by templates.

Built-in functions only. A text becomes a row of tokens in which numbers, names and units are typed
placeholders. Windows of ``window`` tokens of all documents are hash-joined with those of the
benchmark, as templates and as they are. Matches of one document and item on one diagonal (document
position minus item position) line up; there each placeholder pairs a value of the item with a value of
the document. Unchanged windows always count. In a changed window one value of the item stands for one
value of the document; slots that say otherwise than most do not count, the rest of the window does.
Different values of the item may become one. Only if one of them stays and takes the place of another
as well, the line is another text on the same template, unless ``min_run`` tokens in a row are unchanged.

A name is a capitalised word behind a lower-case letter, figure or comma, a unit is a unit word behind
a number. The first token of a window is tried as a plain word too, whatever stands before it. Raw
windows are case-folded, so that copies in upper or lower case are copies.

Defined cases: null or empty texts have no tokens and match nothing. Items of fewer than ``window``
tokens are one window. Verbatim copies are found whatever the item holds and however short it is, so an
item of one word matches every document with that word. For other parameters an item needs 5 tokens and
a window at least half its tokens plain, so that rows of other figures match nothing. Rows with equal
or null ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import let
from wardline.llm.common import Scratch, numbered, small, unpacked

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yards l ml litres liters gallons"
    " s sec seconds min minutes h hr hours days weeks months years percent degrees dollars cents euros"
    " pounds mph kmh km/h watts volts"
)
SHORTEST = 5


def _plain(text: Column) -> Column:
    """``text`` without words that have neither letter nor digit; they are no tokens."""
    return F.btrim(F.regexp_replace(text, r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)", ""), F.lit(" \t\n\x0b\f\r"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def raw_tokens(text: Column) -> Column:
    """Case-folded words without punctuation, place by place with ``template_tokens``."""
    return _tokens(F.regexp_replace(_folded(text), r"[^\p{L}\p{N}\s]+", ""))


def template_tokens(text: Column) -> Column:
    t = F.regexp_replace(_plain(text), r"\p{N}+(?:[.,:/-]\p{N}+)*", NUMBER)
    t = F.when(t.contains(NUMBER), F.regexp_replace(t, rf"(?i)(?<={NUMBER}\s?)(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])", UNIT)).otherwise(t)
    t = F.regexp_replace(t, rf"(?<=[\p{{Ll}}\p{{N}},{NUMBER}]\s)\p{{Lu}}[\p{{L}}'’-]*", NAME)
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}\s{NUMBER}-{UNIT}]+", "")
    return _tokens(_folded(t))


def _is_slot(token: Column) -> Column:
    return F.rlike(token, F.lit(f"[{NUMBER}-{UNIT}]"))


def _by_context(token: Column) -> Column:
    """Whether the text before a token made it a placeholder."""
    return F.rlike(token, F.lit(f"[{NAME}{UNIT}]")) & ~token.contains(NUMBER)


def _codes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _half(size: int) -> int:
    """The largest power of two below ``size``: two blocks of it, which may overlap, make a window."""
    return 1 << (size - 1).bit_length() - 1


def _blocks(codes: Column, most: int, body: Callable[[dict[int, Column]], Column]) -> Column:
    """``body`` of the hashes of blocks of 1, 2, 4 ... codes from every place on, below ``most``.

    Each doubling looks at two hashes, so that a window costs the logarithm of its size and no copy of it.
    Blocks cut off by the end hold anything.
    """

    def doubled(known: dict[int, Column]) -> Column:
        p = max(known)
        if 2 * p >= most:
            return body(known)
        wide = F.transform(known[p], lambda h, i: F.xxhash64(h, F.get(known[p], i + p)))
        return let(wide, lambda more: doubled({**known, 2 * p: more}))

    return doubled({1: codes})


def _windows(blocks: dict[int, Column], size: int) -> Column:
    """Hashes of the windows from every place on; null where one is cut off."""
    if size == 1:
        return blocks[1]
    half = blocks[_half(size)]
    return F.transform(half, lambda h, i: F.when(i + size <= F.size(half), F.xxhash64(h, F.get(half, i + size - _half(size)))))


def _bare_windows(blocks: dict[int, Column], raw: Column, told: Column, size: int) -> Column:
    """The same with the first token as the plain word that it is, where ``told`` says so."""

    def window(c: Column, i: Column) -> Column:
        h, p = c, 1
        while 2 * p < size:
            h, p = F.xxhash64(h, F.get(blocks[p], i + p)), 2 * p
        return F.xxhash64(h, F.get(blocks[p], i + size - p)) if size > 1 else h

    return F.transform(raw, lambda c, i: F.when(F.get(told, i) & (i + size <= F.size(raw)), window(c, i)))


def _hashes(template: Column, raw: Column, wanted: list[tuple[int, bool]]) -> Column:
    """Window hashes of a text in arrays as long as the text, end to end; null where a window is cut off.

    Raw windows hold no placeholder, so that a hash never mixes the two kinds. A template window that
    starts with a name or unit comes a second time with its first token as a plain word, as the text
    before a passage is not part of it. Where the benchmark has no window with a placeholder, ``template``
    is not looked at.
    """
    plain, typed = [n for n, same in wanted if same], [n for n, same in wanted if not same]

    def of_raw(codes: Column) -> Column:
        return _blocks(codes, max(plain), lambda blocks: F.concat(*[_windows(blocks, n) for n in plain]))

    def of_template(codes: Column, own: Column) -> Column:
        def both(blocks: dict[int, Column]) -> Column:
            arrays = [[_windows(blocks, n), _bare_windows(blocks, own, codes["told"], n)] for n in typed]
            return F.concat(*sum(arrays, []))

        return let(codes["codes"], lambda c: _blocks(c, max(typed), both))

    def all_of(own: Column) -> Column:
        parts = [of_raw(own)] if plain else []
        if typed:
            codes = F.struct(_codes(template).alias("codes"), F.transform(template, _by_context).alias("told"))
            parts.append(let(codes, lambda c: of_template(c, own)))
        return F.concat(*parts)

    return let(_codes(raw), all_of)


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """``item, n, size, ipos, h, same`` from ``item, template, raw``; ``same`` tells raw windows."""
    n = F.size("template")
    sized = items.withColumn("n", n).withColumn("size", F.least(n, F.lit(window))).where(n > 0)
    sized = sized.withColumns({"told": F.transform("template", _by_context), "_raw": _codes(F.col("raw")), "_template": _codes(F.col("template"))})

    def by_size(hashes: Callable[[int], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("size") == k, hashes(k)) for k in range(1, window + 1)])

    def plain(name: str) -> Column:
        return by_size(lambda k: _blocks(F.col(name), k, lambda blocks: _windows(blocks, k)))

    bare = by_size(lambda k: _blocks(F.col("_template"), k, lambda blocks: _bare_windows(blocks, F.col("_raw"), F.col("told"), k)))
    hashed = sized.withColumns({"_h_raw": plain("_raw"), "_h_template": plain("_template"), "_h_bare": bare})

    def one(i: Column) -> Column:
        marks = F.size(F.filter(F.slice("template", i, F.col("size")), _is_slot))
        hashes = [F.get(f"_h_{c}", i - 1).alias(c) for c in ("raw", "template", "bare")]
        return F.struct((i - 1).alias("ipos"), *hashes, marks.alias("marks"))

    rows = hashed.select("item", "n", "size", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("size") + 1), one)).alias("w"))
    judged = (F.col("w.marks") > 0) & (2 * F.col("w.marks") <= F.col("size")) & (F.col("n") >= SHORTEST)
    kinds = F.when(judged, F.array("w.raw", "w.template", "w.bare")).otherwise(F.array("w.raw"))
    rows = rows.select("item", "n", "size", "w.ipos", F.posexplode(kinds).alias("kind", "h"))
    return rows.where("h is not null").withColumn("same", F.col("kind") == 0).drop("kind")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = 8, min_cover: float = 0.6, min_run: int = 16, scratch: Scratch | None = None,
) -> DataFrame:
    """``_rid, _key, item, item_tokens, covered, slots, renamed, kind``, one row per document and item.

    ``covered`` counts the item's tokens inside matching windows, without slots that contradict their
    window. At least ``min_cover`` of them make a leak, and so do ``min_run`` unchanged tokens in a
    row. ``kind`` is ``exact`` or ``reparameterised``, ``renamed`` is of the line that covers most.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    rows = numbered(docs, key, scratch, text)
    return _leaks(rows, benchmark, key, text, item_key, item_text, window, min_cover, min_run, scratch)


def _leaks(rows, benchmark, key, text, item_key, item_text, window, min_cover, min_run, scratch) -> DataFrame:
    body = F.col("_row").getField(text)
    slim = rows.select("_rid", F.col("_row").getField(key).alias("_key"), body.alias("_text"))
    question = F.col(f"`{item_text}`")
    items = benchmark.select(
        F.col(f"`{item_key}`").alias("item"), template_tokens(question).alias("template"), raw_tokens(question).alias("raw")
    )
    items = scratch.save(items, "items")
    grams = scratch.save(benchmark_windows(items, window), "grams")
    wanted = sorted((r["size"], r["same"]) for r in grams.select("size", "same").distinct().collect())  # two a size
    if wanted:
        own = small(grams.select("h", "item", "n", "size", "ipos", "same"), 64)
        # Without a window that holds a placeholder the words as they are say all.
        typed = any(not same for _, same in wanted)
        kinds = (template_tokens if typed else raw_tokens)(F.col("_text")).alias("t"), raw_tokens(F.col("_text")).alias("r")
        told = slim.select("_rid", *kinds)
        flat = told.select("_rid", F.size("r").alias("length"), F.posexplode(_hashes(F.col("t"), F.col("r"), wanted)).alias("at", "h"))
        found = flat.join(own, "h").withColumn("diagonal", (F.col("at") % F.col("length")).cast("int") - F.col("ipos"))
    else:
        found = slim.join(grams, F.lit(False)).withColumn("diagonal", F.lit(0))
    ends = lambda same: F.collect_set(F.when(F.col("same") == same, F.col("ipos")))
    # A whole item in one raw window is a copy; the first one of a document is enough.
    whole = F.col("same") & (F.col("n") == F.col("size"))
    found = found.withColumn("on", F.when(~whole, F.col("diagonal")))
    lines = found.groupBy("_rid", "item", "n", "size", "on").agg(
        F.min("diagonal").alias("diagonal"), ends(True).alias("same"), ends(False).alias("alike")
    )
    lines = scratch.save(lines, "lines")
    marked = small(lines.select("_rid").distinct(), 16)
    told = slim.join(marked, "_rid", "left_semi").select("_rid", "_key", raw_tokens(F.col("_text")).alias("said"))
    both = lines.join(told, "_rid").join(small(items.select("item", "template", "raw"), 2000), "item")
    span = lambda p: F.sequence(p, p + F.col("size") - 1)
    slot = lambda p: _is_slot(F.get("template", p))
    mine, yours = lambda p: F.get("raw", p), lambda p: F.get("said", p + F.col("diagonal"))

    def consistent(p: Column) -> Column:
        """The places of a window without slots whose value is not the most frequent one for theirs in the item."""

        def chosen(slots: Column) -> Column:
            def votes(r: Column) -> Column:
                times = F.size(F.filter(slots, lambda s: (mine(s) == mine(r)) & (yours(s) == yours(r))))
                return F.struct(times.alias("n"), (mine(r) == yours(r)).alias("same"), yours(r).alias("b"))

            def fits(q: Column) -> Column:
                return F.array_max(F.transform(F.filter(slots, lambda r: mine(r) == mine(q)), votes))["b"] == yours(q)

            return F.filter(span(p), lambda q: ~slot(q) | fits(q))

        return let(F.filter(span(p), slot), chosen)

    both = both.withColumn("changed", F.array_except("alike", "same"))
    kept = F.flatten(F.transform("same", span))
    both = both.withColumn("places", F.array_distinct(F.concat(kept, F.flatten(F.transform("changed", consistent)))))
    pairs = lambda places: F.transform(F.filter(places, slot), lambda p: F.struct(mine(p).alias("a"), yours(p).alias("b")))
    every = F.array_distinct(pairs(F.concat(kept, F.flatten(F.transform("changed", span)))))
    both = both.withColumn("kinds", every)
    # A value put in place of another one while it also stays where it was.
    taken = let(F.col("kinds"), lambda e: F.arrays_overlap(
        F.transform(F.filter(e, lambda s: s["a"] != s["b"]), lambda s: s["b"]),
        F.transform(F.filter(e, lambda s: s["a"] == s["b"]), lambda s: s["b"]),
    ))
    # So many unchanged windows one behind the other hold a run.
    many = F.greatest(F.lit(min_run) - F.col("size") + 1, F.lit(1))
    run = (F.lit(min_run) >= F.col("size")) & let(F.array_sort("same"), lambda s: F.exists(
        F.transform(s, lambda p, i: F.get(s, i + many - 1) - p), lambda gap: gap == many - 1
    )) & (F.col("n") >= min_run)
    both = both.withColumn("taken", taken).withColumn("run", run).where("run or not taken")
    both = both.withColumn("places", F.when(F.col("taken"), F.array_distinct(kept)).otherwise(F.col("places")))
    good = both.select(
        "_rid", "_key", "item", "n", "places", "run", F.size("places").alias("held"), F.size("kinds").alias("slots"),
        F.size(F.filter("kinds", lambda s: s["a"] != s["b"])).alias("renamed"),
    )
    merged = good.groupBy("_rid", "_key", "item", "n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.max("slots").alias("slots"),
        F.min_by("renamed", F.struct(-F.col("held"), F.col("renamed"))).alias("renamed"),
        F.max("run").alias("run"),
    )
    return merged.where((F.col("covered") >= min_cover * F.col("n")) | F.col("run")).select(
        "_rid", "_key", "item", F.col("n").alias("item_tokens"), "covered", "slots", "renamed",
        F.when(F.col("renamed") == 0, "exact").otherwise("reparameterised").alias("kind"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    scratch = Scratch(docs.sparkSession, "leaks")
    rows = numbered(docs, key, scratch, text)
    settings = {"item_key": "item_id", "item_text": "text", "window": 8, "min_cover": 0.6, "min_run": 16} | options
    leaks = _leaks(rows, benchmark, key, text, scratch=scratch, **settings)
    leaked = scratch.save(leaks.select("_rid").distinct(), "leaked")
    return unpacked(rows.join(small(leaked, 16), "_rid", "left_anti"), docs.columns)
