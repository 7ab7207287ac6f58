"""Entity spans, ``ARRAY<STRUCT<text STRING, label STRING, start INT, end INT>>``, inside the row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import WORD, alternatives, let, strip, token_spans

SPANS = "array<struct<text:string,label:string,start:int,end:int>>"


def span(text: Column, label: Column, start: Column, end: Column) -> Column:
    return F.struct(
        text.cast("string").alias("text"),
        label.cast("string").alias("label"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
    )


def clean_entities(entities: Column) -> Column:
    """Entries without text or label dropped, missing offsets 0, NULL as the empty list."""
    kept = F.filter(
        entities, lambda e: e.isNotNull() & e["text"].isNotNull() & e["label"].isNotNull()
    )
    zero = F.lit(0)
    filled = F.transform(
        kept,
        lambda e: span(e["text"], e["label"], F.coalesce(e["start"], zero), F.coalesce(e["end"], zero)),
    )
    return F.coalesce(filled, F.array().cast(SPANS))


def first_location(entities: Column) -> Column:
    places = F.filter(entities, lambda e: F.upper(e["label"]).isin(vocab.LOCATION_LABELS))
    return F.coalesce(F.get(places, F.lit(0))["text"], F.lit(""))


def entity_caption(entities: Column) -> Column:
    def caption(e: Column) -> Column:
        text, label = strip(e["text"]), strip(e["label"])
        return F.when(label == "", text).otherwise(F.concat(text, F.lit("("), label, F.lit(")")))

    shown = F.filter(entities, lambda e: strip(e["text"]) != "")
    return F.array_join(F.transform(shown, caption), ", ")


def token_tags(text: Column, entities: Column) -> Column:
    """Words with offsets and the label of the first entity that covers them whole, else ``O``."""
    def tag(t: Column) -> Column:
        cover = F.filter(
            entities,
            lambda e: (t["start"] >= F.coalesce(e["start"], F.lit(0)))
            & (t["end"] <= F.coalesce(e["end"], e["start"], F.lit(0))),
        )
        label = F.get(cover, F.lit(0))["label"]
        return F.struct(
            t["token"].alias("token"),
            t["start"].alias("start"),
            t["end"].alias("end"),
            F.coalesce(F.nullif(label, F.lit("")), F.lit("O")).alias("label"),
        )

    return F.transform(token_spans(text), tag)


def tagged_inline(tags: Column) -> Column:
    return F.array_join(
        F.transform(tags, lambda t: F.concat(t["token"], F.lit("("), t["label"], F.lit(")"))), " "
    )


def text_segments(text: Column, entities: Column) -> Column:
    """The text cut into plain and entity pieces in order of start.

    Entities are sorted by start and keep their order on ties. A plain piece covers the gap before
    an entity and the tail; plain pieces have a NULL label. Overlaps repeat text.
    """
    keyed = F.transform(
        entities,
        lambda e, i: F.struct(
            F.coalesce(e["start"], F.lit(0)).alias("start"),
            i.alias("i"),
            F.greatest(
                F.when(F.coalesce(e["end"], F.lit(0)) != 0, e["end"]).otherwise(F.coalesce(e["start"], F.lit(0))),
                F.coalesce(e["start"], F.lit(0)),
            ).alias("end"),
            e["label"].alias("label"),
        ),
    )

    def piece(body: Column, label: Column) -> Column:
        return F.struct(body.alias("piece"), label.cast("string").alias("label"))

    none = F.lit(None).cast("string")

    def build(ordered: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda chars: assemble(ordered, chars))

    def assemble(ordered: Column, chars: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            # A slice: a substring walks from the start of the text for every piece.
            return F.array_join(F.slice(chars, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0))), "")

        def pieces(e: Column, i: Column) -> Column:
            cursor = F.when(i > 0, F.get(ordered, i - 1)["end"]).otherwise(F.lit(0))
            own = F.array(piece(cut(e["start"], e["end"]), F.coalesce(e["label"], F.lit(""))))
            gap = F.array(piece(cut(cursor, e["start"]), none))
            return F.when(e["start"] > cursor, F.concat(gap, own)).otherwise(own)

        tail_from = F.coalesce(F.get(ordered, F.size(ordered) - 1)["end"], F.lit(0))
        tail = F.array(piece(cut(tail_from, F.size(chars)), none))
        cut_up = F.concat(F.flatten(F.transform(ordered, pieces)), tail)
        return F.filter(cut_up, lambda p: (p["piece"] != "") | p["label"].isNotNull())

    return let(F.array_sort(keyed), build)


def leftmost_longest(matches: Column) -> Column:
    """Of overlapping matches the one that starts first stays, the longest of one start.

    ``matches`` are spans of one text in any order.
    """
    ordered = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct(
                m["start"].alias("start"), (-m["end"]).alias("back"), m["label"].alias("label"), m["text"].alias("text")
            ),
        )
    )
    none = F.array().cast(SPANS)

    def take(acc: Column, m: Column) -> Column:
        kept = F.concat(acc["kept"], F.array(span(m["text"], m["label"], m["start"], -m["back"])))
        return F.when(m["start"] >= acc["free"], F.struct((-m["back"]).alias("free"), kept.alias("kept"))).otherwise(acc)

    def part(acc: Column, matches: Column) -> Column:
        begin = F.struct(acc["free"].alias("free"), none.alias("kept"))
        return let(
            F.aggregate(matches, begin, take),
            lambda done: F.struct(done["free"].alias("free"), F.concat(acc["lists"], F.array(done["kept"])).alias("lists")),
        )

    def folded(matches: Column) -> Column:
        # Lists are copied when they grow, so long ones are folded in parts of about their square root.
        size = F.ceil(F.sqrt(F.size(matches))).cast("int")
        parts = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.size(matches) - 1, n), lambda i: F.slice(matches, i + 1, n)))
        state = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{SPANS}>").alias("lists"))
        return F.when(F.size(matches) > 0, F.aggregate(parts, state, part, lambda acc: F.flatten(acc["lists"]))).when(
            F.size(matches) == 0, none
        )

    return let(ordered, folded)


_CUT = "\x01"
_FEW = 16  # names of a text whose places are added up anew for each


def gazetteer_spans(text: Column, gazetteer: Mapping[str, Sequence[str]]) -> Column:
    """Names from a short list found in the text, without a join or a shuffle.

    ``gazetteer`` maps a label to lower-case names; the case of ASCII letters in the text is ignored.
    The list is one pattern, longer names first, so matches are leftmost-longest. Marks are put around each
    match, which cut the text into pieces, every second one a name. A few names start where the pieces
    before them add up to; with more, the place of a mark less the marks before it is where a piece starts.
    ``operators.entities`` joins lists too long for a pattern.
    """
    label_of = {term: label for label, terms in gazetteer.items() for term in terms}
    names = alternatives(sorted(label_of, key=lambda t: (-len(t), t)), f"(?<!{WORD})")
    labels = F.create_map(*[F.lit(x) for pair in label_of.items() for x in pair])
    # Match and mark in one text, in which the mark itself cannot occur.
    marked = F.regexp_replace(F.translate(text, _CUT, " "), f"(?i)({names})(?!{WORD})", f"{_CUT}$1{_CUT}")

    def named(hit: Column, start: Column) -> Column:
        return span(hit, F.element_at(labels, F.lower(hit)), start, start + F.length(hit))

    def summed(pieces: Column) -> Column:
        def at(lengths: Column, k: Column) -> Column:
            before = F.aggregate(F.slice(lengths, F.lit(1), 2 * k + 1), F.lit(0), lambda s, n: s + n)
            return let(before, lambda start: named(F.get(pieces, 2 * k + 1), start))

        count = F.sequence(F.lit(0), ((F.size(pieces) - 3) / 2).cast("int"))
        return let(F.transform(pieces, lambda p: F.length(p)), lambda lengths: F.transform(count, lambda k: at(lengths, k)))

    def walked(pieces: Column, whole: Column) -> Column:
        def at_marks(chars: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.get(chars, i) == _CUT)

        places = let(F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0)), at_marks)
        hits = F.filter(pieces, lambda p, i: i % 2 == 1)
        starts = F.filter(F.transform(places, lambda p, k: p - k), lambda p, k: k % 2 == 0)
        return F.zip_with(hits, starts, named)

    def found(whole: Column) -> Column:
        return let(
            F.split(whole, _CUT),
            lambda pieces: F.when(F.size(pieces) > 2 * _FEW + 1, walked(pieces, whole))
            .when(F.size(pieces) > 1, summed(pieces))
            .otherwise(F.array().cast(SPANS)),
        )

    return let(marked, found)
