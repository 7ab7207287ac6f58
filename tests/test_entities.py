import pytest
from pyspark.sql import functions as F

from wardline.functions import spans
from wardline.operators import entities, enrich, joins
from wardline.sources import fixtures

from conftest import SF


def test_golden_annotations(annotations):
    rows = annotations.select(
        "entities",
        spans.first_location(F.col("entities")).alias("place"),
        spans.tagged_inline(spans.token_tags(F.col("text"), F.col("entities"))).alias("tags"),
    ).orderBy("text").collect()
    assert rows[0].place == " Kestrel Wharf Step"
    assert rows[0].tags == (
        "Broken(O) railing(PROBLEM) beside(O) Kestrel(LOCATION) Wharf(LOCATION) Steps(O) blocks(O) prams.(O)"
    )
    assert rows[1].place == "Heron Dyke Eas"
    assert rows[1].tags.startswith("Washing(PROBLEM) away(O) of(O) Heron(LOCATION) Dyke(LOCATION) East(O) flooded(O)")


def _listed(df):
    return df.select("id", F.posexplode("entities").alias("pos", "e")).select("id", "pos", "e.*")


LONG = " ".join(f"w{i}" for i in range(400))


def test_table_and_row_tagging_agree(spark):
    rows = [
        (1, "one two three four", [("x", "A", 0, 7), ("y", "B", 4, 13), ("z", "", 14, 18)]),
        (2, LONG, [("x", "A", 30, 900), ("y", "B", 0, len(LONG)), ("n", "N", 5, 5)]),
        (3, "nothing here", []),
    ]
    df = spark.createDataFrame(rows, f"id int, text string, entities {spans.SPANS}")
    inline = df.select("id", F.posexplode(spans.token_tags(F.col("text"), F.col("entities"))).alias("pos", "t"))
    inline = inline.select("id", "pos", "t.*")
    table = entities.tag_tokens(df, _listed(df), "id", "text")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, inline.collect()))


def test_segments_rebuild_the_text(spark):
    rows = [
        (1, "abcdefghij", [("", "X", 2, 4), ("", "Y", 6, 8)]),
        (2, "abcdefghij", [("", "X", 2, 6), ("", "Y", 4, 3)]),
        (3, "abc", []),
    ]
    df = spark.createDataFrame(rows, f"id int, text string, entities {spans.SPANS}")
    got = {
        r.id: [tuple(p) for p in r.s]
        for r in df.select("id", spans.text_segments(F.col("text"), F.col("entities")).alias("s")).collect()
    }
    assert got[1] == [("ab", None), ("cd", "X"), ("ef", None), ("gh", "Y"), ("ij", None)]
    assert got[2] == [("ab", None), ("cdef", "X"), ("", "Y"), ("efghij", None)]
    assert got[3] == [("abc", None)]


def test_clean_entities(spark):
    rows = [
        (1, None),
        (2, [("t", None, 1, 2), (None, "L", 1, 2), ("t", "L", None, None), ("u", "M", 3, 4)]),
        (3, []),
    ]
    df = spark.createDataFrame(rows, f"id int, entities {spans.SPANS}")
    got = {r.id: [tuple(e) for e in r.c] for r in df.select("id", spans.clean_entities(F.col("entities")).alias("c")).collect()}
    assert got == {1: [], 2: [("t", "L", 0, 0), ("u", "M", 3, 4)], 3: []}


TEXTS = [
    (1, "Wall and main road near Jayanagar 4th Block; drain, DRAIN drainage"),
    (2, "nothing"),
    (3, "road main road main"),
    (4, "no water supply in Gandhi Nagar"),
]
EXPECTED = {
    1: [("Wall", 0), ("main road", 9), ("Jayanagar 4th Block", 24), ("drain", 45), ("DRAIN", 52)],
    3: [("road", 0), ("main road", 5)],
    4: [("water supply", 3), ("Gandhi Nagar", 19)],
}


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
def test_gazetteer_join(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame(TEXTS, "id int, text string")
    found = entities.extract_entities(df, entities.seed_gazetteer(spark), "id", "text")
    got = {r.id: [(e.text, e.start) for e in r.entities] for r in found.collect()}
    assert got == {2: [], **EXPECTED}


def test_gazetteer_names_of_any_length(spark):
    name = "old town hall of the lower eastern ward"
    names = spark.createDataFrame([(name, "LOCATION"), ("hall", "PROBLEM")], "term string, label string")
    df = spark.createDataFrame([(1, f"at Old town hall of the lower eastern ward, hall {name.replace(' ', '  ', 1)}")], "id int, text string")
    got = entities.extract_entities(df, names, "id", "text").first().entities
    assert [(e.text.lower(), e.start) for e in got] == [(name, 3), ("hall", 44), ("hall", 59)]


def test_offsets_of_odd_characters(spark):
    df = spark.createDataFrame([(1, "gas\x01leak near wall"), (2, "\u0130ndiranagar wall"), (3, None)], "id int, text string")
    found = df.select("id", spans.gazetteer_spans(F.col("text"), enrich.SEED_GAZETTEER).alias("e")).collect()
    got = {r.id: [(e.text, e.label, e.start, e.end) for e in r.e or []] for r in found}
    assert [x for x in got[1] if x[0] == "wall"] == [("wall", "PROBLEM", 14, 18)]
    assert got[2] == [("wall", "PROBLEM", 12, 16)]
    assert all(label for hits in got.values() for _, label, _, _ in hits)


def test_long_texts_stay_linear(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "wall in jayanagar " * n)], "id int, text string")
        found = spans.gazetteer_spans(F.col("text"), enrich.SEED_GAZETTEER)
        start = time.perf_counter()
        assert df.select(F.size(found)).first()[0] == 2 * n
        rows = entities.extract_entities(df, entities.seed_gazetteer(spark), "id", "text")
        assert len(rows.first().entities) == 2 * n
        return time.perf_counter() - start

    seconds(10)
    assert seconds(10_000) < 10 * max(seconds(2_000), 1)


def test_gazetteer_inline(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    found = df.select("id", spans.gazetteer_spans(F.col("text"), enrich.SEED_GAZETTEER).alias("e"))
    got = {r.id: [(e.text, e.start) for e in r.e] for r in found.collect()}
    assert got == {1: [], 2: [], 3: [], 4: [], **EXPECTED}


def test_lookup_join_follows_measured_bytes(spark, monkeypatch):
    facts = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    lookup = facts.select("k").distinct().withColumn("v", F.length("k"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = joins.lookup_join(facts, lookup, "k")
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wide = joins.lookup_join(facts, lookup, "k")
        assert "Broadcast" not in plan(wide)
        assert wide.count() == small.count() == 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_captions_of_damaged_entities(spark):
    rows = fixtures.raw_entities(spark, SF)
    cleaned = spans.clean_entities(F.col("entities"))
    shown = rows.select(spans.entity_caption(cleaned).alias("c"), cleaned.alias("e")).limit(50).collect()
    for row in shown:
        plain = [f"{e.text.strip()}({e.label.strip()})" if e.label.strip() else e.text.strip() for e in row.e if e.text.strip()]
        assert row.c == ", ".join(plain)


def test_places_of_few_and_of_many_names_agree(spark, monkeypatch):
    bodies = ["", None, "road", "Road wall\x01road", "é😀 gas leak, DRAIN road-wall " * 12]
    frame = spark.createDataFrame([(t,) for t in bodies], "t string")
    found = []
    for few in (0, 10**6):
        monkeypatch.setattr(spans, "_FEW", few)
        found.append([r[0] for r in frame.select(spans.gazetteer_spans(F.col("t"), enrich.SEED_GAZETTEER)).collect()])
    assert found[0] == found[1] and len(found[0][-1]) == 48 and found[0][1] == []


def test_names_looked_up_and_names_joined_agree(spark, monkeypatch):
    names = [("wall", "B"), ("wall", "A"), ("main road", "R"), ("road wall", None), ("i\u0307zmir", "P"), ("caf\u00e9 x", "C"), ("Road", "U"), ("!!", "N")]
    names = spark.createDataFrame(names, "term string, label string")
    bodies = ["", None, "Wall", "main  road, MAIN ROAD wall", "\u0130zmir main road", "CAF\u00c9 X wall", "\U0001f600 wall. " * 40, "main road wall " * 30]
    # The last two rows have one key.
    df = spark.createDataFrame([(min(i, 6), t) for i, t in enumerate(bodies)], "id int, text string")
    found = []
    for few in (entities.FEW_NAMES, 0):
        monkeypatch.setattr(entities, "FEW_NAMES", few)
        found.append({r.id: r.entities for r in entities.extract_entities(df, names, "id", "text").collect()})
    assert found[0] == found[1]
    assert [(e.text, e.label, e.start) for e in found[0][4]] == [("\u0130zmir", "P", 0), ("main road", "R", 6)]
    assert [(e.text, e.label) for e in found[0][2]] == [("Wall", "A")] and len(found[0]) == 7


def test_few_names_shuffle_one_row_per_text(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    plan = entities.extract_entities(df, entities.seed_gazetteer(spark), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan
