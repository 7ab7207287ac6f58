"""The registered queries over whole test tables: against SQL, or against brute force where SQL ends."""

import glob
import os

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from conftest import SF

from wardline.llm.common import Scratch
from wardline.llm.queries import ORACLES, PACK_TOKENIZER, QUERIES, public_file, table


def _canonical(arrow):
    arrow = arrow.select(sorted(arrow.column_names))
    types = [(f.name, str(f.type).replace("large_", "")) for f in arrow.schema]
    return types, sorted(zip(*[c.to_pylist() for c in arrow.columns]), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert _canonical(QUERIES[name](spark, SF).toArrow()) == _canonical(duck.execute(ORACLES[name]).to_arrow_table())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    rows = QUERIES["op4_packing"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_file(PACK_TOKENIZER))
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc) == brute.pieces(ids, 2048)


def test_suffixes(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    want = brute.repeats(texts)
    assert got == {d: (n, gone, spans, brute.sha256(kept)) for (d, _), (n, gone, spans, kept) in zip(texts, want)}


def test_secrets(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op10_secrets"](spark, SF).collect()}
    for doc, text in texts:
        assert got[doc].base_sha256 == brute.sha256(",".join(brute.base_spans(text)).encode())


def test_whitening(spark):
    rows = QUERIES["op12_whitening"](spark, SF).toPandas()
    given = table(spark, SF, "embeddings").toPandas()
    x = np.floor(64 * np.vstack(given.embedding).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ v[:, ::-1][:, :32] / np.sqrt(e[::-1][:32])
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given.vec_id].to_numpy()
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8
    assert (rows[rows.component == 1].set_index("vec_id").deviation.loc[given.vec_id] == ((n * x - s) ** 2).sum(1)).all()
    assert rows.identity_error.max() < 1e-10 and len(rows) == 32 * n


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer, models

    from wardline.llm.queries import COUNT_VOCABULARY
    from wardline.llm.token_counts import load_pieces

    model = Tokenizer(models.Unigram(load_pieces(public_file(COUNT_VOCABULARY)), 0, True))
    got = {r.doc_id: r.n_tokens for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    for doc, text in texts:
        assert got[doc] == len(model.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids)


def test_leaks(spark, texts):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    assert got == {(d, i) for d, t in texts for i, q in items if q in t}


def test_stages_of_the_pipeline(spark, texts):
    scratch, docs, names = Scratch(spark, "t"), table(spark, SF, "documents"), table(spark, SF, "documents").columns
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, SF), str(number))
        if number < 4:
            assert docs.columns == names
            kept.append([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    stay = {d for d, _ in kept[0]}
    good = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0}
    bad = set(labels) - good
    assert len(good & stay) >= 0.97 * len(good) and len(bad - stay) >= 0.8 * len(bad)
    assert kept[1] == [(d, "\n".join(lines)) for d, _, lines in brute.kept_lines(kept[0])]
    groups = brute.jaccard(kept[1], 5, 80)
    assert kept[2] == [row for i, (row, (_, root)) in enumerate(zip(kept[1], groups)) if i == root]
    assert [d for d, _ in kept[3]] == [d for d, t in kept[2] if not any(q in t for q in items)]
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in kept[3]}
