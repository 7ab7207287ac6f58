import math
import random
from collections import Counter

import numpy as np
import pytest

from wardline.operators import softmax_heads
from wardline.plans import catalog

HEADS = {"topic": ["road", "water", "light"], "loud": ["0", "1"]}
L2 = 1e-2


def _sample(seed=2, n=120):
    rng = random.Random(seed)
    stock = {"road": ["pothole", "asphalt", "lane"], "water": ["leak", "pipe", "tap"], "light": ["lamp", "dark", "bulb"]}
    rows = []
    for i in range(n):
        topic, loud = rng.choice(HEADS["topic"]), rng.choice("01")
        body = rng.choices(stock[topic] + ["the", "near", "street"], k=6) + (["now", "urgent"] if loud == "1" else ["please"])
        rows.append((i, " ".join(body), topic if i % 9 else None, loud if i % 7 else "unknown label"))
    return rows + [(n, None, "road", "1"), (n + 1, "", "road", "0")]


def _solved(rows):
    """Loss at the optimum by plain Newton steps on dense matrices."""
    texts = [(r[1] or "").split() for r in rows if r[1] is not None]
    terms = sorted({w for t in texts for w in t})
    x = np.zeros((len(texts), len(terms) + 1))
    for i, t in enumerate(texts):
        norm = math.sqrt(sum(c * c for c in Counter(t).values())) or 1.0
        for w, c in Counter(t).items():
            x[i, terms.index(w)] = c / norm
        x[i, -1] = 1
    total = 0.0
    for at, labels in ((2, HEADS["topic"]), (3, HEADS["loud"])):
        known = [i for i, r in enumerate([r for r in rows if r[1] is not None]) if r[at] in labels]
        y = np.array([labels.index([r for r in rows if r[1] is not None][i][at]) for i in known])
        a, w = x[known], np.zeros((x.shape[1], len(labels)))
        for _ in range(40):
            m = a @ w
            p = np.exp(m - m.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = a.T @ (p - np.eye(len(labels))[y]) / len(y) + L2 * w
            k, d = len(labels), x.shape[1]
            h = L2 * np.eye(k * d)
            for i in range(len(y)):
                h += np.kron(np.diag(p[i]) - np.outer(p[i], p[i]), np.outer(a[i], a[i])) / len(y)
            w -= np.linalg.solve(h, g.T.ravel()).reshape(k, d).T
        total += -np.log(p[np.arange(len(y)), y]).mean() + L2 / 2 * (w * w).sum()
    return total


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rows = _sample()
    df = spark.createDataFrame(rows, "id int, text string, topic string, loud string")
    path = str(tmp_path_factory.mktemp("softmax"))
    return rows, df, softmax_heads.train_softmax(df, "id", "text", HEADS, path, l2=L2, tolerance=1e-9)


def test_loss_is_that_of_a_dense_solver(trained):
    rows, _, model = trained
    assert model.loss == pytest.approx(_solved(rows), abs=1e-6)
    assert model.rounds < 60


def test_scores_of_rows_not_trained_on(spark, trained):
    _, _, model = trained
    rows = _sample(seed=5)
    df = spark.createDataFrame(rows, "id int, text string, topic string, loud string")
    scored = {r.id: r for r in softmax_heads.score_softmax(df, model, "id", "text").collect()}
    assert set(scored) == {r[0] for r in rows if r[1] is not None}
    for r in scored.values():
        assert sum(e.score for e in r.topic_scores) == pytest.approx(1.0)
    right = [max(scored[r[0]].topic_scores, key=lambda e: e.score).label == r[2] for r in rows if r[0] in scored and r[2] and r[1]]
    assert np.mean(right) > 0.95


def test_nothing_labelled(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", None, None)], "id int, text string, topic string, loud string")
    model = softmax_heads.train_softmax(df, "id", "text", HEADS, str(tmp_path), rounds=3)
    assert all(w == 0 for r in model.weights.collect() for w in r.weights)


def test_terms_do_not_move_in_a_round(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(_sample(), "id int, text string, topic string, loud string")
    with softmax_heads._partitions(spark, 3):
        problem = softmax_heads._Problem(df, "id", "text", HEADS, str(tmp_path), L2, 3)
        state, few = problem.measured(problem.start(), "0")
        monkeypatch.setattr(softmax_heads, "BROADCAST_BYTES", -1)
        plan = problem._joined("term", state.select("term", "w"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "ShuffledHashJoin" in plan
        moved = state.selectExpr("term", "transform(g, x -> -x) as w")
        many = problem.measured(moved, "1")
        monkeypatch.undo()
        again = problem.measured(moved, "2")
        problem.close()
    assert math.isclose(few, math.log(3) + math.log(2)) and many[1] < few and math.isclose(many[1], again[1])
    left, right = ({r.term: r.g for r in x[0].collect()} for x in (many, again))
    assert left.keys() == right.keys() and all(np.allclose(left[t], right[t]) for t in left)


def test_the_query_trains_until_the_loss_stays(spark, monkeypatch):
    rows = [(i, "pothole lane" if i % 2 else "leak tap", i % 2, i % 3 % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    monkeypatch.setattr(catalog, "_labelled_documents", lambda *_: df)
    seen, descend = [], softmax_heads._descend

    def watched(problem, rounds, tolerance):
        seen.append((rounds, tolerance))
        return descend(problem, 0, tolerance)  # the rounds themselves are compared with a dense solver above

    monkeypatch.setattr(softmax_heads, "_descend", watched)
    catalog.QUERIES["softmax_eval"](spark, "")
    assert seen == [(None, 1e-7)]


def test_a_step_that_leads_nowhere_ends_the_training(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(_sample(n=12), "id int, text string, topic string, loud string")
    measured = softmax_heads._Problem.measured
    monkeypatch.setattr(softmax_heads, "SHORTEST", 0.3)
    monkeypatch.setattr(softmax_heads._Problem, "measured", lambda self, state, name: (measured(self, state, name)[0], 1.0 if name == "0" else math.nan))
    model = softmax_heads.train_softmax(df, "id", "text", HEADS, str(tmp_path))
    assert (model.loss, model.rounds) == (1.0, 1)
    assert all(w == 0 for r in model.weights.collect() for w in r.weights)
    assert [p.name for p in tmp_path.iterdir()] == ["weights"]
