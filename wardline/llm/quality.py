"""Quality classifier with hierarchical empirical Bayes over sites.

For each head (a 0/1 label for "bad") a logistic model on the words and the make-up of a text gives a
document's evidence. Sites have rates of their own: the rate of a host is its documents' mean
probability, shrunk toward the global mean; the rate of a path likewise, toward its host. How hard
they are shrunk is estimated from the data: the pull kappa is that of the beta distribution whose
variance is what is left of the variance between sites after sampling noise. A document's own
probability is taken out of its site's sums before they speak about it. Its posterior log odds are
the evidence with the prior of the training rows replaced by the rate of its path.

Models are fitted on at most ``sample_rows`` labelled rows (the smallest hashes of their ids) and know
at most ``most_words`` words a head; sums and rates cover all documents.

Defined cases: a null text counts as empty and is judged like one; null hosts and paths are sites of
their own; labels that are null are unlabelled, several labels of an id count as their largest; a head
whose labels are all alike or missing gives no evidence, its probability is null and rejects nobody;
rows with equal or null ids are judged one by one.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, packed, small, unpacked

MAKEUP = ["length", "symbols", "digits", "capitals", "distinct", "word_length", "bursts", "bars", "repeats"]
CLIP = 30.0


def described(df: DataFrame) -> DataFrame:
    """``df`` with ``words`` (distinct) and the columns of ``MAKEUP`` from ``_text``."""
    text = F.coalesce("_text", F.lit(""))
    out = df.withColumn("all_words", F.split(F.lower(text), r"[^\p{L}']+"))
    out = out.withColumns({"words": F.array_distinct("all_words"), "chars": F.greatest(F.char_length(text), F.lit(1))})
    chars, number = F.col("chars"), F.size("all_words")
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    again = F.zip_with("all_words", F.slice("all_words", 2, number), lambda a, b: (a == b) & (a != ""))
    return out.withColumns({
        "length": F.log1p(number),
        "symbols": left(r"[\p{L}\p{N}\s]+") / chars,
        "digits": left(r"[^0-9]+") / chars,
        "capitals": left(r"[^\p{Lu}]+") / chars,
        "distinct": F.size("words") / number,
        "word_length": F.least(chars / number, F.lit(50.0)),
        "bursts": F.log1p(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}"))),
        "bars": F.log1p(F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit("")))),
        "repeats": F.log1p(F.size(F.filter(again, lambda x: x))),
    }).drop("all_words", "chars")


def _told(telling: list[tuple[str, float]]) -> Column:
    """The log odds of the telling words among ``words``, summed."""
    if not telling:
        return F.lit(0.0)
    names = F.array(*[F.lit(w) for w, _ in telling])
    odds = F.array(*[F.lit(o) for _, o in telling])
    place = lambda w: (F.array_position(names, w) - 1).cast("int")
    return F.aggregate(F.array_intersect("words", names), F.lit(0.0), lambda total, w: total + F.get(odds, place(w)))


class Model:
    """Telling words with their log odds and a logistic model per head; ``base`` are training log odds."""

    def __init__(self, words: dict[str, list[tuple[str, float]]]):
        self.words = words
        self.heads: dict = dict.fromkeys(words)
        self.base: dict[str, float] = {}

    def features(self, df: DataFrame) -> DataFrame:
        """``df`` with ``f_<head>``: the make-up and the summed log odds of the telling words in it."""
        for head, telling in self.words.items():
            df = df.withColumn(f"w_{head}", _told(telling))
            df = VectorAssembler(inputCols=[*MAKEUP, f"w_{head}"], outputCol=f"f_{head}").transform(df)
        return df

    def evidence(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``_text``) and the log odds ``e_<head>``, null for a head without a model."""
        keep, out = df.columns, df
        if any(self.heads.values()):
            out = self.features(described(df))
        for name, head in self.heads.items():
            if head is None:
                out = out.withColumn(f"e_{name}", F.lit(None).cast("double"))
                continue
            raw, p, y = f"raw_{name}", f"p_{name}", f"y_{name}"
            out = head.setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(y).transform(out)
            odds = F.get(vector_to_array(raw), 1)
            out = out.withColumn(f"e_{name}", F.greatest(F.least(odds, F.lit(CLIP)), F.lit(-CLIP))).drop(raw, p, y)
        return out.select(*keep, *[f"e_{name}" for name in self.heads])


def telling_words(rows: DataFrame, head: str, positives: int, number: int, most: int, sure: float, strong: float) -> list[tuple[str, float]]:
    """Words that mark bad rows, the surest first.

    Their log odds ratio is at least ``strong``, so that words of a language or topic with somewhat
    more bad rows stay out, and at least ``sure`` standard errors from nothing.
    """
    told = rows.where(F.col(head).isNotNull())
    counts = told.select(head, F.explode("words").alias("w")).groupBy("w").agg(F.sum(head).alias("a"), F.count("*").alias("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    odds = F.log((a + 0.5) / (positives - a + 0.5)) - F.log((b + 0.5) / (number - positives - b + 0.5))
    scored = counts.where("w != ''").select("w", odds.alias("odds"), (odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).alias("z"))
    best = scored.where((F.col("z") >= sure) & (F.col("odds") >= strong)).orderBy(F.desc("z"), "w").limit(most)
    return [(r.w, r.odds) for r in best.collect()]


def fit(
    docs: DataFrame, labels: DataFrame, heads: dict[str, str], scratch: Scratch, key: str = "doc_id", text: str = "text",
    sample_rows: int = 20_000, most_words: int = 1000, sure: float = 2.5, strong: float = 3.0, label_key: str = "doc_id",
) -> Model:
    """``heads`` name 0/1 SQL expressions over the columns of ``labels``, 1 for bad."""
    told = labels.groupBy(F.col(f"`{label_key}`").alias("_key")).agg(*[F.max(F.expr(c).cast("double")).alias(n) for n, c in heads.items()])
    told = told.where(F.col("_key").isNotNull() & F.coalesce(*heads).isNotNull())
    sample = scratch.save(told.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows), "sample")
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    # The sample has a fixed bound.
    rows = described(texts.join(F.broadcast(sample), "_key")).select(*heads, "words", *MAKEUP)
    rows = scratch.save(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism), "fitted")
    facts = rows.agg(*[F.count(h).alias(f"n_{h}") for h in heads], *[F.sum(h).alias(f"s_{h}") for h in heads]).first()
    both = {h: (int(facts[f"s_{h}"]), facts[f"n_{h}"]) for h in heads if 0 < (facts[f"s_{h}"] or 0) < facts[f"n_{h}"]}
    model = Model({h: telling_words(rows, h, *both[h], most_words, sure, strong) if h in both else [] for h in heads})
    if both:
        ready = scratch.save(model.features(rows).select(*heads, *[f"f_{h}" for h in heads]), "features")
        for h, (positives, number) in both.items():
            learner = LogisticRegression(labelCol=h, featuresCol=f"f_{h}", maxIter=25, regParam=1e-5)
            model.heads[h] = learner.fit(ready.where(F.col(h).isNotNull()))
            model.base[h] = math.log(positives / (number - positives))
    scratch.drop("sample", "fitted", "features")
    return model


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(safe / (1 - safe))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _pull(spread: float | None, noise: float | None, mean: float | None) -> float:
    """The kappa of a beta distribution with this mean and the variance beyond noise."""
    if mean is None or spread is None:
        return 1.0
    between = max(spread - (noise or 0.0), 1e-9)
    return min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)


def site_rates(scored: DataFrame, heads: list[str], scratch: Scratch) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Sums per path with those of its host, and per head (global mean, pull of hosts, pull of paths).

    ``scored`` has ``_host``, ``_path`` and ``p_<head>``. Groups are summed before they are shuffled.
    """
    sums = [x for h in heads for x in (F.sum(f"p_{h}").alias(f"s_{h}"), F.sum(F.col(f"p_{h}") * (1 - F.col(f"p_{h}"))).alias(f"v_{h}"))]
    paths = scratch.save(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), *sums), "paths")
    up = [F.sum(f"{k}_{h}").alias(f"host_{k}_{h}") for h in heads for k in "sv"]
    hosts = scratch.save(paths.groupBy("_host").agg(F.sum("n").alias("host_n"), *up), "hosts")
    pulls = {}
    for h in heads:
        total = hosts.agg(F.sum(f"host_s_{h}"), F.sum("host_n")).first()
        mean = total[0] / total[1] if total[0] is not None and total[1] else None
        if mean is None:
            pulls[h] = (None, 1.0, 1.0)
            continue
        rate, n = F.col(f"host_s_{h}") / F.col("host_n"), F.col("host_n")
        spread, noise = hosts.agg(F.avg(F.pow(rate - mean, 2)), F.avg(F.col(f"host_v_{h}") / n / n)).first()
        host_pull = _pull(spread, noise, mean)
        near = (F.col(f"host_s_{h}") + host_pull * mean) / (n + host_pull)
        own = F.col(f"s_{h}") / F.col("n")
        both = paths.join(small(hosts, 200), "_host")
        spread, noise = both.agg(F.avg(F.pow(own - near, 2)), F.avg(F.col(f"v_{h}") / F.col("n") / F.col("n"))).first()
        pulls[h] = (mean, host_pull, _pull(spread, noise, mean))
    return scratch.save(paths.join(small(hosts, 200), "_host"), "sites"), pulls


def judge(
    docs: DataFrame, labels: DataFrame, heads: dict[str, str], key: str = "doc_id", text: str = "text", host: str = "source",
    path: str = "lang", threshold: float = 0.5, whole_rows: bool = True, **fitting,
) -> DataFrame:
    """``_row, _key`` with ``posterior_<head>``, ``rate_<head>`` (of the path) and ``keep``.

    With ``whole_rows`` the table that is written between the two passes holds all columns, so that
    texts are read once and never shuffled; without, ``_row`` is left out.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, heads, scratch, key, text, **fitting)
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    columns = {"_key": F.col(f"`{key}`"), "_text": F.col(f"`{text}`"), "_host": site(host), "_path": site(path)}
    rows = packed(docs, **columns) if whole_rows else docs.select(*[c.alias(n) for n, c in columns.items()])
    scored = model.evidence(rows).drop("_text")
    scored = scratch.save(scored.withColumns({f"p_{h}": _sigmoid(F.col(f"e_{h}")) for h in heads}), "scored")
    sites, pulls = site_rates(scored, list(heads), scratch)
    out = scored.join(small(sites, 400), ["_host", "_path"])
    rejected = F.lit(False)
    for h in heads:
        mean, host_pull, path_pull = pulls[h]
        if mean is None:
            out = out.withColumns({f"rate_{h}": F.lit(None).cast("double"), f"posterior_{h}": F.lit(None).cast("double")})
            continue
        p = F.col(f"p_{h}")
        at_host = (F.col(f"host_s_{h}") - p + host_pull * mean) / (F.col("host_n") - 1 + host_pull)
        at_path = (F.col(f"s_{h}") - p + path_pull * at_host) / (F.col("n") - 1 + path_pull)
        odds = F.col(f"e_{h}") - model.base[h] + _logit(at_path)
        out = out.withColumns({f"rate_{h}": at_path, f"posterior_{h}": _sigmoid(odds)})
        rejected = rejected | (F.col(f"posterior_{h}") > threshold)
    shown = ["_row"] * whole_rows + ["_key"] + [f"{k}_{h}" for h in heads for k in ("posterior", "rate")]
    return out.select(*shown, (~rejected).alias("keep"))


def kept_documents(docs: DataFrame, labels: DataFrame, heads: dict[str, str], **options) -> DataFrame:
    """The columns of the documents that no head rejects."""
    return unpacked(judge(docs, labels, heads, **options).where("keep"), docs.columns)
