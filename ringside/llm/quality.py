"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text is turned into a fixed vector of statistics. A class is a Gaussian whose covariance is shrunk towards
the pooled one and towards a multiple of the identity; the score is the logistic of the difference of the two log
densities plus the log prior ratio, with Mahalanobis distances from Cholesky factors that are worked out once.

Defined results: a null or blank text is scored like any other (all its statistics are 0). Rows are scored one by one,
so repeated rows get equal scores. Labels that are null or neither 0 nor 1 are not learned from. With fewer than two
labelled rows in a class no covariance exists and every score is the smoothed share of label 1. Only ``doc_id`` and the
text column are read; other columns pass through, and the output columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.3
#: At most so many labelled rows are learned from, those with the smallest hash of their id.
MAX_LABELLED = 20_000
TO_POOLED, TO_IDENTITY = 0.3, 0.05
_BREAK = re.compile(r"[.!?](?:\s|$)")


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return np.zeros(15)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    blanks = chars - sum(map(len, words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")" for w in words)
    lone = sum(not any(map(str.isalnum, w)) for w in words)
    visible = max(1, chars - blanks)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    return np.array([
        math.log1p(n),
        math.log(mean),
        math.log1p(sum((x - mean) ** 2 for x in lengths) / n),
        math.sqrt(upper / max(1, letters)),
        math.sqrt(digits / visible),
        math.sqrt((visible - letters - digits) / visible if visible > letters + digits else 0.0),
        math.sqrt(marked / n),
        math.sqrt(lone / n),
        math.sqrt(again / n),
        math.log(len(counts)) / math.log(n + 1),
        math.sqrt(max(counts.values()) / n),
        len(set(lines)) / len(lines),
        math.log1p(n / (1 + len(_BREAK.findall(text)))),
        math.log1p(n / len(lines)),
        math.sqrt(text.count("!") / visible),
    ])


@dataclass
class Discriminant:
    """Fitted model; ``factors`` are the inverse Cholesky factors of the two covariances."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.offset)
        if self.means is not None:
            for sign, mean, factor in zip((-1, 1), self.means, self.factors, strict=True):
                z = (x - mean) @ factor.T
                logit += sign * (-0.5 * (z * z).sum(1))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _moments(frames):
    """Count, sum and products per class of a partition's labelled rows."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for label, text in zip(frame["label"], frame["text"], strict=True):
            x = np.append(statistics(text), 1.0)
            sums[label] = sums.get(label, 0) + np.outer(x, x)
    for label, m in sums.items():
        yield pd.DataFrame({"label": int(label), "place": np.arange(m.size), "value": m.ravel()})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None,
        max_labelled: int = MAX_LABELLED) -> Discriminant:
    """Learn from labelled rows for which ``learn`` holds; only class moments come to the driver."""
    chosen = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("labelled").isNotNull())
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "label").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    moments = rows.select("label", "text").mapInPandas(_moments, "label int, place int, value double")
    got = moments.groupBy("label", "place").agg(F.sum("value").alias("value")).toPandas()
    size = int(math.isqrt(int(got["place"].max()) + 1)) if len(got) else 0
    m = np.zeros((2, size, size))
    for k in (0, 1):
        part = got[got["label"] == k]
        m[k].ravel()[part["place"].to_numpy(int)] = part["value"]
    counts = m[:, -1, -1] if size else np.zeros(2)
    prior = math.log((counts[1] + 1) / (counts[0] + 1))
    if not size or counts.min() < 2:
        return Discriminant(None, None, prior)
    means = m[:, -1, :-1] / counts[:, None]
    scatter = m[:, :-1, :-1] - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / counts.sum()
    factors, offset = [], prior
    for k, sign in ((0, -1), (1, 1)):
        own = (1 - TO_POOLED) * scatter[k] / counts[k] + TO_POOLED * pooled
        # the identity is scaled per statistic, as these have different units
        own = (1 - TO_IDENTITY) * own + TO_IDENTITY * np.diag(np.diag(pooled) + 1e-6)
        root = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(root))
        offset -= sign * np.log(np.diag(root)).sum()
    return Discriminant(means, np.array(factors), float(offset))


def score(model: Discriminant, text: Column) -> Column:
    """Score column of a fitted model."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.stack([statistics(t) for t in texts])))

    return scored(text)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def predict(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with ``score`` and ``predicted``."""
    scored = docs.withColumn("score", score(model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Discriminant:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels, learn=fold(F.col("labelled")) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = held_out_model(spark, docs, sf_dir)
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with the columns of ``docs``."""
    model = held_out_model(spark, docs, sf_dir)
    return docs.where(score(model, F.col("text")) >= THRESHOLD)
