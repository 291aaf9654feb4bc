"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text becomes the relative frequencies of its hashed character n-grams; the model averages an
embedding for each bucket with these weights and puts a linear softmax on top. Both layers are
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents.
A temperature fitted on a part of that sample calibrates the probabilities, and the rejection
threshold is a low quantile of the calibrated probability of right answers there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
#: Characters taken at a time; n-grams that cross a cut are taken with the later part.
CHUNK = 1 << 16
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or mark that may stand inside a word."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def features(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of the hashed n-grams of all words of the whole text, or None without a letter."""
    total = np.zeros(buckets, np.float64)
    seen = False
    table = _letters()
    top = max(ORDERS) + 1
    for at in range(0, len(text), CHUNK):
        lead = min(at, top)
        part = np.frombuffer(text[at - lead : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[part]
        if not letter.any():
            continue
        seen = True
        code = np.where(letter, part, np.uint32(1)).astype(np.uint64)
        code = np.concatenate([code, [np.uint64(1)]]) if at + CHUNK >= len(text) else code
        edge = code == 1
        key = np.zeros(len(code), np.uint64)
        for n in range(1, top):
            # key of the n code points that end here
            key = key * np.uint64(0x9E3779B97F4A7C15) + code if n == 1 else np.concatenate([np.zeros(1, np.uint64), key[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + code
            if n not in ORDERS:
                continue
            whole = np.ones(len(code), bool)
            for j in range(1, n - 1):  # a word edge may stand at either end only
                whole[j:] &= ~edge[: len(edge) - j]
            whole[: n - 1 if at == lead == 0 else max(n - 1, lead)] = False
            if n == 1:
                whole &= ~edge
            else:
                both = edge.copy()
                both[n - 1 :] &= edge[: len(edge) - n + 1]
                whole &= ~both
            k = key[whole] + np.uint64(n)
            k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((k >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return total if seen else None


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """``counts``: a row for each text."""
        x = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        z = ((x @ self.embedding) @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: list[str], width: int = 16, steps: int = 1500, rate: float = 20.0, seed: int = 7, keep: float = 0.999) -> Model:
    """Fit on rows of counts ``x`` with labels ``y`` in at least ``steps`` batches; a fifth of them calibrates.

    ``keep``: the share of rightly labelled calibration rows that the threshold must accept.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(y))
    target = np.array([languages.index(v) for v in y], np.int64)
    x = x / np.maximum(x.sum(1, keepdims=True), np.float32(1))
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    if not len(held):
        held = fit
    k = len(languages)
    embedding = rng.normal(0, 0.1, (x.shape[1], width))
    weights, bias = rng.normal(0, 0.1, (width, k)), np.zeros(k)
    parts = max(1, len(fit) // 32)
    epochs = -(-steps // parts)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(fit), parts):
            h = x[batch] @ embedding
            z = h @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), target[batch]] -= 1
            p /= len(batch)
            back = p @ weights.T
            weights -= step / 20 * (h.T @ p)
            bias -= step / 20 * p.sum(0)
            embedding -= step * (x[batch].T @ back)
    z = (x[held] @ embedding) @ weights + bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), target[held]]).mean())

    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    model = Model(languages, embedding, weights, bias, float(temperature), 0.0)
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == target[held]
    if right.any():
        # never above even odds: the sample need not hold the rarest clean texts
        model.threshold = float(min(0.5, np.quantile(p[right].max(1), 1 - keep)))
    return model


def sample(docs: DataFrame, learn: F.Column, per_language: int, max_languages: int = 512) -> pd.DataFrame:
    """Feature counts of up to ``per_language`` documents of each learnable language.

    The rows are those of least hash of the text; texts are turned into counts on the executors.
    The bounds limit what reaches the driver; ``max_languages`` keeps the most frequent labels.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(lang, h, f) for lang, h, text in zip(pdf["lang"], pdf["h"], pdf["text"], strict=True) if (f := features(text)) is not None]
            cells = [np.flatnonzero(f).astype(np.int32) for _, _, f in found]
            yield pd.DataFrame({"lang": [v for v, _, _ in found], "h": [h for _, h, _ in found], "cell": cells, "n": [f[c].astype(np.float32) for (_, _, f), c in zip(found, cells, strict=True)]})

    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    # the hash is uniform, so these shares bring a little more than enough rows past the filter
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    shares = {r["lang"]: 2.0 * per_language / r["count"] for r in sizes.collect()}
    if not shares:
        return pd.DataFrame({"lang": [], "h": [], "cell": [], "n": []})
    cut = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, v))) for k, v in shares.items()))
    rows = rows.where(F.pmod("h", F.lit(1_000_003)) < cut * 1_000_003).dropDuplicates(["lang", "h"])
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("i") <= per_language)
    return ranked.select("lang", "h", "text").mapInPandas(count, "lang string, h long, cell array<int>, n array<float>").toPandas()


def fit(docs: DataFrame, learn: F.Column, per_language: int = 400) -> Model | None:
    """Train on at most ``per_language`` labelled documents of each language; None without any."""
    rows = sample(docs, learn, per_language).sort_values(["lang", "h"]).reset_index(drop=True)
    if not len(rows):
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (cell, n) in enumerate(zip(rows["cell"], rows["n"], strict=True)):
        x[i, cell] = n
    return train(x, rows["lang"].tolist())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (calibrated probability) and rejected.

    Texts that are null, empty or without a letter give ``und``, score 0 and are rejected; so is
    every text if there is no model. All other texts get a learned language, and are rejected
    when its probability is below the model's threshold.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if model is not None:
            for i, text in enumerate(texts):
                counts = features(text) if text else None
                if counts is not None:
                    p = model.probabilities(counts[None])[0]
                    j = int(p.argmax())
                    lang[i], score[i], rejected[i] = model.languages[j], float(p[j]), bool(p[j] < model.threshold)
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    found = docs.withColumn("__lang", classify(F.col(text_col)))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return found.select(*(F.col(f"`{c}`") for c in keep), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"), F.col("__lang.rejected").alias("rejected"))
