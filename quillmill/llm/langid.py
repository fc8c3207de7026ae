"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Fitting. Document frequencies are counted over all rows that may be learnt from. The regression
is trained by follow-the-regularised-leader (proximal, one rate per weight) with L1 and L2
penalties, on a sample with a documented bound: about ``per_language`` rows of each of the
``max_languages`` most frequent languages, and ``max_rows`` in all, chosen by a hash of the id. A fifth of the sample is
kept aside to fit the temperature that calibrates the probabilities.

Cases: null texts and texts without a letter get ``und`` with score 0; so does every text if
nothing could be learnt (empty table, no labels). With one learnt language, that one has score 1.
Of equal probabilities the language that sorts first wins. Whole texts are used, however long. Repeated rows are predicted alike. Only the given text column
is read for a prediction.
"""

from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction_of

#: Hashed n-grams; n from 1 to 3.
DIMS, ORDERS = 1 << 15, (1, 2, 3)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the lower-cased text: their numbers, their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    parts, key = [], np.zeros(len(points), dtype=np.uint64)
    for n in ORDERS:
        if len(points) < n:
            break
        key = key[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        mixed = key * np.uint64(0x9E3779B97F4A7C15)
        parts.append((mixed >> np.uint64(49)).astype(np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=DIMS) if parts else np.zeros(DIMS, dtype=np.int64)
    where = np.flatnonzero(counts)
    return where, counts[where]


def tfidf(where: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length values of 1 + ln(count), times idf."""
    v = (1.0 + np.log(counts)) * idf[where]
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


class FTRL:
    """Proximal follow-the-regularised-leader for softmax regression with an elastic net."""

    def __init__(self, classes: int, dims: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.01):
        self.z, self.n = np.zeros((classes, dims)), np.zeros((classes, dims))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, where=slice(None)) -> np.ndarray:
        z, n = self.z[:, where], self.n[:, where]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, where: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(where)
        p = softmax(w @ values)
        p[label] -= 1.0
        g = p[:, None] * values[None, :]
        n = self.n[:, where]
        more = n + g * g
        self.z[:, where] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[:, where] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held-aside rows; 1 if there are none."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.02, 5.0, 80)
    loss = [-np.mean(np.log(softmax(logits / t)[labels, np.arange(len(labels))] + 1e-12)) for t in grid]
    return float(grid[int(np.argmin(loss))])


class LanguageModel:
    """What prediction needs; about 130 kB a language."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf.astype(np.float32), weights.astype(np.float32), temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        where, counts = ngram_counts(text)
        v = tfidf(where, counts, self.idf)
        p = softmax(self.weights[:, where] @ v / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows: in how many texts each hashed n-gram occurs, and the number of texts.
    Each partition sums up first; the shuffle carries DIMS rows a partition at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, rows = np.zeros(DIMS + 1, dtype=np.int64), 0
        for batch in batches:
            for t in batch[text]:
                if t is not None:
                    df[ngram_counts(t)[0]] += 1
                    rows += 1
        df[DIMS] = rows
        where = np.flatnonzero(df)
        yield pd.DataFrame({"feature": where, "n": df[where]})

    found = texts.select(text).mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, dtype=np.int64)
    for r in found:  # DIMS + 1 rows at most
        df[r.feature] = r.n
    return df[:DIMS], int(df[DIMS])


def language_sample(rows: DataFrame, text: str, label: str, key: str, per_language: int, max_languages: int, max_rows: int) -> DataFrame:
    """About ``per_language`` rows of each language, fewer if there are so many languages that ``max_rows`` would be passed, by a hash of the key: columns label, text."""
    sizes = rows.groupBy(F.col(label).alias("label")).count().orderBy(F.desc("count"), "label").limit(max_languages).collect()
    each = min(per_language, max(1, max_rows // max(1, len(sizes))))
    share = rows.sparkSession.createDataFrame([(r["label"], each / r["count"]) for r in sizes], "label string, share double")
    picked = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), fraction_of(F.col(key).cast("string"), F.lit("language")).alias("u"))
    return picked.join(F.broadcast(share), "label").where("u < share").select("label", "u", "text")  # max_languages rows are broadcast


def fit_language_model(rows: DataFrame, text: str, label: str, key: str, per_language: int = 700, max_languages: int = 300, max_rows: int = 12_000, epochs: int = 3) -> LanguageModel:
    """Learn from all ``rows`` with text and label; ``key`` only picks the sample."""
    rows = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    df, n = document_frequencies(rows, text)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ngram_counts(t) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "u": b["u"], "places": [w.astype("<u2").tobytes() for w, _ in got], "counts": [c.astype("<u4").tobytes() for _, c in got]})

    sample = language_sample(rows, text, label, key, per_language, max_languages, max_rows)
    got = sorted(sample.mapInPandas(features, "label string, u double, places binary, counts binary").collect(), key=lambda r: (r.u, r.label, bytes(r.places)))
    languages = sorted({r.label for r in got})
    place = {x: i for i, x in enumerate(languages)}
    # Places and counts stay as they came (6 bytes an n-gram); values are made when a row is learnt from.
    xs = lambda i: (lambda w: (w, tfidf(w, np.frombuffer(got[i].counts, "<u4").astype(np.int64), idf)))(np.frombuffer(got[i].places, "<u2").astype(np.int64))
    ys = np.array([place[r.label] for r in got], dtype=np.int64)
    aside = np.arange(len(ys)) % 5 == 4
    model = FTRL(max(1, len(languages)), DIMS)
    for _ in range(epochs):
        for i in np.flatnonzero(~aside):
            model.learn(*xs(i), ys[i])
    w = model.weights()
    held = np.flatnonzero(aside)
    logits = np.array([w[:, at] @ v for at, v in map(xs, held)]).T if len(held) else np.zeros((len(languages), 0))
    return LanguageModel(languages, idf, w[: len(languages)], best_temperature(logits, ys[held]))


def predict_language(df: DataFrame, model: LanguageModel):
    """A function of a text column: struct of lang_pred and score."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict
