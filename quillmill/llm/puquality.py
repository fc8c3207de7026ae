"""Quality classifier by positive-unlabelled learning.

A logistic score is trained on trusted positives and unlabelled web text by minimising the
non-negative unbiased risk: prior x loss of positives, plus the larger of 0 and (loss of unlabelled
as negatives less prior x loss of positives as negatives); where that part falls below 0 its
gradient is turned round. The class prior is estimated from a first classifier of positives against
unlabelled text: the least ratio of the shares of unlabelled text and of positives that score above
a cut, with a confidence margin ("best bin"), the median over several splits. The fit is a bag of
one model for each of ``SHARES`` of that prior, since a prior that is too high lets bad texts pass
and one that is too low costs little; the decay is the one of least risk on rows held aside.

Features do not depend on the language: shares of character and word kinds, and trigrams of nine
character classes. The sample has a documented bound of ``positives`` and ``unlabelled`` rows,
chosen by a hash of the id; of rows that share an id the least text is learnt from. Texts that a
caller holds out for measuring serve as unlabelled text like all others, without their labels.

Cases: null texts score as empty ones; empty texts get the score of their features like any
other. If there is no positive or no text to learn from, every score is the prior (0.5 if that is
unknown). Labels that contradict each other for one id are left out. Whole texts are measured.
"""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fraction_of
from .wordtable import WordTable, mixed

#: Character classes: lower case, upper case, other letters, digits, space, line feed, end of sentence, other punctuation, rest.
CLASSES = 9
#: Splits that the prior is estimated on, shares of it that the models of the bag take, decays that are tried.
SPLITS, SHARES, DECAYS = 5, (0.8, 0.9, 1.0), (1e-2, 1e-3)
DIMS = 20 + CLASSES**3


def _classes() -> np.ndarray:
    """The class of each code point up to U+FFFF; those above are rest."""
    out = np.full(1 << 16, 8, dtype=np.int64)
    for c in range(1 << 16):
        s = chr(c)
        out[c] = 0 if s.islower() else 1 if s.isupper() else 2 if s.isalpha() else 3 if s.isdigit() else 5 if c == 10 else 4 if s.isspace() else 6 if s in ".!?" else 7 if 32 < c < 127 else 8
    return out


_CLASS: list[np.ndarray] = []


def features(texts: list[str | None]) -> np.ndarray:
    """A row of DIMS numbers for each whole text."""
    if not _CLASS:
        _CLASS.append(_classes())
    table, rows = WordTable(texts), len(texts)
    kinds = _CLASS[0][np.minimum(table.points, 0xFFFF)]
    at = np.repeat(np.arange(rows), table.sizes)
    doc, long = table.doc, (table.ends - table.starts).astype(float)

    def per(of, weights=None):
        return np.bincount(of, weights, rows).astype(float)

    chars, words = per(at), np.maximum(per(doc), 1)
    dense = np.zeros((rows, 20))
    shares = np.bincount(at * CLASSES + kinds, minlength=rows * CLASSES).reshape(rows, CLASSES) / chars[:, None]
    dense[:, :9] = np.sqrt(shares)
    dense[:, 9], dense[:, 10] = np.log(chars) / 10, np.log(words) / 10
    mean = per(doc, long) / words
    dense[:, 11] = mean / 10
    dense[:, 12] = np.sqrt(np.maximum(0, per(doc, long * long) / words - mean**2)) / 10
    same = np.flatnonzero((table.hashes[1:] == table.hashes[:-1]) & (doc[1:] == doc[:-1])) if len(doc) else doc
    dense[:, 13] = per(doc[same]) / words
    kinds_of = mixed(table.hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    first = np.unique(kinds_of, return_index=True)[1]
    distinct = per(doc[first])
    dense[:, 14] = distinct / words
    dense[:, 15] = np.log(np.maximum(distinct, 1)) / np.log(words + 1)
    dense[:, 16] = per(doc[long == 1]) / words
    last = kinds[table.ends - 1] if len(doc) else doc
    dense[:, 17] = per(doc[last >= 6]) / words
    dense[:, 18] = per(doc[kinds[table.starts] == 1]) / words if len(doc) else 0
    starts, ends, of = table.lines()
    dense[:, 19] = np.log1p(per(of)) / 10
    code = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
    inside = at[:-2] == at[2:]
    grams = np.bincount(at[:-2][inside] * CLASSES**3 + code[inside], minlength=rows * CLASSES**3).reshape(rows, -1)
    return np.hstack([dense, np.sqrt(grams / chars[:, None])]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.rate, self.t = np.zeros(size), np.zeros(size), rate, 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.02, decay: float = 1e-2) -> np.ndarray:
    """Weights (the last is the intercept) of least non-negative risk with logistic loss."""
    w = np.zeros(positive.shape[1] + 1)
    adam = Adam(len(w), rate)

    def gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope.astype(np.float32) @ x, slope.sum()) / len(x)

    for _ in range(steps):
        narrow = w[:-1].astype(np.float32)
        fp, fu = positive @ narrow + w[-1], unlabelled @ narrow + w[-1]
        as_negative_p, as_negative_u = np.logaddexp(0, fp).mean(), np.logaddexp(0, fu).mean()
        negative = gradient(unlabelled, _sigmoid(fu)) - prior * gradient(positive, _sigmoid(fp))
        if as_negative_u - prior * as_negative_p >= 0:
            g = prior * gradient(positive, -_sigmoid(-fp)) + negative
        else:
            g = -negative
        g[:-1] += decay * w[:-1]
        w = w + adam.step(g)
    return w


def held_risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk, with the sigmoid as loss."""
    fp, fu = (_sigmoid(x @ w[:-1] + w[-1]) for x in (positive, unlabelled))
    return float(prior * (1 - fp).mean() + max(0.0, fu.mean() - prior * fp.mean()))


def best_decay(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Of ``DECAYS`` the one of least risk on every fifth row, learnt from the others."""
    if min(len(positive), len(unlabelled)) < 10:
        return DECAYS[0]
    apart = [(x[np.arange(len(x)) % 5 != 4], x[4::5]) for x in (positive, unlabelled)]
    (p, hp), (u, hu) = apart
    return min(DECAYS, key=lambda d: held_risk(fit_nnpu(p, u, prior, decay=d), hp, hu, prior))


def fit_bag(positive: np.ndarray, unlabelled: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """The mean weights of a model for each share of the prior, and the prior. Rows are shuffled."""
    priors = [estimate_prior(positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]) for _ in range(SPLITS)]
    prior = float(np.median(priors))
    decay = best_decay(positive, unlabelled, prior)
    return np.mean([fit_nnpu(positive, unlabelled, prior * share, decay=decay) for share in SHARES], axis=0), prior


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 1.0) -> float:
    """Best-bin estimate of the share of positives in the unlabelled rows, on rows apart from those that the first classifier learns from."""
    fit = np.concatenate([positive[0::2], unlabelled[0::2]])
    target = np.concatenate([np.ones(len(positive[0::2])), np.zeros(len(unlabelled[0::2]))])
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    w = np.zeros(fit.shape[1] + 1)
    adam = Adam(len(w), 0.02)
    for _ in range(300):
        slope = (_sigmoid(fit @ w[:-1].astype(np.float32) + w[-1]) - target) * weight
        g = np.append(slope.astype(np.float32) @ fit, slope.sum())
        g[:-1] += 1e-3 * w[:-1]
        w = w + adam.step(g)
    p, u = np.sort(positive[1::2] @ w[:-1]), np.sort(unlabelled[1::2] @ w[:-1])
    if len(p) < 5 or len(u) < 5:
        return 0.5
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 91))
    qp = 1 - np.searchsorted(p, cuts) / len(p)
    qu = 1 - np.searchsorted(u, cuts) / len(u)
    bound = (qu + margin * (np.sqrt(1 / len(u)) + np.sqrt(1 / len(p))) * (1 + qu / qp)) / qp
    best = int(np.argmin(bound))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.95))


class QualityModel:
    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.mean, self.scale, self.prior = weights, mean, scale, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        x = np.clip((features(texts) - self.mean) / self.scale, -6, 6)
        return _sigmoid(x @ self.weights[:-1] + self.weights[-1])


def sampled(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """The ``most`` rows of the least hash of the key: bounded, and the same on each run."""
    return rows.orderBy(fraction_of(F.col(key).cast("string"), F.lit(seed)), key).limit(most)


def trusted_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row an id (columns ``key``, ``y``): ids without a label, or with labels that differ, are left out."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    return rows.agg(F.min(label).alias("y"), F.max(label).alias("high")).where("y = high").select("key", "y")


def texts_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """key, y, text for ``ids`` (columns key, y; a bounded sample, so it can be broadcast). One row an id, however many rows share it: that of the least text."""
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key").groupBy("key", "y").agg(F.min("text").alias("text"))


def fit_quality_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", positives: int = 3000, unlabelled: int = 5000) -> QualityModel:
    """Learn from ids in ``labels`` with label 1, and from ``docs`` without labels."""

    def collect(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        def batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts = list(b["text"])
                for i, j in chunks(texts):
                    yield pd.DataFrame({"y": b["y"].iloc[i:j], "x": [x.astype("<f2").tobytes() for x in features(texts[i:j])]})

        schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
        got = sorted(rows.selectExpr("cast(y as int) y", "text").mapInPandas(batch, schema).collect())
        x = np.frombuffer(b"".join(r.x for r in got), dtype="<f2").reshape(len(got), DIMS).astype(np.float32)
        return x, np.array([r.y for r in got])

    good = sampled(trusted_labels(labels, key, label).where("y = 1"), "key", positives, "positive")
    web = sampled(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key")), "key", unlabelled, "unlabelled").distinct().withColumn("y", F.lit(0))
    x, y = collect(texts_of(docs, good.withColumn("y", F.lit(1)).unionByName(web), key, text))
    p, u = x[y == 1], x[y == 0]
    if not len(p) or not len(u):
        return QualityModel(np.zeros(0), np.zeros(DIMS), np.ones(DIMS), 0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-2
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (p, u))
    shuffled = np.random.default_rng(7)
    p, u = p[shuffled.permutation(len(p))], u[shuffled.permutation(len(u))]
    weights, prior = fit_bag(p, u, shuffled)
    return QualityModel(weights, mean, scale, prior)


def quality_score(df: DataFrame, model: QualityModel):
    """A function of a text column: the score, from 0 to 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = list(texts)
            yield pd.Series(np.concatenate([sent.value.score(texts[i:j]) for i, j in chunks(texts)] or [np.zeros(0)]))

    return score
