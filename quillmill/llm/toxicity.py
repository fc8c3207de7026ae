"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all letter triples, the products of their weights in both;
a triple at places i < j < k (k - i < SPAN) weighs DECAY^(k - i + 1), so that gaps and inserted
letters lower a match without undoing it. It is divided by a function of each string's length.
The strings are units: the letters of a word, whatever other characters stand between them, and
the letters of three or more words in a row of one letter, or of one or two, words without letters
left out. Long units are cut into overlapping windows. Units of fewer than three letters are not
scored, and no unit crosses longer words. A text scores as its highest unit; it isn't split into sentences.

Training is on units of labelled texts. Which unit makes a text toxic is not given, so the witness of each toxic text is chosen anew after each round: first by letter n-grams
that toxic texts share and others lack, then by the machine's own score. Units of texts that are
not toxic are negative; those that score too high join the training set. Landmarks are frequent
witnesses and some negatives; units that hardly any but toxic texts hold, beyond chance, are positive
throughout, since a text has one witness but may hold several insults. The features are the kernel's values at the landmarks times the
inverse root of the landmarks' own kernel matrix; the squared hinge loss is minimised in that
space. Since the decision is a weighted sum of kernel values at landmarks, it collapses to one
weight for each letter triple, and whole texts are scored by looking those up.

A table numbers the ``LETTERS`` most frequent letters of the sample; all others, of any script, share
their numbers by a hash, so that they are seen too.

The training sample has a documented bound: ``toxic`` and ``clean`` labelled texts, chosen by a
hash of the id.

Cases: null and empty texts, and those without letters, score 0. If either label is missing, all
scores are 0. Labels of one id that differ are left out. Texts are scored whole.
"""

import re
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fields
from .puquality import sampled, texts_of, trusted_labels
from .wordtable import WordTable

SPAN, DECAY, LETTERS, WINDOW, CODES = 7, 0.7, 48, 32, 0x110000
_LETTER: list[np.ndarray] = []
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(CODES)), dtype=bool, count=CODES))
    return _LETTER[0]


def letter_codes(frequent: list[str]) -> np.ndarray:
    """The number of each code point: 0 if it is no letter, its own if it is one of ``frequent``; other letters, of whatever script, share these numbers by a hash."""
    points = np.arange(CODES, dtype=np.uint64)
    code = np.where(_is_letter(), 1 + (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(LETTERS), 0).astype(np.int8)
    for i, c in enumerate(sorted(frequent), 1):
        code[ord(c)] = i
    return code


class Units:
    """The units of texts: code points of letters (``points``), the unit of each, the text of each unit."""

    def __init__(self, texts: list[str | None]):
        table = WordTable([t.lower() if t else t for t in texts])
        points = table.points
        spread = np.zeros(len(points) + 1, dtype=np.int64)
        spread[table.starts] = 1
        word = np.cumsum(spread[:-1]) - 1
        inside = np.flatnonzero(_is_letter()[points])
        letters, of = points[inside], word[inside]
        size = np.bincount(of, minlength=len(table.starts))
        doc = table.doc
        extra_points, extra_of, extra_doc = [], [], []

        def add(points_of: np.ndarray, text: int) -> None:
            extra_points.append(points_of)
            extra_of.append(np.full(len(points_of), len(size) + len(extra_doc)))
            extra_doc.append(text)

        first = np.cumsum(size) - size
        for w in np.flatnonzero(size > WINDOW):
            own = letters[first[w] : first[w] + size[w]]
            for at in range(0, len(own), WINDOW // 2):
                add(own[at : at + WINDOW], doc[w])
        keep = size[of] <= WINDOW
        lettered = np.cumsum(size > 0)  # words without letters don't end a run
        for longest in (1, 2):
            short = np.flatnonzero((size > 0) & (size <= longest))
            if len(short) < 3:
                continue
            cut = np.flatnonzero((np.diff(lettered[short]) != 1) | (np.diff(doc[short]) != 0)) + 1
            edges = np.concatenate([[0], cut, [len(short)]])
            for i in np.flatnonzero(np.diff(edges) > 2):
                run = short[edges[i] : edges[i + 1]]
                if longest == 1 or (size[run] == 2).any():
                    own = letters[first[run[0]] : first[run[-1]] + size[run[-1]]]
                    for at in range(0, len(own), WINDOW // 2):
                        add(own[at : at + WINDOW], doc[run[0]])
        self.points = np.concatenate([letters[keep], *extra_points]).astype(np.int64)
        self.unit = np.concatenate([of[keep], *extra_of]).astype(np.int64)
        self.doc = np.concatenate([doc, np.array(extra_doc, dtype=np.int64)])
        self.size = np.bincount(self.unit, minlength=len(self.doc))

    def strings(self) -> list[str]:
        whole = self.points.astype("<u4").tobytes().decode("utf-32-le", "replace")
        ends = np.cumsum(self.size)
        return [whole[e - n : e] for e, n in zip(ends.tolist(), self.size.tolist())]


def _lengths() -> np.ndarray:
    """The root of the kernel of a string of distinct letters with itself, by length."""
    out = np.ones(WINDOW + 1)
    for n in range(3, WINDOW + 1):
        out[n] = np.sqrt(sum((n - b) * DECAY ** (2 * (b + 1)) for _, b in _OFFSETS if n > b))
    return out


_NORM = _lengths()


def triples(letters: np.ndarray, unit: np.ndarray, width: int):
    """For each pair of gaps: the places where a triple of one unit starts, its number, its weight."""
    for b in range(2, SPAN):
        if len(letters) <= b:
            return
        at = np.flatnonzero(unit[:-b] == unit[b:])
        outer = letters[at] * (width * width) + letters[at + b]
        for a in range(1, b):
            yield at, outer + letters[at + a] * width, DECAY ** (b + 1)


class ToxicityModel:
    """``code`` numbers the letters (0: other); ``weights`` has one number for each triple."""

    def __init__(self, code: np.ndarray, weights: np.ndarray, bias: float, cut: float, steep: float):
        self.code, self.weights, self.bias, self.cut, self.steep = code, weights.astype(np.float32), bias, cut, steep

    def units(self, units: Units) -> np.ndarray:
        """The decision of each unit."""
        letters = self.code[units.points].astype(np.int64)
        total = np.zeros(len(letters), dtype=np.float32)
        for at, number, weight in triples(letters, units.unit, LETTERS + 1):
            total[at] += weight * self.weights[number]
        return np.bincount(units.unit, total, len(units.doc)) / _NORM[units.size] + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights) or not texts:
            return np.zeros(len(texts))
        units = Units(texts)
        best = np.full(len(texts), -np.inf)
        some = units.size > 2
        np.maximum.at(best, units.doc[some], self.units(units)[some])
        return 1.0 / (1.0 + np.exp(np.clip(-self.steep * (best - self.cut), -50, 700)))


def _kernel_rows(strings: list[str], code: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of strings and landmarks (a row of triple weights for each landmark)."""
    units = _as_units(strings)
    letters = code[units.points].astype(np.int64)
    out = np.zeros((len(strings), landmarks.shape[0]), dtype=np.float64)
    for at, number, weight in triples(letters, units.unit, LETTERS + 1):
        np.add.at(out, units.unit[at], weight * landmarks[:, number].T)
    return out / _NORM[units.size][:, None]


def _as_units(strings: list[str]) -> Units:
    """Each string as one unit."""
    out = Units.__new__(Units)
    out.size = np.array([min(len(s), WINDOW) for s in strings], dtype=np.int64)
    joined = "".join(s[:WINDOW] for s in strings)  # units have no more letters
    out.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out.unit = np.repeat(np.arange(len(strings)), out.size)
    out.doc = np.arange(len(strings))
    return out


def _expanded(strings: list[str], code: np.ndarray) -> np.ndarray:
    """The weight of each triple in each string, divided by the string's norm."""
    units = _as_units(strings)
    letters = code[units.points].astype(np.int64)
    width = (LETTERS + 1) ** 3
    out = np.zeros(len(strings) * width, dtype=np.float32)
    for at, number, weight in triples(letters, units.unit, LETTERS + 1):
        np.add.at(out, units.unit[at] * width + number, weight)
    out = out.reshape(len(strings), width) / _NORM[units.size][:, None]
    other = np.arange(width)
    out[:, (other % (LETTERS + 1) == 0) | (other // (LETTERS + 1) % (LETTERS + 1) == 0) | (other // (LETTERS + 1) ** 2 == 0)] = 0
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a ridge, by Newton steps on the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-9
    active = np.ones(len(x), dtype=bool)
    for _ in range(rounds):
        s = weight * active
        w = np.linalg.solve((x * s[:, None]).T @ x + penalty, x.T @ (s * y))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _first_witnesses(toxic: list[list[str]], clean: list[list[str]]) -> dict[str, float]:
    """A score for units that only toxic texts have, by letter n-grams."""

    def grams(u: str) -> set[str]:
        return {u[i : i + n] for n in (3, 4, 5) for i in range(len(u) - n + 1)}

    known = {u for units in clean for u in units}
    fresh = [[u for u in units if u not in known] for units in toxic]
    of = {u: grams(u) for u in {u for units in fresh for u in units}}
    high = Counter(g for units in fresh for g in set().union(*(of[u] for u in units)) if units)
    low = Counter()
    for units in clean:
        low.update(set().union(*(grams(u) for u in units)).intersection(high) if units else ())
    odds = {g: n * (np.log((n + 0.1) / (len(toxic) + 1)) - np.log((low[g] + 0.1) / (len(clean) + 1))) for g, n in high.items()}
    return {u: max((odds[g] for g in gs), default=0.0) for u, gs in of.items()}


def telling_units(toxic: list[list[str]], clean: list[list[str]]) -> Counter:
    """Units whose share of toxic texts cannot be chance: the log likelihood ratio against the share of
    all texts is above that of one among all units, with a margin of e^3. With how many toxic texts hold each."""
    high, low = (Counter(u for units in texts for u in set(units) if len(u) > 2) for texts in (toxic, clean))
    base, least = len(toxic) / (len(toxic) + len(clean)), np.log(len(high) + 1) + 3.0
    out = Counter()
    for u, n in high.items():
        other = low[u]
        share = n / (n + other)
        ratio = n * np.log(share / base) + (other * np.log((1 - share) / (1 - base)) if other else 0.0)
        if share > max(base, 0.9) and ratio > least:
            out[u] = n
    return out


def fit_from_units(toxic: list[list[str]], clean: list[list[str]], landmarks: int = 128, rounds: int = 4, seed: int = 3) -> ToxicityModel:
    """``toxic``, ``clean``: the units of each text."""
    if not toxic or not clean:
        return ToxicityModel(np.zeros(CODES, dtype=np.int8), np.zeros(0), 0.0, 0.0, 1.0)
    rng = np.random.default_rng(seed)
    frequent = Counter(c for units in (*toxic, *clean) for u in units for c in u).most_common(LETTERS)
    code = letter_codes([c for c, _ in frequent])
    negatives = sorted({u for units in clean for u in units})
    believed: dict[str, float] = _first_witnesses(toxic, clean)
    hard: set[str] = {negatives[i] for i in rng.permutation(len(negatives))[:3000]}
    model = None
    telling = telling_units(toxic, clean)
    flat = _as_units(negatives)
    toxic_units = sorted({u for units in toxic for u in units})
    flat_toxic = _as_units(toxic_units)
    for _ in range(rounds):
        witness = Counter(max(units, key=lambda u: (believed.get(u, -1e9), u)) for units in toxic if units)
        witness = Counter({u: n for u, n in witness.items() if len(u) > 2}) | telling
        if not witness:
            break
        chosen = [u for u, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))[: landmarks * 3 // 4]]
        pool = sorted(hard)
        chosen += [pool[i] for i in rng.permutation(len(pool))[: landmarks - len(chosen)]]
        expanded = _expanded(chosen, code)
        values, vectors = np.linalg.eigh(_kernel_rows(chosen, code, expanded))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        rows = [*sorted(witness), *pool]
        z = _kernel_rows(rows, code, expanded) @ root
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(pool))])
        times = np.array([min(5, witness[u]) for u in sorted(witness)], dtype=float)
        w, bias = fit_svm(z, y, np.concatenate([times / times.sum(), np.ones(len(pool)) / len(pool)]) * len(rows) / 2)
        model = ToxicityModel(code, (root @ w) @ expanded, bias, 0.0, 4.0)
        scores = model.units(flat)
        hard |= {negatives[i] for i in np.argsort(-scores)[:1500]}
        believed = dict(zip(toxic_units, model.units(flat_toxic).tolist()))
    if model is None:
        return ToxicityModel(code, np.zeros(0), 0.0, 0.0, 1.0)
    of = dict(zip(negatives, model.units(flat).tolist()))
    high = np.array([max((believed[u] for u in units if len(u) > 2), default=-9.0) for units in toxic])
    low = np.array([max((of[u] for u in units if len(u) > 2), default=-9.0) for units in clean])
    tries = np.unique(np.concatenate([high, low]))
    tries = np.concatenate([[tries[0] - 0.5], (tries[1:] + tries[:-1]) / 2, [tries[-1] + 0.5]])
    errors = np.searchsorted(np.sort(high), tries) / len(high) + 1 - np.searchsorted(np.sort(low), tries) / len(low)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    gaps = np.array([abs(np.concatenate([high, low]) - tries[i]).min() for i in best])
    model.cut = float(tries[best[int(np.argmax(gaps))]])
    return model


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic: int = 1500, clean: int = 3000) -> ToxicityModel:
    """Learn from labelled ids; labels other than 1 count as clean."""

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            rows = []
            for i, j in chunks(texts):
                u = Units(texts[i:j])
                of: list[set[str]] = [set() for _ in range(j - i)]
                for s, d in zip(u.strings(), u.doc.tolist()):
                    if len(s) > 2:
                        of[d].add(s)
                rows += ["\n".join(sorted(x)) for x in of]
            yield pd.DataFrame({"y": b["y"], "units": rows})

    known = trusted_labels(labels, key, label)
    ids = sampled(known.where("y = 1"), "key", toxic, "toxic").unionByName(sampled(known.where("y <> 1"), "key", clean, "clean"))
    got = sorted(texts_of(docs, ids.withColumn("y", F.col("y").cast("int")), key, text).select("y", "text").mapInPandas(units, fields("y int, units string")).collect())
    split = {y: [r["units"].split("\n") if r["units"] else [] for r in got if (r["y"] == 1) == y] for y in (True, False)}
    return fit_from_units(split[True], split[False])


def toxicity_score(df: DataFrame, model: ToxicityModel):
    """A function of a text column: the score, from 0 to 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = list(texts)
            yield pd.Series(np.concatenate([sent.value.score(texts[i:j]) for i, j in chunks(texts)] or [np.zeros(0)]))

    return score
