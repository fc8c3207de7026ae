"""Byte pair encoding with forced boundaries.

A merge can only build a token of the vocabulary. Two neighbouring byte symbols that no token
holds side by side are therefore never merged, and the place between them is a certain cut.
A word is split at its certain cuts, each fragment is merged on its own (and kept in a bounded
cache), and the ids are concatenated; the result equals that of merging the whole word.

Cases: null text is the empty text and has no tokens. Ids that the vocabulary lacks are an
error in ``decode``, as they are no output of ``encode``. Texts are never cut short, and a word of any
length takes n log n steps. Files with a decoder, dropout, byte fallback, a prefix of inner pieces or
``ignore_merges`` are refused.
"""

import hashlib
import heapq
import json
import re
from typing import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Entries after which a worker's caches of words and of fragments start anew.
CACHE_WORDS, CACHE_FRAGMENTS = 100_000, 50_000
#: Longest word or fragment that is kept there, so that entries bound the memory.
LONG = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of byte-level BPE: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class BoundaryBPE:
    """Encoder for a ``tokenizers`` file of kind BPE with word ends (``end_of_word_suffix``),
    NFC and lower-casing normaliser and a split pattern whose matches are the words."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        unknown = [k for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "ignore_merges") if model.get(k)] + [k for k in ("decoder",) if spec.get(k)]
        if unknown or model.get("type", "BPE") != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError(f"not a vocabulary file of this kind: {', '.join(unknown) or model.get('type')}")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.end] for c in letters]
        self.together = self._pairs_inside_tokens({c: b for b, c in enumerate(letters)})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.normalizer = Tokenizer.from_str(file.decode()).normalizer
        self.wide = pre_tokenizers.Split(Regex(split), "removed", invert=True)
        # Up to U+017F all is composed and long assigned, so that a plain pattern cuts as the library does.
        narrow = {p: "".join(re.escape(chr(c)) for c in range(0x180) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}")}
        self.narrow = re.compile(split.replace(r"\p{L}", narrow[r"\p{L}"]).replace(r"\p{N}", narrow[r"\p{N}"]).replace(r"\s", narrow[r"\p{White_Space}"]))
        self.beyond = re.compile("[^\x00-\u017f]")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most_words, self.most_fragments = CACHE_WORDS, CACHE_FRAGMENTS
        self.words: dict[str, tuple[bytes, str, int]] = {}
        self.fragments: dict[tuple[int, ...], list[int]] = {}

    def _pairs_inside_tokens(self, byte_of: dict[str, int]) -> np.ndarray:
        """True at [a, b] if some token holds byte a before byte b; b + 256 ends a word."""
        together = np.zeros((256, 512), dtype=bool)
        for token in self.vocab:
            ends = token.endswith(self.end) and token != self.end
            symbols = [byte_of[c] for c in (token[: -len(self.end)] if ends else token)]
            if ends:
                symbols[-1] += 256
            together[symbols[:-1], symbols[1:]] = True
        return together

    def _merged(self, ids: tuple[int, ...]) -> list[int]:
        """Merge one fragment: always the pair of the lowest rank, the leftmost first. Pairs wait in a
        heap and symbols are a linked list, so a fragment of n symbols takes n log n steps."""
        out, merges = list(ids), self.merges
        n = len(out)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(merges[p][0], i, p) for i, p in enumerate(zip(out, out[1:])) if p in merges]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= n or (out[i], out[j]) != pair:  # one of the two has merged meanwhile
                continue
            out[i], out[j] = merges[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := merges.get((out[i], out[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, (out[i], out[k])))
            if (h := before[i]) >= 0 and (found := merges.get((out[h], out[i]))) is not None:
                heapq.heappush(queue, (found[0], h, (out[h], out[i])))
        return [x for x in out if x >= 0]

    def _word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        last = len(data) - 1
        ids, start = [], 0
        symbols = [*data[:-1], data[-1] + 256]
        for i in range(1, len(symbols) + 1):
            if i > last or not self.together[symbols[i - 1], symbols[i]]:
                fragment = tuple(self.inner[s] if s < 256 else self.final[s - 256] for s in symbols[start:i])
                found = self.fragments.get(fragment)
                if found is None:
                    found = self._merged(fragment)
                    if len(fragment) <= LONG:
                        if len(self.fragments) > self.most_fragments:
                            self.fragments.clear()
                        self.fragments[fragment] = found
                ids += found
                start = i
        return ids

    def _cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not self.beyond.search(text):
            return self.narrow.findall(text.lower())
        return [w for w, _ in self.wide.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def pieces(self, text: str | None) -> tuple[list[bytes], list[str], int]:
        """Of each word: the ids as little-endian 32-bit integers, the tokens joined by a space; and the number of ids."""
        if not text:
            return [], [], 0
        if self.marks is not None and any(s in text for s in self.special):
            words = []
            for part in self.marks.split(text):
                words += [part] if part in self.special else self._cut(part)
        else:
            words = self._cut(text)
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.most_words:
                known.clear()
                new = set(words)
            for w in new:
                ids = [self.special[w]] if w in self.special else self._word(w)
                known[w] = (np.array(ids, dtype="<u4").tobytes(), " ".join(map(self.tokens.__getitem__, ids)), len(ids))
        got = list(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONG:
                del known[w]
        return [g[0] for g in got], [g[1] for g in got], sum(g[2] for g in got)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.pieces(text)[0]), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens joined by a space, as for a file without a decoder; special tokens stay."""
        return " ".join([self.tokens[int(i)] for i in ids])


_LOADED: dict[bytes, BoundaryBPE] = {}


def _loaded(file: bytes, words: int = CACHE_WORDS, fragments: int = CACHE_FRAGMENTS) -> BoundaryBPE:
    key = hashlib.sha256(file).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BoundaryBPE(file)
    _LOADED[key].most_words, _LOADED[key].most_fragments = words, fragments
    return _LOADED[key]


def _sent(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and broadcast (a few MB, fixed by the vocabulary)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(spark: SparkSession, path: str):
    """A function of a text column: its ids as array<int>."""
    file = _sent(spark, path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(file.value)
        for texts in batches:
            yield pd.Series([np.frombuffer(b"".join(bpe.pieces(t)[0]), dtype="<i4") for t in texts])

    return encode


def bpe_decode(spark: SparkSession, path: str):
    """A function of a column of ids: the text. Null ids are no ids."""
    file = _sent(spark, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(file.value)
        for rows in batches:
            yield pd.Series([bpe.decode(() if r is None else r) for r in rows])

    return decode


def bpe_round_trip(spark: SparkSession, path: str):
    """A function of a text column: struct of the ids, their number and the text decoded from them, in one pass of one worker."""
    file = _sent(spark, path)

    @F.pandas_udf("ids array<int>, n_tokens long, decoded string")
    def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(file.value)
        for texts in batches:
            got = [np.frombuffer(b"".join(bpe.pieces(t)[0]), dtype="<i4") for t in texts]
            yield pd.DataFrame({"ids": pd.Series(got, dtype=object), "n_tokens": np.array([len(g) for g in got], dtype=np.int64), "decoded": [bpe.decode(g.tolist()) for g in got]})

    return round_trip


def bpe_digests(spark: SparkSession, path: str):
    """A function of a text column: number of ids, hash of the ids, hash of the text decoded
    from the ids. One pass, in which neither ids nor decoded text leave the worker."""
    file = _sent(spark, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(file.value, 4 * CACHE_WORDS, 4 * CACHE_FRAGMENTS)  # digests need little memory besides
        for texts in batches:
            rows = []
            for t in texts:
                ids, tokens, n = bpe.pieces(t)
                rows.append((n, hashlib.sha256(b"".join(ids)).hexdigest(), hashlib.sha256(" ".join(tokens).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests
