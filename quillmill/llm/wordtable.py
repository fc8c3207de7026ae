"""Words and lines of many texts at once, as numpy arrays with rolling 64-bit hashes.

The code points of a chunk of texts stand in one array. A prefix sum of mixed code points times
powers of an odd base gives the polynomial hash of any stretch as one difference, moved to the
stretch's start by the inverse power.
"""

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of ``base``, kept until longer ones are needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    return have[:n]


class WordTable:
    """``starts``, ``ends`` (code points in the chunk), ``doc`` and ``hashes`` of all words, in order."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.rows = len(texts)
        # A line feed after each text is white space and ends its last line.
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=self.rows) + 1
        self.text_ends = np.cumsum(self.sizes)
        space = (self.points == 32) | ((self.points >= 9) & (self.points <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_ends, self.starts, side="right")
        values = mixed(self.points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(self.points))
        self._prefix = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
        self.hashes = self.stretch(self.starts, self.ends)

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the code points from starts to before ends."""
        raw = (self._prefix[ends] - self._prefix[starts]) * _powers(_INVERSE, len(self.points) + 1)[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and doc of the lines between line feeds."""
        ends = np.flatnonzero(self.points == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        return starts, ends, np.searchsorted(self.text_ends, starts, side="right")


def rolled(hashes: np.ndarray, before: np.ndarray | None, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each place, from those of n - 1."""
    if before is None:
        return hashes.copy()
    return before[: max(0, len(hashes) - n + 1)] * np.uint64(_BASE) + hashes[n - 1 :]
