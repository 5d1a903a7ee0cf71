"""64-bit hashes of words, of runs of words and of sets, computed with numpy for many texts at once."""

from __future__ import annotations

from array import array

import numpy as np
import xxhash

#: Words remembered per task; beyond it the memory of words starts afresh.
REMEMBERED = 400_000


class _Slots(dict):
    def __init__(self) -> None:
        self.values64 = array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self.values64)
        self.values64.append(xxhash.xxh3_64_intdigest(word))
        return slot


class WordHashes:
    """Hashes of words.  Each different word is hashed once per task."""

    def __init__(self) -> None:
        self.slots = _Slots()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.slots) > REMEMBERED:
            self.slots = _Slots()
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.slots.values64, np.uint64)[at] if len(words) else np.zeros(0, np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (splitmix64)."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


#: An odd multiplier: the weight of a word's place in a run.
PLACE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of several texts in one array, and where each text ends.

    Hashes of runs are weighted sums of word hashes, taken from running totals; runs that cross
    the end of a text are computed like others and must be left out by ``starts``.
    """

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        words: list[bytes] = []
        counts = []
        for text in texts:
            own = text.split()
            words += own
            counts.append(len(own))
        self.words = words
        self.counts = np.array(counts, np.int64)
        self.stops = np.cumsum(self.counts)
        self.begins = self.stops - self.counts
        self.hashes = hashes.of(words)
        powers = np.full(len(words) + 1, PLACE)
        powers[:1] = 1
        self.totals = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(self.hashes * np.cumprod(powers)[:-1], out=self.totals[1:])
        powers[1:] = np.uint64(pow(int(PLACE), -1, 1 << 64))
        self.back = np.cumprod(powers)[:-1]

    def runs(self, length: int) -> np.ndarray:
        """The hash of the run of ``length`` words from each place (none from the last ones)."""
        n = max(0, len(self.hashes) - length + 1)
        return (self.totals[length : length + n] - self.totals[:n]) * self.back[:n]

    def whole(self, text: int) -> np.ndarray:
        """The hash of all words of a text that has words, as an array of one."""
        a, b = self.begins[text], self.stops[text]
        return (self.totals[b : b + 1] - self.totals[a : a + 1]) * self.back[a : a + 1]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stops, places, "right")


def shingle_sets(words: Words, length: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles.  Fewer words than ``length`` make one shingle."""
    runs = mix(words.runs(length))
    sets = []
    for text, (a, n) in enumerate(zip(words.begins.tolist(), words.counts.tolist())):
        if n >= length:
            found = np.sort(runs[a : a + n - length + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            sets.append(found[fresh])
        elif n:
            sets.append(mix(words.whole(text) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(values: np.ndarray) -> int:
    """One signed 64-bit number for a sorted set of hashes."""
    key = xxhash.xxh3_64_intdigest(values.tobytes())
    return key - (1 << 64) if key >> 63 else key
