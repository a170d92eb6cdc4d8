"""Word hashing shared by the models and joins over text."""

from __future__ import annotations

from mvmap.llm import common

#: Bytes that are not ASCII letters or digits become spaces; others stay.
_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: As above, line ends stay.
PLAIN_LINES = _PLAIN[:10] + b"\n" + _PLAIN[11:]


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.lower().encode().translate(_PLAIN).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


class WordHasher(dict):
    """word -> 64-bit hash, with a memo that restarts when full."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        import xxhash

        self.limit, self.digest = limit, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def array(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_HASHERS: list[WordHasher] = []
common.at_rest(_HASHERS.clear)


def hasher() -> WordHasher:
    """One per Python worker, until it rests."""
    if not _HASHERS:
        _HASHERS.append(WordHasher())
    return _HASHERS[0]


def mix(x):
    """Spread the bits of a uint64 array (a murmur-style finaliser)."""
    import numpy as np

    out = x >> np.uint64(33)
    out ^= x
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out *= np.uint64(factor)
        out ^= out >> np.uint64(33)
    return out


def grams(h, offsets: tuple[int, ...]):
    """Hashes of the word tuples at the given offsets, one per place."""
    import numpy as np

    n = len(h) - offsets[-1]
    if n <= 0:
        return h[:0]
    out = np.full(n, offsets[-1] + 1, dtype=np.uint64)
    for k, o in enumerate(offsets):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[o:o + n] + np.uint64(k))
    return out
