"""Exact byte-level BPE ids through the tokenizers library, with a bounded memo.

The pre-tokenizer of byte-level BPE never lets a piece cross a space that is
followed by a non-space character: such a space opens the next piece. So a text
may be cut before every such space and the chunks encoded alone. Words repeat,
and a distinct one goes through the library once per worker while the memo holds it
(a full one is kept beside the next until that is full too). A chunk of Latin letters,
ASCII symbols but no apostrophe, and single line ends goes piece by piece to the BPE
model alone. A text with any other space (doubled, trailing, before a line end) is
encoded whole.
"""

from __future__ import annotations

import os
import re
import struct

from mvmap.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SYMBOLS = r"!-&(-/:-@\[-`{-~"
#: Chunks whose pieces are known without the library: a word and its marks; runs of letters, of symbols, and line ends before one of these.
_WORD = re.compile(f"([{_LETTERS}]+)([{_SYMBOLS}]*)")
_PLAIN = re.compile(f"[{_LETTERS}{_SYMBOLS}](?:[{_LETTERS}{_SYMBOLS}]|\n(?=[{_LETTERS}{_SYMBOLS}]))*")
_PIECES = re.compile(f"[{_LETTERS}]+|[{_SYMBOLS}]+|\n")
#: Pieces inside chunks that are kept; longer chunks are not.
_INNER, _KEPT_CHARS = 50_000, 64
_ENCODERS: dict[tuple[str, int], "TextEncoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Chunk without its leading space -> ids as little-endian uint32 bytes, or
    None if the cut before it is not safe."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.limit = tokenizer, limit
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()
        self.older: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """One piece of the pre-tokenizer, so the BPE model alone decides."""
        ids = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def first(self, piece: str) -> bytes:
        """A chunk's first piece, with the space before it."""
        out = self.get(piece) or self.older.get(piece)
        if out is None and piece.isascii():
            # Printable ASCII stands for itself, this letter for the space.
            ids = [t.id for t in self.tokenize("\u0120" + piece)]
            return struct.pack(f"<{len(ids)}I", *ids)
        return out or self.piece(" " + piece)

    def later(self, piece: str) -> bytes:
        out = self.inner.get(piece)
        if out is None:
            if len(self.inner) >= _INNER:
                self.inner.clear()
            out = self.inner[piece] = self.piece(piece)
        return out

    def fresh(self, chunk: str) -> bytes:
        word = _WORD.fullmatch(chunk)
        if word:
            core, tail = word.groups()
            return self.first(core) + self.later(tail) if tail else self.first(core)
        if _PLAIN.fullmatch(chunk):
            head, *rest = _PIECES.findall(chunk)
            return self.first(head) + b"".join(map(self.later, rest))
        return self.plain(" " + chunk)

    def __missing__(self, chunk: str) -> bytes | None:
        if not chunk or chunk[0].isspace():
            return None
        if len(chunk) > _KEPT_CHARS:
            return self.fresh(chunk)
        out = self.older.get(chunk) or self.fresh(chunk)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out


class TextEncoder:
    """encode(text) -> ids as little-endian uint32 bytes, equal to those of
    ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo(self.tokenizer, limit)
        self.get = self.memo.__getitem__
        probes = ("a b's  c\n d, e-f 12 G!! été zq", "ab cd ef.", "ab c.\nde $f*\n|É \"gh_i\" (j)")
        self.cut = all(self._cut(x) == self.memo.plain(x) for x in probes)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]

    def _cut(self, text: str) -> bytes | None:
        head, *rest = text.split(" ")
        try:
            return (self.memo.plain(head) if head else b"") + b"".join(map(self.get, rest))
        except TypeError:
            return self.memo.plain(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cut or any(s in text for s in self.special):
            return self.memo.plain(text)
        return self._cut(text)


def encoder(path: str, limit: int = 500_000) -> TextEncoder:
    """One encoder per Python worker, kept between tasks until the worker rests."""
    key = (path, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, limit)
    return _ENCODERS[key]


common.at_rest(_ENCODERS.clear)
