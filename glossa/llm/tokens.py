"""Token ids of whole texts by the public tokenizer files.

Most words of a corpus repeat, so texts are cut where the tokenizer itself
always cuts, and a piece is encoded only when it is not among the recent
ones of the worker (two generations of at most ``CACHE_PIECES`` entries:
when the young one is full it becomes the old one, and pieces found in the
old one move back).  Closing ASCII punctuation after a letter is a token
boundary too and is cached apart; what remains of most pieces is one run of
letters, which goes to the tokenizer's model directly.  Cuts:

* ``space``: before a single space between two non-space characters; the
  byte-level pattern always starts a new token there, and the space belongs
  to the token that follows.  A piece of words joined by single line ends is
  cut at these: a line end between a word and a letter is a token by itself;
* ``word``: at ASCII white space, which the word tokenizer drops; it folds
  case, so A-Z is folded before the cache is asked (not in texts that hold
  ``<|``, where a special token's own spelling counts), and Latin letters
  before the model is.  Letters of other scripts, which its normaliser might
  compose or fold in ways of its own, go to the whole tokenizer.

``tests/llm/test_tokens.py`` holds both against whole-text encoding.
"""

from __future__ import annotations

import os
import re
from array import array

CACHE_PIECES = 400_000
REST_PIECES = 150_000       # kept by a worker between tasks
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_CLOSING = ".,;:!?"
_LATIN_END = "\u0250"        # letters below are composed already; one folds to two:
_DOTTED_I = "\u0130"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file: folder ``GLOSSA_TOKENIZERS`` or the
    installed package."""
    folder = os.environ.get("GLOSSA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each
    byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return table


class _Unclean(Exception):
    """A piece that is empty or begins or ends with white space."""


class _Pieces(dict):
    """Ids of pieces; learns a missing one when it is asked for."""

    def __init__(self, encoder: "PieceEncoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece) -> bytes:
        ids = self[piece] = self.encoder.learn(piece)
        return ids


class PieceEncoder:
    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if cut not in ("space", "word"):
            raise ValueError(cut)
        self.tok, self.cut = Tokenizer.from_file(path), cut
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.young, self.old = _Pieces(self), {}    # keys: str for "space", bytes for "word"
        self.closing: dict = {}
        self.line_end = self._encode("\n")

    def largest_id(self) -> int:
        return max(self.tok.get_vocab(with_added_tokens=True).values())

    def _encode(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _close(self, tail: str) -> bytes:
        if tail not in self.closing:
            if len(self.closing) > 10_000:
                self.closing = {}
            self.closing[tail] = self._encode(tail)
        return self.closing[tail]

    def _letters_of(self, core: str) -> str:
        return core if core.isascii() else core.encode("utf-8").decode("latin-1").translate(self.letters)

    def _lines(self, piece: str) -> bytes | None:
        """Ids of words that single line ends join, word by word; None for
        any other piece."""
        first, *more = piece.split("\n")
        if not more or not all(p.rstrip(_CLOSING).isalpha() for p in (first, *more)):
            return None
        known = self.young.__getitem__
        return self.line_end.join([known(first), *[known(" " + p) for p in more]])

    def _folded(self, core: str) -> str | None:
        """A run of Latin letters as the word tokenizer's model gets it."""
        if core.isascii():
            return core if core.isalpha() and core.islower() else None
        if not core.isalpha() or max(core) >= _LATIN_END or _DOTTED_I in core:
            return None
        return self._letters_of(core.lower())

    def learn(self, piece) -> bytes:
        """Ids of a piece.  With ``space`` cuts a piece follows a space; a
        word that follows none has the key of a space and the word, which no
        piece is."""
        ids = self.old.get(piece)
        if ids is not None:
            return ids
        if self.cut == "space":
            bare = piece[:1] == " "
            if bare:
                piece = piece[1:]
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Unclean
            core = piece.rstrip(_CLOSING)
            if not core.isalpha():
                ids = self._lines(piece) if not bare else None
                return self._encode(piece if bare else " " + piece) if ids is None else ids
            word = self._letters_of(core) if bare else "Ġ" + self._letters_of(core)
        else:
            piece = piece.decode("utf-8")
            core = piece.rstrip(_CLOSING)
            word = self._folded(core)
            if word is None:
                return self._encode(piece)
        ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids + self._close(piece[len(core):]) if len(core) < len(piece) else ids

    def rest(self) -> None:
        """Keep only the recent pieces: an idle worker holds little."""
        self.young, self.old = _Pieces(self), dict(self.young) if len(self.young) <= REST_PIECES else {}

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers; None is empty."""
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = _Pieces(self), dict(self.young)
        known = self.young.__getitem__
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.cut == "word":
                raw = text.encode("utf-8")
                out.append(b"".join(map(known, (raw if b"<|" in raw else raw.lower()).split())))
            else:
                head, *parts = text.split(" ")
                try:
                    if parts and (not head or head[-1].isspace()):
                        raise _Unclean
                    rest = b"".join(map(known, parts))
                except _Unclean:
                    head, *parts = _SINGLE.split(text)
                    rest = b"".join([self._encode(" " + p) if p[-1].isspace() else known(p) for p in parts])
                first = known(" " + head) if head.rstrip(_CLOSING).isalpha() else self._encode(head)
                out.append(first + rest)
        return out


_ENCODERS: dict = {}


def encoder(path: str, cut: str) -> PieceEncoder:
    """One encoder per Python worker, file and cut."""
    key = (path, cut)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, cut)
    return _ENCODERS[key]
