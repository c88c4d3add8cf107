"""Public tokenizers with a memo of the units that their pre-tokenizers never join.

Both vocabularies cut a text at white space before they merge anything, so a word (a run without space or line feed, for
the byte-level one with the single space before it) has the same ids alone as inside its text. The memo maps a word to
its ids; what it lacks goes to the tokenizer. Letters alone go to its merge model at once. Texts with other white space or with scripts whose characters combine go
to the tokenizer whole, and so do runs of white space for the byte-level one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Words kept by a worker; the memo starts again beyond that, which bounds its memory to about 250 MB.
MEMO_UNITS = 1_200_000
#: Code points of a text that one step handles.
STEP = 1 << 20

_OUTSIDE = re.compile("[^\n -~\xa1-\xac\xae-ɏ‐-‧‰-⁞₠-₿Ͱ-ͳЀ-҂Ҋ-ԯ]")
_CONTROLS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RUNS = ("  ", " \n", "\n ", "\n\n")
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s'<]*)\Z")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as its own character if that prints, the others as the characters from 256 on.
_AS_CHARACTER = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_loaded: dict[str, "Memo"] = {}


class Memo(dict):
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = self.tokenizer.encode("a b", add_special_tokens=False).ids != [
            *self.tokenizer.encode("a", add_special_tokens=False).ids, *self.tokenizer.encode("b", add_special_tokens=False).ids]
        self.model = self.tokenizer.model
        self.lead = " " if self.spaced else ""
        self.newline = self.plain("\n")
        self.marks: dict[str, bytes] = {"": b""}
        self.room = MEMO_UNITS

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, letters: str) -> bytes:
        """Letters alone, with the space before them, are one piece for the pre-tokenizer."""
        piece = (letters if self.spaced else letters.lower()).encode().decode("latin-1").translate(_AS_CHARACTER)
        return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(marks) > 8 or len(self.marks) > 10_000:
                return self.plain(marks)
            self.marks[marks] = self.plain(marks)
        return self.marks[marks]

    def __missing__(self, key: str) -> bytes:
        """Ids of a word with the space before it, or of a line feed and the word after it."""
        lead, before, word = self.lead, b"", key
        if lead and key[0] == "\n":
            lead, before, word = "", self.newline, key[1:]
        if not (m := _WORD.match(word)):
            ids = before + self.plain(lead + word)
        elif m[2] and lead:
            ids = self[m[1]] + self._marks(m[2])
        else:
            ids = before + self._piece(lead + m[1]) + self._marks(m[2])
        if self.room <= 0:
            self.clear()
            self.room = MEMO_UNITS
        self.room -= 1
        self[key] = ids
        return ids

    def _step(self, text: str) -> bytes:
        if any(c in text for c in _CONTROLS) if text.isascii() else _OUTSIDE.search(text):
            return self.plain(text)
        if not self.spaced:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if any(r in text for r in _RUNS) or text[:1] in ("", " ", "\n") or text[-1] in " \n":
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))

    def steps(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, a bounded part of the text at a time."""
        at = 0
        while len(text) - at > 2 * STEP:
            cut = _CUT.search(text, at + STEP)
            if not cut:
                break
            yield self._step(text[at : cut.start()])
            at = cut.start()  # the byte-level vocabulary takes the space with the word after it
        yield self._step(text[at:] if at else text)

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.steps(text or ""))


def memo(path: str) -> Memo:
    """The worker's own memo of a vocabulary file; kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Memo(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
