"""Token ids of whole texts, word by word through a public tokenizer.

Both vocabularies cut texts into words before merging, so a text's ids are the ids of its words in order. Texts repeat
their words: a bounded table holds words already encoded, in two generations, so that words which still occur stay and
others make room. A word of letters goes straight to the merges of the library, which is several times cheaper than
its whole chain of steps; other words go through all of it. The ids are those of encoding the text as a whole,
which the tests check.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import Struct

import numpy as np

TABLE_WORDS = 600_000  # words kept by a Python worker, some 180 bytes each
SPACED_WORDS = 1_800_000  # of the vocabulary that tells case and line ends apart
CONTROLS = re.compile("[\x1c-\x1f]")  # what only Python takes for white space
MARKS = ".,;:!?"
TAIL_RUNS = 20_000  # runs of punctuation kept
# ASCII punctuation but the apostrophe, which belongs to the letters after it in some vocabularies.
TAIL = r"[!-&(-/:-@\[-`{-~]+"
# Letters that are one character in every normal form, and whose lower case is one letter.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")
WORD_AND_TAIL = re.compile(f"({LETTERS.pattern})({TAIL})")
# Fixed rule of byte-level vocabularies: bytes without a printable Latin-1 character are named from U+0100 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_NAMES = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in PRINTABLE)}
BLANK = chr(BYTE_NAMES[0x20])
PACKERS = [Struct(f"<{n}I").pack for n in range(64)]


class Words(dict):
    """Ids by word, encoded when first met. A full table becomes the old one, and words found there move back.

    A mark after a letter is a piece of its own: such a word is put together each time and takes no room.
    """

    def __init__(self, encode: Callable[[str], bytes], room: int, marks: dict[str, bytes] | None = None):
        super().__init__()
        self.encode, self.half, self.old, self.marks = encode, max(1, room // 2), {}, marks or {}

    def __missing__(self, word: str) -> bytes:
        mark = self.marks.get(word[-1:])
        if mark is not None and word[-2:-1].isalpha():
            return self[word[:-1]] + mark
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    spaced=False: white space only separates words, and case is folded (word_bpe). spaced=True: a blank belongs to the
    word after it (byte_bpe). Texts in which more than a single blank or line end stands between words are encoded as
    a whole, and names of special tokens are ordinary text.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path if "/" in path else tokenizer_path(path))
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.spaced = spaced
        self.tails = Words(self.whole, TAIL_RUNS)
        self.newline = self.whole("\n") if spaced else b""
        marks = {mark: self.whole(mark) for mark in MARKS}
        self.table = Words(*((self._spaced_word, SPACED_WORDS) if spaced else (self._word, TABLE_WORDS)), marks)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        one = self._spaced_text if self.spaced else self._text
        return (one(text or "") for text in texts)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _text(self, text: str) -> bytes:
        if CONTROLS.search(text):
            return self.whole(text)
        # Only A-Z here: the library folds the case of all other characters by itself.
        return b"".join(map(self.table.__getitem__, text.encode().lower().decode().split()))

    def _spaced_text(self, text: str) -> bytes:
        # A piece of the pre-tokenizer never goes on from a character into white space, so a text can be cut before each
        # blank or line end that stands alone. Of all white space only the blank is printable.
        cut = text.replace("\n", " \n")
        alone = cut and cut[0] != " " and cut[-1] not in " \n" and "  " not in cut and " \n " not in cut
        if not alone or not cut.replace("\n", "").isprintable():
            return self.whole(text)
        first, *rest = cut.split(" ")
        # The first word has no blank before it, like one at the beginning of a line.
        return self.table["\n" + first][len(self.newline) :] + b"".join(map(self.table.__getitem__, rest))

    def _letters(self, letters: str, blank: bool = False) -> bytes:
        """Ids of letters, after a blank or not: a single piece to the pre-tokenizer, which names its bytes."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_NAMES)
        ids = [token.id for token in self.merge(BLANK + letters if blank else letters)]
        return PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else np.array(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if LETTERS.fullmatch(word):
            return self._letters(word.lower())
        parts = WORD_AND_TAIL.fullmatch(word)  # the pre-tokenizer cuts between letters and punctuation
        return self.table[parts[1]] + self.tails[parts[2]] if parts else self.whole(word)

    def _spaced_word(self, word: str) -> bytes:
        """A word with the blank before it; a line end before a word takes the place of the blank."""
        if LETTERS.fullmatch(word):
            return self._letters(word, blank=True)
        line = word[:1] == "\n"
        bare = word[1:] if line else word
        if line and LETTERS.fullmatch(bare):
            return self.newline + self._letters(bare)
        parts = WORD_AND_TAIL.fullmatch(bare)
        if parts:
            return self.table["\n" + parts[1] if line else parts[1]] + self.tails[parts[2]]
        return self.newline + (self.whole(bare) if bare else b"") if line else self.whole(" " + word)


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this Python worker: its table serves all tasks that the worker runs.

    A bare name is that of a public tokenizer, whose place is looked up here, on the worker's own machine.
    """
    return Encoder(path, spaced)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
