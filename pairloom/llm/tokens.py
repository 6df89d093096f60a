"""Tokenizing by distinct pre-token: a tokenizer's model sees each pre-token once a task, texts are sums of those.

Both tokenizers split a text into pre-tokens by a pattern and then work on each pre-token alone, so what they give for a
text is the sequence of what they give for its pre-tokens. In texts of common scripts (whose characters' classes, case and normal form
are settled and alike in all libraries) the pattern is applied here; all other texts are normalised and split by the
library's own pre-tokenizer, whatever their script, which takes about three times as long. The strings of special tokens part a text and stand for
themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

#: Letters, digits and white space among the characters of PLAIN texts: Latin, Cyrillic, kana, Han, Hangul.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ʯⱥⱦЀ-ҁҊ-ԯ\u3041-\u3096\u30a1-\u30fa\u30fc-\u30fe\u4e00-\u9fa5\uac00-\ud7a3"
DIGIT, SPACE = "0-9²³¹¼-¾", "\t\n\r "
#: Signs among them: general, East Asian and wide punctuation, currency, pictures.
SIGN = "\u2010-\u2027\u2030-\u203e\u20ac\u2122\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20\U0001f300-\U0001f64f"
#: The pre-tokenizers' patterns of the two public vocabularies, for PLAIN texts.
BYTE_LEVEL = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_LEVEL = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+"
#: Characters for which these patterns and Python's lower() are known to agree with the libraries.
PLAIN = re.compile(f"[\t\n\r\x20-\x7e\xa1-įı-ʯ{LETTER}{SIGN}]*")
#: Distinct pre-tokens in each of the two generations that a task remembers.
REMEMBERED = 400_000
#: What byte-level tokenizers write for a byte: printable Latin-1 characters stand for themselves, others for 256 and on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: b for b in SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of a file, loaded once a process."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Pieces(dict):
    """What ``make`` gives for a pre-token, remembered: the older half is forgotten when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Texts:
    """A tokenizer whose model sees each pre-token by itself. ``make`` says what is kept of a pre-token's tokens."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = library(path)
        self.model, self.normalizer, self.pre_tokenizer = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.split = re.compile(pattern).findall
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.pieces = Pieces(lambda piece: self.make(self.model.tokenize(piece.encode().decode("latin-1").translate(ALPHABET))))
        self.shown = Pieces(lambda piece: self.make(self.model.tokenize(piece)))

    def shown_pieces(self, text: str) -> list[str]:
        """The pre-tokens of any text as the library splits it, in the alphabet of its model."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(text)]


class Counts(Texts):
    """Numbers of tokens of texts, without their ids."""

    def __init__(self, path: str, pattern: str = BYTE_LEVEL):
        super().__init__(path, pattern)

    make = staticmethod(len)

    def count(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            known, pieces = self.pieces, self.split(text)
        else:
            known, pieces = self.shown, self.shown_pieces(text)
        return sum([n * known[piece] for piece, n in Counter(pieces).items()])

    def __call__(self, text: str) -> int:
        if not any(s in text for s in self.special):
            return self.count(text)
        return sum([1 if part in self.special else self.count(part) for part in self.parts(text)])


class Ids(Texts):
    """Token ids of texts, as little-endian unsigned 16-bit numbers (vocabularies of at most 65,536 ids)."""

    def __init__(self, path: str, pattern: str = WORD_LEVEL, lower: bool = True):
        super().__init__(path, pattern)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.lower = lower

    @staticmethod
    def make(found: list) -> bytes:
        return b"".join([t.id.to_bytes(2, "little") for t in found])

    def ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            known, pieces = self.pieces, self.split(text.lower() if self.lower else text)
        else:
            known, pieces = self.shown, self.shown_pieces(text)
        return b"".join([known[piece] for piece in pieces])

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            return self.ids(text)
        return b"".join([self.special[part].to_bytes(2, "little") if part in self.special else self.ids(part) for part in self.parts(text)])
