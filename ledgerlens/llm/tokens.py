"""Token ids of words, remembered for the life of a Python worker."""

from __future__ import annotations

import re
import string
import sys
from array import array

from tokenizers import Tokenizer

#: Entries remembered at most, unless the caller says otherwise; beyond that a memo starts
#: anew, so memory stays bounded.
MEMO_WORDS = 250_000
#: Longer words are encoded each time and not remembered.
MEMO_BYTES = 64

#: Letters whose normal form, lower case and class are the same in every Unicode version,
#: and punctuation: such a word is one piece of letters and one of punctuation.
_PLAIN = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(string.punctuation)}]*)")
_PUNCTUATION = string.punctuation.encode()


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of a piece (bytes) that the tokenizer's model gets as it is."""

    def __init__(self, tokenizer: Tokenizer, limit: int):
        self.model, self.letters, self.limit = tokenizer.model, _byte_letters(), limit

    def __missing__(self, piece: bytes) -> bytes:
        shown = piece.decode() if piece.isascii() else "".join(map(self.letters.get, piece))
        ids = pack([t.id for t in self.model.tokenize(shown)])
        if len(self) >= self.limit:
            self.clear()
        self[piece] = ids
        return ids


def pack(ids) -> bytes:
    out = array("I", ids)  # four bytes each
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """Maps a word (bytes without ASCII white space) to its ids, 32 bits each.

    Right for tokenizers whose tokens never span white space, as the one of the queries;
    :func:`check_word_tokenizer` refuses others.
    """

    def __init__(self, path: str, limit: int):
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        check_word_tokenizer(self.tokenizer)
        self.pieces = _Pieces(self.tokenizer, limit)

    def encode(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > MEMO_BYTES:
            return self.encode(word.decode())
        letters = word.rstrip(_PUNCTUATION)
        if letters.isalpha():  # of bytes: ASCII letters
            ids, rest = self.pieces[letters.lower()], word[len(letters) :]
        elif not word.isascii() and (plain := _PLAIN.fullmatch(word.decode())):
            ids, rest = self.pieces[plain[1].lower().encode()], plain[2].encode()
        else:
            ids, rest = self.encode(word.decode()), b""
        if rest:
            ids += self.pieces[rest]
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids


def check_word_tokenizer(tokenizer: Tokenizer) -> None:
    probe = ["The", "don't,", "x<|endoftext|>y", "42nd", "Élan...", "a b"]
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    whole = ids(" \n".join(probe))
    if whole != [i for word in probe for i in ids(word)]:
        raise ValueError("the tokenizer's tokens depend on white space; words can't be encoded alone")


_loaded: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, limit: int = MEMO_WORDS) -> WordIds:
    """The worker's memo for a vocabulary file."""
    if (path, limit) not in _loaded:
        _loaded[path, limit] = WordIds(path, limit)
    return _loaded[path, limit]
