"""Token ids of whole texts, by a lower-casing word-end BPE vocabulary, with bounded caches.

No match of the vocabulary's split pattern holds white space or both a letter and something else but for
contractions, so a text of ASCII and Latin letters is lower-cased and parted into its matches by one pass
over its runs of non-letters. A worker keeps the ids of such pieces, and encodes all that a step lacks in
calls to the vocabulary's own model, told apart by their word-end ids. Texts with any other character, or
that may hold special tokens, are taken by white-space-parted chunks: plain ones are made of pieces, the rest
are encoded on their own by the whole tokenizer. Both caches are bounded: of pieces two generations, of which
the older goes when the younger is full, so frequent pieces stay.
"""

from __future__ import annotations

import functools
import os
import re
from itertools import chain

import numpy as np

from .common import settle

CHUNKS, PIECES = 250_000, 200_000

#: The split pattern of the vocabulary, for ASCII and Latin letters in lower case. The letters
#: end at U+017F: lower case of some that follow lies beyond their block.
_LETTERS = "a-zß-öø-ſ"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+")
#: What a plain text does not hold.
_ODD = re.compile("[^\t-\r\x20-\x7eÀ-ÖØ-öø-įı-ſ]")
#: What parts the letters of a lower-case text, with the letters that an apostrophe may take.
_MARKS = re.compile(rf"[^\s{_LETTERS}]+(?:(?<=')(?:re|ve|ll|[stmd]))?")


@functools.lru_cache(1 << 14)
def _blanks(marks: str) -> str:
    found = _PIECE.findall(marks)
    return " " + " ".join(found) + ("" if found[-1][0].isalpha() else " ")


def _parted(run: re.Match) -> str:
    """The run with blanks around its pieces; letters at its end are left open to those that follow."""
    return _blanks(run[0])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        #: The same model, for pieces that are lower-case and parted by blanks already.
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.closing = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, number in self.whole.get_vocab().items():
            self.closing[number] = token.endswith("</w>")
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pieces(self, words: set[str]) -> None:
        """Make ``pieces`` hold all of ``words``."""
        lacking = words - self.pieces.keys()
        again = lacking & self.former.keys()
        self.pieces.update((piece, self.former[piece]) for piece in again)
        fresh = list(lacking - again)
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            body = ids.tobytes()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not close every piece")
            begin = 0
            for piece, end in zip(part, (4 * ends).tolist(), strict=True):
                self.pieces[piece] = body[begin:end]
                begin = end

    def _learn(self, missing: set[bytes]) -> None:
        split = {}
        for chunk in missing:
            text = chunk.decode()
            if b"<|" not in chunk and _PLAIN.fullmatch(text):
                split[chunk] = _PIECE.findall(text.lower())
            else:
                self.chunks[chunk] = self._alone(text)
        self._learn_pieces(set(chain.from_iterable(split.values())))
        known = self.pieces.__getitem__
        for chunk, found in split.items():
            self.chunks[chunk] = b"".join(map(known, found))

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > PIECES:
            self.former, self.pieces = self.pieces, {}
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        words: list[tuple[bool, list]] = []
        for body in bodies:
            text = body.decode()
            plain = "<|" not in text and not _ODD.search(text)
            words.append((plain, _MARKS.sub(_parted, text.lower()).split() if plain else body.split()))
        self._learn_pieces(set().union(*(x for plain, x in words if plain)))
        if lacking := set().union(*(x for plain, x in words if not plain)) - self.chunks.keys():
            self._learn(lacking)
        known = self.chunks.__getitem__, self.pieces.__getitem__
        return [b"".join(map(known[plain], x)) for plain, x in words]

    def rest(self) -> None:
        """Give the caches back at a task's end: workers outlive their stage."""
        self.chunks, self.pieces, self.former = {}, {}, {}
        settle()


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(path: str | None) -> str:
    """The file to read; by default that of the installed public vocabulary package."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
