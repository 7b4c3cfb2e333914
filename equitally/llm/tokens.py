"""Token ids of whole texts by a public tokenizer file, word by word.

The ids are those of the ``tokenizers`` library.  Its word-end BPE never joins
anything across ASCII white space, so a text's ids are its words' ids in a row
and a word needs encoding once.  A word of ASCII and Latin letters that a
worker has not met runs through the same merges in ``tiktoken``'s merge loop,
which is many times faster; every other word goes to the library itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache, cached_property

import numpy as np

MARK = b"\xff"  # stands for the end of a word; never part of UTF-8
# ASCII and Latin letters that compose and lower-case one by one in any
# library; a word with anything else goes to the library itself.
PLAIN = re.compile(r"(?!.*<\|)[!-~ªµºÀ-ÖØ-öø-įı-ɏ]+")
# the pieces that the tokenizer file's split rule makes of such words
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[!-/:-@\[-`{-~]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts, with a bounded memory of words already encoded."""

    def __init__(self, path: str, remembered: int = 250_000):
        import tiktoken

        self.path = path
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        byte_of = byte_characters()

        def raw(token: str) -> bytes:
            body = token.removesuffix(end)
            return bytes(byte_of[c] for c in body) + (MARK if token != body else b"")

        ranks, ids = {}, []

        def add(token: str) -> None:
            ranks[raw(token)] = len(ids)
            ids.append(model["vocab"][token])

        single = [c for c, b in byte_of.items() if b != MARK[0]]
        for c in single:
            add(c)
        ranks[MARK] = len(ids)
        ids.append(-1)
        for c in single:  # the last byte takes the word end before any merge
            add(c + end)
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            add(a + b)
        self.ids = ids
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @cached_property
    def library(self):
        """Loaded with the first word that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if not PLAIN.fullmatch(word):
            return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        encode, ids, out = self.core.encode_single_piece, self.ids, []
        for piece in PIECES.findall(word.lower()):
            out += encode(piece.encode() + MARK)
        return array("I", [ids[t] for t in out]).tobytes()

    def __call__(self, text: bytes) -> np.ndarray:
        known = self.known
        words = text.split()  # bytes: ASCII white space only
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(known) < self.remembered and len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")


@cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)
