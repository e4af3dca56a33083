"""The tokenizers library behind a memo of words, shared by the id writer and the token counts.

A vocabulary whose pieces never hold white space (see `spaced`) gives a text the ids of its words one
after another, so that each distinct word goes to the library once for each Python worker. Any other
vocabulary gets whole texts.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
from tokenizers import Tokenizer

#: Words that a worker remembers; beyond it those that came up again stay. Longer words are never remembered.
MEMO_WORDS, MEMO_CHARS = 1_000_000, 64
#: Marks that may end a word of Latin letters, and the first letter beyond those.
ENDS, LATIN = ",.;:!?", "\u0250"
#: Normalisers that treat a text as they treat its words, and the alternatives of a piece,
#: as they are for lower-case ASCII and in full; what added tokens must begin with, as words without it skip the search for them.
BY_WORD = {"NFC", "Lowercase"}
ADDED = "<|"
PIECES_ASCII = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "[a-z]+", "[0-9]", "[^ a-z0-9]+"]
PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]


def spaced(spec: dict) -> bool:
    """Whether a text's ids are those of its words between blanks."""
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    pre = spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm])
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if not all(s["type"] in BY_WORD or s == blanks for s in steps):
        return False
    first, *rest = pre.get("pretokenizers", [pre])
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(s.get("type") != "ByteLevel" or s.get("add_prefix_space") or s.get("use_regex") for s in rest):
        return False
    if any(not t["content"].startswith(ADDED) or re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        return False
    if not any(s["type"] == "Lowercase" for s in steps):
        return False
    return first["pattern"].get("Regex") == "|".join(PIECES)


class Memo(dict):
    """Ids of words as bytes; a word that isn't held is encoded. Pieces of ASCII words go to the library's model."""

    def __init__(self, library: Tokenizer, held: dict | tuple = ()):
        super().__init__(held)
        self.library, self.one = library, library.model.tokenize
        self.pieces = re.compile("|".join(PIECES_ASCII)).findall

    def __missing__(self, word: str) -> bytes:
        parts = ()
        if word.isascii() and word.isprintable() and ADDED not in word:
            parts = self.pieces(word.lower())
            ids = [t.id for t in self.one(parts[0])] if len(parts) == 1 else []
        elif word[-1] in ENDS and word[-2:-1].lower().isalpha() and word[-2] < LATIN and ADDED not in word:
            parts = (word[:-1], word[-1])  # a letter (in lower case too: that of U+0130 ends in a combining dot) and a mark are never in one piece
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        if len(parts) > 1:
            told = b"".join([self[p] for p in parts])
        else:
            told = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_CHARS:
            self[word] = told
        return told


class WordEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_word = spaced(json.loads(spec))
        self.memo = Memo(self.library)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        # ASCII letters may be lowered first where no added token can be meant: the vocabulary lowers them anyway
        words = [(t.lower() if t.isascii() and ADDED not in t else t).replace("\n", " ").split(" ") for t in texts]
        if len(self.memo) > MEMO_WORDS:  # what came up again stays
            self.memo = Memo(self.library, {w: self.memo[w] for w in set().union(*words) if w in self.memo})
        ids = self.memo.__getitem__
        return [b"".join(map(ids, w)) for w in words]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)
