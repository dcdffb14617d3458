"""Pre-tokens of the lower-casing word BPE, and ids per distinct pre-token.

The library takes special tokens out of a text, normalises what is left (NFC, white space, lower case)
and splits it before it merges, and merges never cross pre-tokens, so a text's ids are its pre-tokens'
ids in order.  Texts within Latin letters up to U+024F, where NFC changes nothing and lower case stays
one to one and in the range, are split by one expression; all others by the library's own normaliser
and splitter, piece by piece.  No text is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import public_tokenizers
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Split

MODEL = "word_bpe_49k.json"
# Lower-case Latin letters and numbers of the safe range, white space as the library has it.
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
SPLIT = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
# Characters whose lower case is another single character of the range, or themselves.
SAFE = "".join(c for c in map(chr, range(0x250)) if len(c.lower()) == 1 and c.lower() < "\u0250")
UNSAFE = re.compile(f"[^{re.escape(SAFE)}]")
GENERATION = 250_000


class WordIds:
    """A bounded cache of ids per pre-token over the library's tokenizer."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path or public_tokenizers.path(MODEL))
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(self.library.to_str())
        steps = parts["pre_tokenizer"]["pretokenizers"]
        self.splitter = Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        self.to_bytes = ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}  # ids as unsigned 32-bit little-endian
        self.older: dict[str, bytes] = {}
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for piece, i in self.library.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is one."""
        if "<|" not in text and (text.isascii() or not UNSAFE.search(text)):
            return SPLIT.findall(text.lower())
        found: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                found.append(part)
            elif part.isascii() or not UNSAFE.search(part):
                found += SPLIT.findall(part.lower())
            else:
                found += [p for p, _ in self.splitter.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return found

    def ids(self, word: str) -> list[int]:
        """The ids of one pre-token, which is not normalised again."""
        if word in self.special:
            return [self.special[word]]
        return [t.id for part, _ in self.to_bytes.pre_tokenize_str(word) for t in self.library.model.tokenize(part)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The cache, holding at least these words: each distinct one is encoded once while it stays.

        It has two generations: when the younger is full it becomes the older, and words that are
        still met move back, so frequent words stay and memory is bounded.
        """
        if len(self.known) > GENERATION:
            self.known, self.older = {}, self.known
        fresh = [w for w in words if w not in self.known]
        if self.older:
            self.known.update((w, self.older[w]) for w in fresh if w in self.older)
            fresh = [w for w in fresh if w not in self.known]
        self.known.update((w, np.array(self.ids(w), np.uint32).tobytes()) for w in fresh if not w.isascii() or w in self.special)
        fresh = [w for w in fresh if w.isascii() and w not in self.special]
        groups = [fresh[i : i + 50] for i in range(0, len(fresh), 50)]
        for group, found in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()  # a word's last piece is marked
            if len(cuts) != len(group):
                self.known.update((w, np.array(self.ids(w), np.uint32).tobytes()) for w in group)
                continue
            joined, at = ids.tobytes(), 0
            for w, cut in zip(group, cuts, strict=True):
                self.known[w] = joined[at:cut]
                at = cut
        return self.known


@functools.cache
def word_ids() -> WordIds:
    """One per worker process, so that its cache outlives a task."""
    return WordIds()
