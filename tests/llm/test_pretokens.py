"""Token ids against the library, for every character of the basic plane and odd mixtures."""

import random

import numpy as np

from hornlake.llm.pretokens import WordIds


def same(words, text):
    split = words.split(text)
    known = words.learn(set(split))
    return np.frombuffer(b"".join(known[w] for w in split), np.uint32).tolist() == words.library.encode(text, add_special_tokens=False).ids


def test_every_character_alone_before_behind_and_within_words():
    words = WordIds()
    for low in range(0, 0x10000, 64):
        known = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        assert same(words, " ".join(f"significant{c} {c}Word w{c}d {c}1 '{c} {c}" for c in known)), hex(low)


def test_mixtures():
    words, rnd = WordIds(), random.Random(3)
    pool = ["a", "B", "é", "Ɛ", "İ", "Σ", "ς", "̈", "̇", "’", "'s", "'S", "“", "1", "²", "中", "​", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "ﬁ", "ǰ", "\U0001f600", "K", "ẞ", "\x85", "　"]
    for _ in range(2000):
        text = "".join(rnd.choices(pool, k=rnd.randint(0, 14)))
        assert same(words, text), text
