"""Token ids by remembered words: the tokenizer's own, and no word is asked for twice."""

import random

import numpy as np

from pageforge.llm import tokens
from pageforge.llm.queries import vocabulary


def test_words_are_new_once(monkeypatch):
    """Another case, a mark or a line end beside a known word asks the vocabulary for nothing but the mark."""
    encode, asked = tokens.Encoder(vocabulary("word_bpe_49k.json")), []
    first = encode.many(["alpha beta étéé"])[0]
    raw, merged = encode.raw, encode._merged
    monkeypatch.setattr(encode, "raw", lambda texts: asked.extend(texts) or raw(texts))
    monkeypatch.setattr(encode, "_merged", lambda word: asked.append(word) or merged(word))
    got = encode.many(["Alpha\nBETA ÉTÉÉ\n\nalpha, Beta."])[0]
    assert not set(asked) - {",", "."}
    assert got == first + raw(["alpha, beta."])[0]


def test_same_ids(monkeypatch):
    """Every character of Latin-1 beside others, endings, other alphabets and combining marks, with a memory of a few words."""
    monkeypatch.setattr(tokens, "MEMORY", 50)
    rng = random.Random(7)
    latin = [*map(chr, range(256)), "'s", "'T", "'ll", "word", "Word", "Été", " ", " ", "\n", "x" * 60]
    other = [*latin[65:], "İ", "Σ", "Σ ", "İ", "T̈", "̈", "日本", "Ж", " ", "　", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for letters in (latin, other) for _ in range(1500)] + ["", None, " "]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = tokens.Encoder(vocabulary(name))
        want = [np.array(e.ids, "<u4").tobytes() for e in encode.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for t, x, y in zip(texts, encode.many(texts), want):
            assert x == y, (name, t)
        assert (encode.words is None) == (name == "byte_bpe_50k.json")
