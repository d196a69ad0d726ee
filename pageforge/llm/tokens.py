"""Token ids of whole texts by a vocabulary file, with a bounded memory of word pieces.

A piece is what stands between two single blanks that have no other white space beside them; both kinds of
pre-tokenizer used here always cut there, so pieces are encoded on their own and their ids joined. They also cut between
a letter and a mark after it, so a word with a mark takes the word's ids, and at single line ends. Each Python worker remembers the ids of pieces
it has met, in two generations of at most MEMORY pieces. A new piece of Latin letters goes straight to the vocabulary's
merges, as it is one pre-token; others are encoded many at a time, as one text whose ids are cut again at a separator's id.
Where a vocabulary lower-cases and its pre-tokens are letters, digits or marks without white space, texts of Latin-1 are split
at any white space instead, in lower case: a word is new once, whatever its case and the line ends and marks beside it.
All short cuts are tried on a sample when a vocabulary is loaded, and are used only where they give the same ids.
"""

from __future__ import annotations

import functools
import operator
import os
import re
import struct
import zlib

import numpy as np

#: Pieces that a worker remembers in a generation, and the longest that it does.
MEMORY, LONGEST = 500_000, 40
BLANK = re.compile(r"(?<=\S) (?=\S)")
MARKS = frozenset(".,;:!?")
#: What can stand between two pieces, each with its leading blank, and has one id of its own there.
GLUES = ("\n", " |")
GLUED = re.compile(r"[^\s|]+")
SAMPLE = [" the", " word,", " x1y", " \u00e9t\u00e9.", " don't", " (a-b)", " !", " A"]
LETTERS = ["the", "A", "Word", "\u00e9t\u00e9", "\u00c9t\u00c9", "Stra\u00dfe", "\u0141\u00f3d\u017a", "qzx"]
_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(seen))}


BYTES = byte_letters()


#: Words of Latin letters alone (without the capital I with a dot, which becomes two characters).
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_LETTERS, _DIGITS, _SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
#: Pre-tokens of a text of Latin-1 in lower case: runs of letters, digits, endings after an apostrophe, runs of anything else.
PRE_TOKENS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:[stmd]|re|ve|ll)|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
#: Texts that try it: every character of Latin-1 beside others and itself, and endings.
TRIED = [f"{c}a{c}{c}B{c}1{c}2 {c}, {c}.{c}{c}" for c in map(chr, range(256))] + ["'" + "'".join(["s", "T", "re", "VE", "m", "ll", "d", "x", "!'s", " 's", "1's"])] + SAMPLE
#: What Python splits at and the vocabulary doesn't.
NOT_SPACES = "\x1c\x1d\x1e\x1f"
_ID = operator.attrgetter("id")
#: Words on lines of their own: single line ends, no other white space.
LINES = re.compile(r"\S+(?:\n\S+)+")


def _bytes(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)


def after_blank(word: str) -> str:
    return BYTES[32] + _bytes(word)


def lower_word(word: str) -> str:
    return _bytes(word.lower())


def latin1(text: str) -> bool:
    """No character is beyond Latin-1: none is composed with another, and each is lower-cased by itself."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.cache
def _packer(n: int):
    return struct.Struct(f"<{n}I").pack


class Remembered(dict):
    """The ids of what stands between white space, in lower case, and of its pre-tokens, worked out when they are asked for; in
    two generations, as an encoder's."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.before = encoder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            parts = [word] if word.isalpha() else PRE_TOKENS.findall(word)
            if len(parts) > 1:
                ids = b"".join([self[p] for p in parts])
            else:
                ids = self.encoder._merged(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTES))
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, self.raw(list(MARKS))))
        self.glue = None
        for glue in GLUES:
            ids = self.raw([glue])[0]
            if len(ids) == 4 and self._cut(SAMPLE, glue, ids) == self.raw(SAMPLE):
                self.glue = (glue, ids)
                break

        self.form = None
        for form in (after_blank, lower_word):
            if [self._merged(form(w)) for w in LETTERS] == self.raw([" " + w for w in LETTERS]):
                self.form = form
                break

        # what a line end between two words adds, if the words' own ids stay what they are
        self.line = None
        ids, inner = self.raw(["\n"])[0], [w.strip() for w in SAMPLE]
        if all(self.raw([f" {a}\n{b}"])[0] == self.raw([f" {a}"])[0] + ids + self.raw([b])[0] for a in inner for b in inner):
            self.line = ids

        self.words = Remembered(self)
        if self.form is not lower_word or [self._cut_up(x) for x in TRIED] != self.raw(TRIED):
            self.words = None

    def _cut_up(self, text: str) -> bytes:
        """The ids of a text of Latin-1, by its pre-tokens."""
        text = text.lower()
        parts = PRE_TOKENS.findall(text) if any(c in text for c in NOT_SPACES) else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def _merged(self, word: str) -> bytes:
        found = self.tokenizer.model.tokenize(word)
        return _packer(len(found))(*map(_ID, found))

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: list[str], glue: str, mark: bytes) -> list[bytes]:
        """The ids of texts that hold neither white space inside nor the glue's character."""
        ids = np.array(self.tokenizer.encode_batch_fast([glue.join(texts)], add_special_tokens=False)[0].ids, "<u4")
        at, data = np.flatnonzero(ids == np.frombuffer(mark, "<u4")[0]) * 4, ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)])]

    def _heads(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that no blank stands before: at the start of a text or of a line."""
        asked = dict.fromkeys(words)
        if len(self.first) + len(asked) > MEMORY // 5:
            self.first.clear()
        new = [w for w in asked if w not in self.first]
        found = dict(zip(new, self.raw(new)))
        self.first.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return {w: found[w] if w in found else self.first[w] for w in asked}

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pieces, each after a blank, that aren't words of Latin letters or lines."""
        found: dict[str, bytes] = {}
        plain = [p for p in pieces if self.glue and GLUED.fullmatch(p)]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = self._cut([" " + p for p in part], *self.glue)
            found.update(zip(part, ids if len(ids) == len(part) else self.raw([" " + p for p in part])))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self.raw([" " + p for p in rest])))
        return found

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't in the newest generation; those that are short enough are remembered there."""
        if len(self.after) + len(new) > MEMORY:
            self.before, self.after = self.after, {}
        found: dict[str, bytes] = {}
        lines, rest = [], []
        if self.line is not None:
            for p in new:
                if "\n" in p and LINES.fullmatch(p):
                    lines.append(p.split("\n"))
            asked = new.union(x[0] for x in lines).difference("\n".join(x) for x in lines) if lines else new
        else:
            asked = new
        after, before, form, marks, latin = self.after, self.before, self.form, self.marks, LATIN.fullmatch
        merged = self._merged
        for p in asked:
            ids = before.get(p)
            if ids is None:
                mark = marks.get(p[-1])
                stem = p if mark is None else p[:-1]
                if form is None or not latin(stem):
                    rest.append(p)
                    continue
                if mark is None:
                    ids = merged(form(p))
                else:
                    ids = after.get(stem) or before.get(stem)
                    if ids is None:
                        ids = merged(form(stem))
                        if len(stem) <= LONGEST:
                            after[stem] = ids
                    ids += mark
            found[p] = ids
        found |= self._fresh(rest)
        after.update(found if all(len(p) <= LONGEST for p in found) else ((p, x) for p, x in found.items() if len(p) <= LONGEST))
        if lines:
            heads, end = self._heads([w for x in lines for w in x[1:]]), self.line
            for x in lines:
                head = found.get(x[0]) or after.get(x[0])
                found["\n".join(x)] = end.join([head, *(heads[w] for w in x[1:])])
        return found

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        rows, new, get = [], set(), self.after.get
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                out[k] = self.raw([text])[0]
                continue
            if self.words is not None and latin1(text):
                out[k] = self._cut_up(text)
                continue
            parts = text.split(" ")
            ids = list(map(get, parts))
            ids[0] = b""
            fresh = {p for p, x in zip(parts, ids) if x is None} if None in ids else ()
            if text[0].isspace() or parts[0][-1:].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in fresh):
                parts = BLANK.split(text)
                ids = list(map(get, parts))
                ids[0] = b""
                fresh = {p for p, x in zip(parts, ids) if x is None}
            new.update(fresh)
            rows.append((k, parts, ids))
        # only a text's last piece can end in white space; it is not for the memory
        odd = [p for p in new if p[-1].isspace()]
        found = self._learn(new.difference(odd)) if new else {}
        found |= self._fresh(odd)
        heads = self._heads([parts[0] for _, parts, _ in rows])
        for k, parts, ids in rows:
            ids[0] = heads[parts[0]]
            if None in ids:
                ids = [found[p] if x is None else x for p, x in zip(parts, ids)]
            out[k] = b"".join(ids)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
