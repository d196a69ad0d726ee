"""Secrets in texts: three fixed kinds, and strings that a primed compressor finds new.

assign, access and hex are found by expression. The fourth kind, novel, is decided by zstandard: a candidate is a long
run of token characters (of NAME=VALUE the parts) with a sensitive word shortly before it, and its novelty is the number
of bytes that it adds to the compressed form of the text around it, with a dictionary of code and identifiers as the compressor's prefix. Words
and identifiers cost little there; random strings cost nearly their entropy, and are reported.

Defined results: null text is empty; empty text has no spans; novel spans never overlap the fixed kinds; rows that
repeat are each treated alone; other columns are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: The base kinds and the sizes that they need.
ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Runs of token characters, and their pieces: what stands before an inner = is a name, which counts as a word before the value.
CANDIDATE, LEAST = re.compile(r"[A-Za-z0-9+/_=~-]{20,}"), 20
PIECE = re.compile(r"[A-Za-z0-9+/_~-]+(?:=+(?![A-Za-z0-9+/_~=-]))?")
SENSITIVE = re.compile(r"(?i)auth|bearer|credential|private|secret|signature|passphrase|passw(?:or)?d|access|token|pwd|api_?key|(?<![a-z])(?:key|salt)(?![a-z])")
#: Characters before a candidate in which a sensitive word counts; characters around it that prime the compressor.
NEAR, AROUND = 64, 512
#: Bytes that a candidate must add for each of its characters; without digits or without letters, where random ones add
#: 0.8 or more and identifiers less.
NOVEL, NOVEL_PLAIN = 0.7, 0.8

WORDS = (
    "abstract access account address argument array async authorization await backend base64 bearer boolean buffer "
    "callback certificate channel client class close cluster commit config connection const constructor content context "
    "controller cookie create credential database debug default define delete description destination directory document "
    "domain download element enabled encoding endpoint environment error event exception execute export extends factory "
    "false fetch field filter final folder format function generate global group handler header hostname identifier import "
    "index initialize instance integer interface internal invalid iterator javascript keyword language length library "
    "listener local location logger manager message metadata method middleware module namespace network notification null "
    "number object operation options package parameter parent parser password pattern payload permission pipeline platform "
    "plugin pointer policy port prefix private process profile project promise property protected protocol provider proxy "
    "public python query queue random reader record redirect reference register release remote repository request require "
    "resource response result return route runtime sample schedule schema scope script secret select self sequence server "
    "service session settings signature source stack standard static status storage stream string struct subscription "
    "success suffix summary support system table target template terminal test thread timeout timestamp token transaction "
    "true tuple type undefined unique update upload user username utility validate value variable vector version virtual "
    "void volume warning web window worker workflow workspace writer"
)


def _dictionary() -> bytes:
    """Identifier shapes made of the words: snake, camel and constant case, calls and assignments."""
    words = WORDS.split()
    shapes = [f"{a}_{b} {a}{b.title()} {a.upper()}_{b.upper()} {a}.{b}() {a}-{b} " for a, b in zip(words, words[7:] + words[:7])]
    code = "if (x == null) { return; }\nfor (int i = 0; i < n; i++) {\ndef main(self):\n    import os\nexport const =\nfunction() { }\n"
    return ("0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ " + code + "".join(shapes) + WORDS).encode()


_compressor: list[zstandard.ZstdCompressor] = []


def _size(data: bytes) -> int:
    if not _compressor:
        primed = zstandard.ZstdCompressionDict(_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _compressor.append(zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False))
    return len(_compressor[0].compress(data))


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that text[start:end] adds to the compressed text around it, for each of its characters."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    around = (before + after).encode("utf-8", "surrogatepass")
    whole = (before + text[start:end] + after).encode("utf-8", "surrogatepass")
    return (_size(whole) - _size(around)) / (end - start)


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e in found)
    ends = list(accumulate((e for _, e in taken), max))
    for run in CANDIDATE.finditer(text):
        for m in PIECE.finditer(text, *run.span()):
            s, e = m.span()
            if e - s < LEAST or len(set(m[0])) < 10:
                continue
            if (at := bisect_left(taken, (e,))) and ends[at - 1] > s or not SENSITIVE.search(text[max(0, s - NEAR) : s]):
                continue
            mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
            if novelty(text, s, e) >= (NOVEL if mixed else NOVEL_PLAIN):
                found.append((s, 3, e))
    return sorted(found)


def _scan(batches):
    for batch in batches:
        rows = [spans(t) for t in batch.column(1).to_pylist()]
        base = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in r if k < 3) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)]
            + [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in range(4)]
            + [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in r) for r in rows])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of spans of each kind, the digest of the fixed kinds' spans, and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    )
