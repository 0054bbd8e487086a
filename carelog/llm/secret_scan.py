"""Operator 7, secret scans: patterns plus a token-efficiency test.

A byte-pair vocabulary learned from ordinary text packs words into few tokens.
A random string has no such pieces, so its characters-per-token ratio is low.
Every run of at least ``MIN_RUN`` key characters that is not an excluded form is
encoded with a tiktoken vocabulary, and a ratio below ``MAX_RATIO`` marks it.

Excluded: digests of known lengths in hexadecimal, UUIDs, numbers, and
identifiers (runs whose parts between separators are words: one case of letters,
or capitalised, with at most a short number at the end).  Such a part is a word only
if it passes the ratio test on its own, or has at most ``MAX_SHORT`` characters and
its letters are one token.

Spans are code points, end exclusive, as (start, end, kind).  Pattern spans
(assign, access, hex) are found leftmost without overlap for each kind; the
method adds ``random`` spans for the parts of random runs that no pattern span
covers.  Such a part beside a pattern span stays out if it is an excluded form by
itself, with a separator or an assignment next to it.  Null counts as empty.  The work is per row: repeated rows, ties and row order do not matter.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, free_name, pieces, table, texts_of, tidy

#: Fixed values of the contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Parameters of the method.
MIN_RUN, MAX_RATIO, MAX_SHORT = 20, 1.9, 2
SEPARATORS = "+/_=-"
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


def tokenizer(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Scanner:
    """Finds the spans of one text; built once per task."""

    def __init__(self, path: str, pattern: str, max_ratio: float = MAX_RATIO):
        self.encode = tokenizer(path, pattern).encode_ordinary
        self.max_ratio = max_ratio
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        self.hex = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")  # a run that is long enough is found whole
        self.run = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
        self.uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
        self.digest = re.compile(r"[0-9a-f]+|[0-9A-F]+")
        self.name = re.compile(r"([A-Z]?[a-z]*|[A-Z]+)[0-9]{0,4}")
        self.part = re.compile(r"[+/_=-]+|(?<=[a-z])(?=[A-Z][a-z])")

    def patterns(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= MIN_VALUE]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if len(m[0]) >= MIN_ACCESS]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def known(self, run: str) -> bool:
        if self.digest.fullmatch(run) and len(run) in DIGEST_LENGTHS or self.uuid.fullmatch(run):
            return True
        return all(not x or x.isdigit() or self.name.fullmatch(x) and self.word(x) for x in self.part.split(run))

    def dense(self, part: str) -> bool:
        return len(part) < self.max_ratio * len(self.encode(part))

    def word(self, part: str) -> bool:
        return not self.dense(part) or len(part) <= MAX_SHORT and len(self.encode(part.rstrip("0123456789"))) == 1

    def random(self, text: str) -> list[tuple[int, int, int]]:
        return [(m.start(), 3, m.end()) for m in self.run.finditer(text) if self.dense(m[0]) and not self.known(m[0])]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = self.patterns(text)
        more = [(s, 3, e) for start, _, end in self.random(text) for s, e in self.uncovered(text, start, end, base)]
        return sorted(base + more)

    def uncovered(self, text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Parts of a random run outside the (sorted) pattern spans, without words that only stand beside one."""
        out, at, before = [], start, True
        for s, k, e in [*(b for b in base if b[0] < end and b[2] > start), (end, None, end)]:
            if s > at:
                part = text[at:s]
                left, right = before or part[0] in SEPARATORS, k in (None, 0) or part[-1] in SEPARATORS
                if not (left and right and (at, s) != (start, end) and self.known(part)):
                    out.append((at, s))
            if e > at:
                at, before = e, False
        return out


def vocabulary() -> tuple[str, str]:
    """Default tiktoken file and split pattern of the installed tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def scan_secrets(docs: DataFrame, text: str = "text", vocab: tuple[str, str] | None = None,
                 max_ratio: float = MAX_RATIO, spans: str = "spans") -> DataFrame:
    """``docs`` with an array column of (start, end, kind); see the module for the rules."""
    path, pattern = vocab or vocabulary()
    spans = free_name(docs, spans)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scan(batches):
        scanner = Scanner(path, pattern, max_ratio)
        for b in pieces(batches, text):
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in scanner.spans(t)]
                     for t in texts_of(b, text)]
            yield append(b, [spans], [pa.array(found, kind)])

    return docs.mapInArrow(tidy(scan), _schema(docs, f"{spans} array<struct<start:int,end:int,kind:string>>"))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]",
                   vocab: tuple[str, str] | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; columns stay (null text stays null)."""
    path, pattern = vocab or vocabulary()

    def clean(scanner, t):
        if t is None:
            return None
        out, at = [], 0
        for start, _, end in scanner.spans(t):
            if end <= at:
                continue
            if start >= at:
                out += [t[at:start], mark]
            at = end
        return "".join(out) + t[at:]

    def scan(batches):
        scanner = Scanner(path, pattern, max_ratio)
        for b in pieces(batches, text):
            new = pa.array([clean(scanner, t) for t in b.column(text).to_pylist()], b.schema.field(text).type)
            yield b.set_column(b.schema.names.index(text), text, new)

    return docs.mapInArrow(tidy(scan), docs.schema)


def _schema(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType
    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])


def op7_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("random"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
