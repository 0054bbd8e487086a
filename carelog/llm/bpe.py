"""Operator 4, byte-level BPE encoding and decoding by batched merge rounds.

The vocabulary file gives the merges; nothing is trained.  Texts are cut at
special tokens and by the split pattern into words.  Words not met before go
through the merge rounds together: the symbols of all of them lie in one flat
numpy array; each round finds the rank of every neighbouring pair by binary
search over the sorted pair keys, takes the lowest rank of each word, and merges
its occurrences from left to right.  A word without a known pair is finished.
The ids of finished words are kept per task (cleared at ``MAX_WORDS`` words, so
memory stays bounded); this only saves time.

Null counts as empty: no ids, and the digests of the empty string.  The work is
per row, so repeated rows, ties and row order do not matter.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import append, free_name, pieces, table, texts_of, tidy

MAX_WORDS = 150_000
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file; built once per task."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([vocab[c] for c in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.bytes = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of each non-empty word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        which = np.arange(len(words))
        while len(which):
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), _NONE, np.int32)
            keys = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            rank[:-1] = np.where(self.keys[at] == keys, self.ranks[at], _NONE)
            rank[starts + sizes - 1] = _NONE  # the last symbol of a word has no partner
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            for k in np.flatnonzero(done):
                out[which[k]] = symbols[starts[k]:starts[k] + sizes[k]].tobytes()
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != _NONE))
            # in a run of overlapping equal pairs every second one merges
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), starts)
            keep &= ~np.repeat(done, np.diff(starts, append=len(symbols)))
            symbols, sizes, which = symbols[keep], sizes[~done], which[~done]
        return out

    def learn(self, texts_words: list[list[str]]) -> None:
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        if not self.known:
            self.known = {s: np.int32(i).tobytes() for s, i in self.special.items()}
        new = list(set().union(*texts_words) - self.known.keys())
        if new:
            self.known.update(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        self.learn(cut)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, w)), np.int32) for w in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> str:
        return ",".join(map(self.names.__getitem__, ids.tolist()))


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids (array<int>) of each text."""
    path, ids = path or vocabulary(), free_name(docs, ids)

    def run(batches):
        bpe = Bpe(path)
        for b in pieces(batches, text):
            got = [x.tolist() for x in bpe.encode(texts_of(b, text))]
            yield append(b, [ids], [pa.array(got, pa.list_(pa.int32()))])

    return docs.mapInArrow(tidy(run), _with(docs, f"{ids} array<int>"))


def decode_ids(docs: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list (null ids give an empty text)."""
    path, text = path or vocabulary(), free_name(docs, text)

    def run(batches):
        bpe = Bpe(path)
        for b in batches:
            got = [bpe.decode(np.array(x or [], np.int32)) for x in b.column(ids).to_pylist()]
            yield append(b, [text], [pa.array(got, pa.string())])

    return docs.mapInArrow(tidy(run), _with(docs, f"{text} string"))


def round_trip_digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Other columns of ``docs`` with n_tokens, ids_sha256 and decoded_sha256.

    Encodes, decodes from the ids, and keeps only digests, so that ids need not
    leave the task.
    """
    path = path or vocabulary()
    rest = [c for c in docs.columns if c != text]
    names = [free_name(docs, c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        bpe = Bpe(path)
        for b in pieces(batches, text, 2 << 20):
            ids = bpe.encode(texts_of(b, text))
            made = [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(bpe.listed(x)) for x in ids]),
                    pa.array([sha(bpe.decode(x)) for x in ids])]
            yield append(b.select(rest), names, made)

    kept = docs.select(*rest)
    return docs.mapInArrow(tidy(run), _with(kept, f"{names[0]} long, {names[1]} string, {names[2]} string"))


def _with(docs: DataFrame, more: str) -> StructType:
    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])


def op4_bpe(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
