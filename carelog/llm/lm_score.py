"""Operator 1, language-model scoring with causal self-attention on subword ids.

A text is its sequence of words (A-Z lower-cased) and one end; each word is cut into
the ids of a public byte-pair vocabulary, and the model gives the probability of
every id after those before it.  It is trained here, in two parts:

- Attention.  One causal self-attention layer over the last ``CONTEXT`` to
  ``CONTEXT + SCORED - 1`` ids: tables for query, key and value of an id, a bias for
  the distance, and an output layer over ``CLASSES`` classes of ids of about equal
  frequency; within a class an id has its share of the training counts.  A gate,
  also computed from the attention output, mixes this with
- memory.  Counts of ids, pairs and triples from all training texts, with absolute
  discounting: what a context gives away goes to the next shorter one, so the
  probabilities of all ids add up to 1.  All pairs and triples are
  counted; the most frequent ones (``PAIR_SLOTS``, ``TRIPLE_SLOTS``) are sent out, and
  a rarer one counts as not met.

Both parts are proper distributions, and so is their mixture.

Training is data-parallel: in each round every task takes gradient steps from the
common parameters over its windows, and the parameters are averaged by a tree
reduction weighted by windows.  Every window of every training text enters the
gradient, in one of the rounds (``WINDOW_RATE`` is 1: one window of each so many).

Scoring cuts a text into windows of ``SCORED`` ids with ``CONTEXT`` ids before them;
windows overlap in their contexts and each id is scored once.  Many windows go
through the masked attention as one batch.

The word counts of the base score are exact: the most frequent words are sent out
(bounded), all others are joined by the hash of the word.

Defined results: a null text counts as empty: its only token is the end; a null id
counts as an empty text for the hash that splits training and held-out rows;
repeated rows count, and are scored, as often as they occur; without training rows
counts are zero and ids uniform.
"""

from __future__ import annotations

import base64
import functools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pieces, saved, table, tidy

CONTEXT, SCORED = 16, 16
DIM, CLASSES, ROWS = 16, 64, 8192
WINDOW_RATE, ROUNDS, RATE = 1, 3, 0.15
#: Windows of a training step, and those scored at once.
STEP, BLOCK = 128, 128
#: Most words, pairs and triples sent out with their counts.
WORDS, PAIR_SLOTS, TRIPLE_SLOTS = 1 << 18, 1 << 19, 1 << 20
#: Pairs and triples enter the counts if a task meets them so often in a chunk of its ids: all do.
LOCAL_PAIR, LOCAL_TRIPLE, CHUNK = 1, 1, 5_000_000
IDS, START, END, PAD = 50_258, 50_257, 50_256, 65_535  # START is never predicted


def vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Words:
    """Word -> row of per-word arrays; rows of words met lately are kept (``LIMIT``)."""

    LIMIT = 400_000

    def __init__(self, vocab: tuple[str, str], counts: tuple[np.ndarray, np.ndarray] | None = None, forget: bool = True):
        import tiktoken
        import xxhash
        path, pattern = vocab
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("lm", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.hash, self.counts = encoder.encode_ordinary, xxhash.xxh3_64_intdigest, counts
        self.size = np.zeros(1 << 16, np.int64)  # bytes of each id
        self.size[list(ranks.values())] = [len(b) for b in ranks]
        # (bytes that may begin) white space that does not part words, and what is no UTF-8
        self.odd_space = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a|\xe2[\x80\x81]|\xe3\x80\x80|\xed[\xa0-\xbf]").search
        self.forget = forget
        self.clear()

    def clear(self) -> None:
        self.words: list[pa.Array] = []  # in the order of their rows
        self.hashes = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.int64)  # the count, or -1 where it is not sent out
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words of all texts, A-Z lower-cased (null: none), and how many each text has."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat, owner = lists.flatten(), pc.list_parent_indices(lists)
        some = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
        return self.of(flat.filter(some).cast(pa.binary())), np.bincount(owner.filter(some).to_numpy(), minlength=len(texts))

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of the words of each text."""
        ends = np.cumsum([0, *map(len, texts)])
        rows = self.of(pa.array([w for t in texts for w in t], pa.binary()))
        return [rows[a:z] for a, z in zip(ends, ends[1:])]

    def of(self, asked: pa.Array) -> np.ndarray:
        """The row of each word; words not met before get new ones."""
        if self.forget and len(self.hashes) > self.LIMIT:
            self.clear()
        first, asked = len(self.hashes), asked.dictionary_encode()
        met = pc.index_in(asked.dictionary, value_set=pa.chunked_array(self.words, pa.binary()))
        unmet = asked.dictionary.filter(met.is_null())
        row = pc.fill_null(met, -1).to_numpy().astype(np.int64)
        row[row < 0] = first + np.arange(len(unmet))
        if len(unmet):
            self.words.append(unmet)
            new = unmet.to_pylist()
            h = np.fromiter(map(self.hash, new), np.uint64, len(new)).view(np.int64)
            self.hashes = np.concatenate([self.hashes, h])
            if self.counts is not None:
                keys, c = self.counts
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                found = np.where(keys[at] == h, c[at], -1) if len(keys) else np.full(len(h), -1)
                self.known = np.concatenate([self.known, found])
            ids, ends = self.ids_of(new)
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + ends])
        return row.take(asked.indices.to_numpy())

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and where those of each word end."""
        odd = [k for k, w in enumerate(words) if self.odd_space(w)] if self.odd_space(b" ".join(words)) else []
        if not odd:
            return self.cut(words, len(words))
        plain = np.delete(np.arange(len(words)), odd)
        ids, ends = self.cut([words[k] for k in [*plain, *odd]], len(plain))
        size, place = np.diff(ends, prepend=0), np.argsort(np.concatenate([plain, odd]))
        starts, size = (ends - size)[place], size[place]
        upto = np.cumsum(size)
        return ids[np.repeat(starts - (upto - size), size) + np.arange(len(ids))], upto

    def cut(self, words: list[bytes], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each after a space, and where those of each word end.

        The first ``plain`` words go through the encoder as one text: its split
        pattern never joins what a space parts.  The others hold white space beyond
        ASCII, would meet their neighbours' spaces, and are encoded alone.
        """
        text = b"".join([b" " + w for w in words[:plain]]).decode("utf-8", "replace")
        ids = np.array(self.encode(text), np.uint16)
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w) + 1 for w in words[:plain]]), "left") + 1
        parts = [self.encode(" " + w.decode("utf-8", "replace")) for w in words[plain:]]
        more = np.cumsum([len(p) for p in parts]) + len(ids) if parts else []
        return (np.concatenate([ids, np.array([i for p in parts for i in p], np.uint16)]),
                np.concatenate([ends, more]).astype(np.int64))

    def subwords(self, rows: np.ndarray) -> np.ndarray:
        """Ids of a text, with the end."""
        return self.subwords_of(rows, np.array([len(rows)]))[0]

    def subwords_of(self, rows: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, with its end; ``counts``: how many of the rows are its."""
        first = self.start.take(rows)
        size = self.start.take(rows + 1) - first
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids.take(np.repeat(first - upto[:-1], size) + np.arange(upto[-1]))
        ends = upto.take(np.cumsum(counts))
        ids = np.insert(ids, ends, END)
        ends += np.arange(1, len(counts) + 1)
        return [ids[a:z] for a, z in zip([0, *ends[:-1]], ends)]


def stream(texts: list[np.ndarray], pick: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that hold all windows, where each window starts, and the text of each; see ``windows``."""
    parts, starts, owner, at = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    before = np.full(CONTEXT + 1, PAD, np.uint16)
    before[-1] = START
    for k, ids in enumerate(texts):
        n = -(-len(ids) // SCORED)
        parts += [before, ids, np.full(n * SCORED - len(ids), PAD, np.uint16)]
        first = np.arange(n) if pick is None else np.arange(pick[k], n, WINDOW_RATE)
        starts.append(at + first * SCORED)
        owner.append(np.full(len(first), k))
        at += CONTEXT + 1 + n * SCORED
    return np.concatenate(parts), np.concatenate(starts), np.concatenate(owner)


def windows(texts: list[np.ndarray], pick: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window, CONTEXT + SCORED + 1) ids of all windows, PAD outside, and the text of each.

    Ids before a text are PAD but for one START; the ids to score are the last
    SCORED ones.  With ``pick`` only windows k with k % WINDOW_RATE == pick of the text.
    """
    flat, starts, owner = stream(texts, pick)
    if not len(starts):
        return np.zeros((0, CONTEXT + SCORED + 1), np.uint16), owner
    return np.lib.stride_tricks.sliding_window_view(flat, CONTEXT + SCORED + 1)[starts], owner


_MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Keys (0 or more) with a value each, in the order of a hash whose first bits lead to the few rows that may hold a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        cell = self.cell(keys.astype(np.int64))
        order = np.argsort(cell, kind="stable")
        # the first row is no key's, nor is the last, where an empty last cell leads
        self.keys = np.concatenate([[-1], keys[order], [-1]]).astype(np.int64)
        self.values = np.concatenate([[0], values[order], [0]]).astype(np.float32)
        ends = np.cumsum(np.bincount(cell, minlength=1 << self.bits))
        self.first = np.concatenate([[1], ends + 1]).astype(np.int32)  # of each cell, and after the last

    @classmethod
    def of(cls, arrays: tuple) -> Lookup:
        out = cls.__new__(cls)
        out.bits, out.first, out.keys, out.values = arrays
        return out

    def arrays(self) -> tuple:
        return self.bits, self.first, self.keys, self.values

    def cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> np.uint64(64 - self.bits)).view(np.int64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, 0 where it is not held."""
        flat = np.ascontiguousarray(keys, np.int64).ravel()
        cell = self.cell(flat)
        row = self.first.take(cell)
        hit = self.keys.take(row) == flat
        out = row * hit
        left = np.flatnonzero(~hit)
        row, end, want = row.take(left) + 1, self.first.take(cell.take(left) + 1), flat.take(left)
        more = np.flatnonzero(row < end)
        while len(more):
            left, row, end, want = left[more], row[more], end[more], want[more]
            hit = self.keys.take(row) == want
            out[left[hit]] = row[hit]
            row += 1
            more = np.flatnonzero(~hit & (row < end))
        return out.reshape(keys.shape)

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.at(keys)]


class Memory:
    """Discounted probabilities of an id after two, one or no id."""

    DISCOUNT = 0.6

    def __init__(self, single: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray],
                 triples: tuple[np.ndarray, np.ndarray]):
        d = self.DISCOUNT
        count = np.zeros(1 << 16)
        count[single[0]] = single[1]
        self.count = count.astype(np.float32)
        total = count.sum() - count[START]  # starts are contexts only
        count_of = count.copy()
        count_of[START] = 0
        self.single = ((count_of + 0.1) / (total + 0.1 * (IDS - 1))).astype(np.float32)
        self.single[START] = self.single[IDS:] = 0
        key, c = pairs[0], pairs[1].astype(np.float64)
        first = key >> 16
        value = np.maximum(c - d, 0) / np.maximum(count[first], c)
        self.pair_rest = np.maximum(1 - np.bincount(first, value, 1 << 16), 1e-6).astype(np.float32)
        # contexts of triples are pairs; a triple stays if its context does
        self.contexts = Lookup(key, c)
        self.pair = Lookup(key, value)  # the same keys, so the same rows
        tkey, tc = triples[0], triples[1].astype(np.float64)
        at = self.contexts.at(tkey >> 16)
        tkey, tc, at = tkey[at > 0], tc[at > 0], at[at > 0]
        value = np.maximum(tc - d, 0) / np.maximum(self.contexts.values[at], tc)
        self.triple = Lookup(tkey, value)
        self.context = self.contexts.values
        self.triple_rest = np.maximum(1 - np.bincount(at, value, len(self.context)), 1e-6).astype(np.float32)

    def arrays(self) -> tuple:
        """What the object holds, as plain arrays: a broadcast must not name this package's classes, which workers may lack."""
        plain = (self.count, self.single, self.pair_rest, self.triple_rest, self.pair.values)
        return plain, self.contexts.arrays(), self.triple.arrays()

    @classmethod
    def of(cls, arrays: tuple) -> Memory:
        out = cls.__new__(cls)
        (out.count, out.single, out.pair_rest, out.triple_rest, pair), contexts, triple = arrays
        out.contexts, out.triple = Lookup.of(contexts), Lookup.of(triple)
        out.pair, out.context = Lookup.of((*contexts[:3], pair)), out.contexts.values
        return out

    def __call__(self, two: np.ndarray, one: np.ndarray, x: np.ndarray, itself: bool = False) -> np.ndarray:
        """Probability of ``x`` after (two, one); with ``itself``, as if this occurrence were not counted.

        Training windows are themselves counted, so the gate must learn from what
        the memory would say without them.
        """
        two, one, x = (a.astype(np.int64) for a in (two, one, x))
        return self.mixed(self.contexts.at(two << 16 | one), self.pair.at(one << 16 | x), two << 32 | one << 16 | x, one, x, itself)

    def of_windows(self, w: np.ndarray, itself: bool = False) -> np.ndarray:
        """Probabilities of the ids to score of windows; the pair that ends in an id is the next one's context."""
        ids = w[:, CONTEXT - 1:].astype(np.int64)
        one, x = ids[:, 1:-1], ids[:, 2:]
        pairs = ids[:, :-1] << 16 | ids[:, 1:]
        at = self.contexts.at(pairs)
        return self.mixed(at[:, :-1], at[:, 1:], pairs[:, :-1] << 16 | x, one, x, itself)

    def mixed(self, at: np.ndarray, pair: np.ndarray, three: np.ndarray, one: np.ndarray, x: np.ndarray, itself: bool) -> np.ndarray:
        """``at`` and ``pair``: rows of (two, one) and (one, x); ``three``: keys of triples."""
        met = at > 0
        p2, p3 = self.pair.values.take(pair), np.zeros(at.shape, np.float32)
        p3[met] = self.triple.get(three[met])
        if itself:
            n2, n3 = self.count.take(one), self.context.take(at)
            p2 = np.maximum(p2 * n2 - 1, 0) / np.maximum(n2 - 1, 1)
            p3 = np.maximum(p3 * n3 - 1, 0) / np.maximum(n3 - 1, 1)
        p = p2 + self.pair_rest.take(one) * self.single.take(x)
        return np.where(met, p3 + self.triple_rest.take(at) * p, p)


class Attention:
    """Parameters, probabilities and gradients of the attention part."""

    def __init__(self, single: tuple[np.ndarray, np.ndarray], theta: np.ndarray | None = None):
        ids, c = single
        some = (ids != START) & (ids < IDS)
        ids, c = ids[some], c[some].astype(np.float64)
        order = np.lexsort((ids, -c))
        ids, c = ids[order], c[order]
        # the most frequent ids have rows of their own, the others share them by remainder
        self.row = np.arange(1 << 16) % (ROWS - 2)
        self.row[ids[:ROWS - 2]] = np.arange(min(len(ids), ROWS - 2))
        self.row[START], self.row[PAD] = ROWS - 2, ROWS - 1
        share = np.full(1 << 16, 0.1)
        share[ids] += c
        share[START] = 0
        share[IDS:] = 0
        by = np.argsort(-share[:IDS], kind="stable")
        upto = np.cumsum(share[by]) / share.sum()
        self.group = np.zeros(1 << 16, np.int64)
        self.group[by] = np.minimum((upto * CLASSES - 1e-9).astype(np.int64), CLASSES - 1)
        size = np.bincount(self.group[:IDS], share[:IDS], CLASSES)
        self.inside = (share / np.maximum(size[self.group], 1e-9)).astype(np.float32)
        self.shapes = [("qkv", (ROWS, 3 * DIM)), ("far", (CONTEXT + SCORED,)),
                       ("out", (DIM, CLASSES)), ("bias", (CLASSES,)), ("gate", (DIM,)), ("open", (1,))]
        if theta is None:
            rng = np.random.default_rng(7)
            qkv = np.concatenate([rng.normal(0, 0.3, (ROWS, DIM)) for _ in range(3)], axis=1)
            rng.normal(0, 0.3, CONTEXT + SCORED)  # not used; the draws after it stay the same
            start = {"qkv": qkv, "far": -0.2 * np.arange(CONTEXT + SCORED),
                     "out": rng.normal(0, 0.3, (DIM, CLASSES)), "bias": np.log(size / size.sum() + 1e-9),
                     "gate": np.zeros(DIM), "open": np.array([-2.0])}
            theta = np.concatenate([np.ravel(start[n]) for n, _ in self.shapes])
        self.theta = theta.astype(np.float32)
        for n, x in self.views(self.theta).items():
            setattr(self, n, x)
        i, j = np.arange(SCORED)[:, None] + CONTEXT, np.arange(CONTEXT + SCORED)[None, :]
        self.distance = np.clip(i - j, 0, CONTEXT + SCORED - 1)
        self.causal = (j <= i)
        self.later = np.where(self.causal, 0, -1e9).astype(np.float32)
        self.rooms: dict[str | tuple, np.ndarray] = {}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters, or what is kept for each of them, by name."""
        out, at = {}, 0
        for n, s in self.shapes:
            size = int(np.prod(s))
            out[n] = flat[at:at + size].reshape(s)
            at += size
        out["rest"] = flat[out["qkv"].size:]  # all but the rows of ids
        return out

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, zero at first and the same at every call: new ones would cost a page fault every 4 KB."""
        found = self.rooms.get((name, *shape))
        if found is None:
            size = math.prod(shape)
            if name not in self.rooms or self.rooms[name].size < size:
                self.rooms = {k: x for k, x in self.rooms.items() if k[0] != name} | {name: np.zeros(size, np.float32)}
            found = self.rooms[name, *shape] = self.rooms[name][:size].reshape(shape)
        return found

    def forward(self, w: np.ndarray) -> dict:
        """Attention odds ``a`` with their sums, its output ``h``, class odds ``e`` with their sums, gate and target class.

        The large arrays hold until the next call. Scores stay small (tables start
        near 0 and move by bounded steps), so exponentials need no shift; a batch in
        which one overflows is shifted.
        """
        n, seen, target = len(w), w[:, :-1], w[:, CONTEXT + 1:]
        r = self.row.take(seen)
        qkv = self.qkv.take(r, axis=0, out=self.room("qkv", n, CONTEXT + SCORED, 3 * DIM), mode="clip")
        early = np.flatnonzero(seen[:, 0] == PAD)  # windows that begin before their text

        def near():
            z = np.matmul(qkv[:, CONTEXT:, :DIM], qkv[:, :, DIM:2 * DIM].transpose(0, 2, 1), out=self.room("a", n, SCORED, CONTEXT + SCORED))
            z += self.far[self.distance] + self.later
            if len(early):
                z[early] += np.where(seen[early] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
            return z

        a, weight = _odds(near)
        h = self.room("h", n, SCORED, DIM + 1)  # and a 1 for what does not depend on it
        np.matmul(a, qkv[:, :, 2 * DIM:], out=h[:, :, :DIM])
        h[:, :, DIM:] = weight
        h = h.reshape(-1, DIM + 1)
        h /= weight.reshape(-1, 1)
        last = self.room("last", DIM + 1, CLASSES + 1)
        last[:DIM, :CLASSES], last[DIM, :CLASSES], last[:DIM, CLASSES], last[DIM, CLASSES] = self.out, self.bias, self.gate, self.open[0]

        def classes():
            u = np.matmul(h, last, out=self.room("e", len(h), CLASSES + 1))
            gate = u[:, CLASSES].copy()
            u[:, CLASSES] = -1e9
            return u, gate

        u, gate = classes()
        e, total = _odds(lambda: classes()[0], u)
        total = total.reshape(target.shape)
        mine = np.arange(0, e.size, CLASSES + 1) + self.group.take(target).ravel()  # place of the target's class
        g = 1 / (1 + np.exp(-np.minimum(np.maximum(gate, -20), 20)))
        return {"r": r, "qkv": qkv, "a": a, "weight": weight, "h": h, "last": last, "e": e, "total": total, "at": mine,
                "mine": e.ravel().take(mine).reshape(target.shape) / total, "g": g.reshape(target.shape), "target": target}

    def probability(self, w: np.ndarray, memory: Memory, itself: bool = False,
                    counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
        """Of the ids to score: their probability and the attention part's; ``counted``: the memory's, if known."""
        f = self.forward(w)
        counted = memory.of_windows(w, itself) if counted is None else counted
        attended = f["mine"] * self.inside.take(f["target"])
        return f["g"] * attended + (1 - f["g"]) * counted, attended, f | {"counted": counted}

    def parts(self, w: np.ndarray, memory: Memory, itself: bool = True,
              counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the mean log-likelihood: the rows of ids that the windows move, their gradient, and that of the rest."""
        total, attended, f = self.probability(w, memory, itself, counted)
        real = (f["target"] != PAD).astype(np.float32)
        scale = real / max(real.sum(), 1)
        total = np.maximum(total, 1e-12)
        part = scale * f["g"] * attended / total  # posterior of the attention part
        dg = (scale * (attended - f["counted"]) / total * f["g"] * (1 - f["g"])).ravel()
        du, h, a, qkv = f["e"], f["h"], f["a"], f["qkv"]
        du *= (-part / f["total"]).reshape(-1, 1)
        du.ravel()[f["at"]] += part.ravel()
        du[:, CLASSES] = dg
        dh = np.matmul(du, f["last"][:DIM].T, out=self.room("dh", len(h), DIM))
        dh /= f["weight"].reshape(-1, 1)  # in place of dividing the odds, which are more
        shift = np.einsum("ij,ij->i", dh, h[:, :DIM]).reshape(len(w), -1, 1)
        dh = dh.reshape(*part.shape, DIM)
        dz = np.matmul(dh, qkv[:, :, 2 * DIM:].transpose(0, 2, 1), out=self.room("dz", *a.shape))
        dz -= shift
        dz *= a
        d = self.room("d", *qkv.shape)  # contexts ask nothing: their queries' part stays zero
        np.matmul(dz, qkv[:, :, DIM:2 * DIM], out=d[:, CONTEXT:, :DIM])
        np.matmul(dz.transpose(0, 2, 1), qkv[:, CONTEXT:, :DIM], out=d[:, :, DIM:2 * DIM])
        np.matmul(a.transpose(0, 2, 1), dh, out=d[:, :, 2 * DIM:])
        far = np.ones(len(w), np.float32) @ dz.reshape(len(w), -1)
        last = h.T @ du
        far = np.bincount(self.distance.ravel(), far * self.causal.ravel(), CONTEXT + SCORED)
        rest = np.concatenate([far, last[:DIM, :CLASSES].ravel(), last[DIM, :CLASSES], last[:, CLASSES]], dtype=np.float32, casting="same_kind")
        return *_sum_rows(f["r"].ravel(), d.reshape(-1, 3 * DIM)), rest

    def gradient(self, w: np.ndarray, memory: Memory, itself: bool = True) -> np.ndarray:
        """Gradient of the mean log-likelihood; ``itself`` as for the memory."""
        flat = np.zeros(len(self.theta), np.float32)
        into = self.views(flat)
        rows, g, into["rest"][:] = self.parts(w, memory, itself)
        into["qkv"][rows] = g
        return flat

    def step(self, w: np.ndarray, memory: Memory, past: dict[str, np.ndarray], counted: np.ndarray | None = None) -> None:
        """One step of size ``RATE`` over the root of the summed squares ``past``; rows without gradient stay as they are."""
        rows, g, rest = self.parts(w, memory, counted=counted)
        for n, rows, g in (("qkv", rows, g), ("rest", slice(None), rest)):
            table, sums = getattr(self, n), past[n]
            now = g * g
            now += sums[rows]
            sums[rows] = now
            g *= RATE
            g /= np.sqrt(now, out=now)
            g += table[rows]
            table[rows] = g


def _odds(scores, z: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) in place of z, and its sums over the last axis, shifted if a sum is no normal number; ``scores()`` is z (anew)."""
    z = scores() if z is None else z
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    total = (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], np.float32)).reshape(*z.shape[:-1], 1)
    if len(total) and not 1e-30 < total.min() <= total.max() < 1e30:
        z = scores()
        z -= z.max(axis=-1, keepdims=True)
        np.exp(z, out=z)
        total = z.sum(axis=-1, keepdims=True)
    return z, total


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows met, and the sum of the values of each."""
    short = rows.astype(np.uint16)  # sorted by digits, in linear time
    order = np.argsort(short, kind="stable")
    short = short.take(order)
    first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    if values.shape[1] % 2:
        values = np.pad(values, ((0, 0), (0, 1)))
    twos = values.take(order, axis=0).view(np.complex64)  # two sums at a time
    return short.take(first).astype(np.int64), np.add.reduceat(twos, first, axis=0).view(np.float32)


#: What is counted, and in how many parts by hash counts leave a task.
COUNTED, PARTS = ("word", "id1", "id2", "id3"), 1 << 10
#: Windows of a row at most.
WINDOWS = 6144
#: Counts that are added up at once, if their part allows.
SUM_ROWS = 1 << 21


def packed(values: np.ndarray) -> bytes:
    """64-bit integers, compressed with their low 16 bits first and their high ones last."""
    return pa.compress(values.astype(np.int64).view(np.uint16).reshape(-1, 4).T.tobytes(), "lz4_raw", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "lz4_raw"), np.uint16)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int64).ravel()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; sorts ``keys``."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


def pack(docs: DataFrame, vocab: tuple[str, str]) -> DataFrame:
    """Counts and windows of the training rows (``text``, ``pick``), many to a row.

    word, id1, id2, id3: the keys of a part and their counts (``count`` of each, packed
    in the column of the kind) in a task's chunk, with the part as key; window: ids, and
    where the windows of each round start.
    """
    schema = pa.schema({"kind": pa.string(), "key": pa.int64(), "count": pa.int64(), **dict.fromkeys(COUNTED, pa.binary()),
                        "ids": pa.binary(), "at": pa.list_(pa.list_(pa.int32()))})

    def batch(**columns):
        n = len(columns["kind"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def block(kind, keys, counts):
        group = keys >> 16 if kind == "id3" else keys
        part = (group.view(np.uint64) * _MIX >> np.uint64(65 - PARTS.bit_length())).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        part, keys, counts = part[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
        for k in range(0, len(cuts) - 1, 256):
            own = list(zip(cuts[k:k + 256], cuts[k + 1:k + 257]))
            yield batch(kind=[kind] * len(own), key=[int(part[a]) for a, _ in own], count=[z - a for a, z in own],
                        **{kind: [packed(np.concatenate([keys[a:z], counts[a:z]])) for a, z in own]})

    def run(batches):
        words = Words(vocab, forget=False)  # rows are counted, so they may change at a flush only
        met: list[np.ndarray] = []
        streams: list[np.ndarray] = []
        size = 0

        def flush():
            c = np.bincount(np.concatenate(met), minlength=len(words.hashes))
            yield from block("word", words.hashes[c > 0], c[c > 0])
            if len(words.hashes) > words.LIMIT:
                words.clear()
            s = np.concatenate(streams)
            c = np.bincount(s, minlength=PAD + 1)[:PAD]
            yield from block("id1", np.flatnonzero(c), c[c > 0])
            for n, least in ((2, LOCAL_PAIR), (3, LOCAL_TRIPLE)):  # the arrays are large: few at a time
                keys, real = np.zeros(len(s) - n + 1, np.int64), np.ones(len(s) - n + 1, bool)
                for k in range(n):
                    part = s[k:len(s) - n + 1 + k]
                    keys <<= 16
                    keys |= part
                    real &= part != PAD
                keys = keys[real]
                del real
                keys, c = counted(keys)
                yield from block(f"id{n}", keys[c >= least], c[c >= least])

        edge = np.array([PAD, START], np.uint16)
        for b in pieces(batches, "text", 4 << 20):
            rows, counts = words.of_texts(b.column("text"))
            ids = words.subwords_of(rows, counts)
            met.append(rows)
            for s in ids:
                streams += [edge, s]
                size += len(s)
            flat, starts, owner = stream(ids, b.column("pick").to_pylist())
            turn = (np.arange(len(starts)) + owner) % ROUNDS
            for k in range(0, len(starts), WINDOWS):
                own, when = starts[k:k + WINDOWS], turn[k:k + WINDOWS]
                yield batch(kind=["window"], ids=[flat[own[0]:own[-1] + CONTEXT + SCORED + 1].tobytes()],
                            at=[[own[when == t] - own[0] for t in range(ROUNDS)]])
            if size > CHUNK:
                yield from flush()
                met, streams, size = [], [], 0
        if streams:
            yield from flush()

    return docs.select("text", "pick").mapInArrow(
        tidy(run), f"kind string, key long, count long, {', '.join(f'{k} binary' for k in COUNTED)}, ids binary, at array<array<int>>")


def summed(gathered: DataFrame, kind: str) -> DataFrame:
    """(key, count) of all blocks of a kind: every key once, with its whole count."""
    def run(batches):
        part, keys, counts, n, most = None, [], [], 0, SUM_ROWS

        def total():
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[first], np.add.reduceat(c, first)

        for b in batches:
            for key, count, data in zip(*(b.column(x).to_pylist() for x in ("key", "count", kind))):
                if n >= SUM_ROWS and key != part:  # a part's keys are in no other
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["key", "count"])
                    keys, counts, n, most = [], [], 0, SUM_ROWS
                elif n >= most:
                    k, c = total()
                    keys, counts, n = [k], [c], len(k)
                    most = max(SUM_ROWS, 2 * n)
                both = unpacked(data, 2 * count)
                keys.append(both[:count])
                counts.append(both[count:])
                part, n = key, n + count
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total()], ["key", "count"])

    return (gathered.where(F.col("kind") == kind).select("key", "count", kind).repartition("key").sortWithinPartitions("key")
            .mapInArrow(tidy(run), "key long, count long"))


def gather(docs: DataFrame, vocab: tuple[str, str]) -> DataFrame:
    """Counts and windows of the training rows (``text``, ``pick``), in rows of five kinds.

    word: (hash, count); id1, id2, id3: (key, count) of ids, pairs, triples, each key
    once; window: ids as bytes, with the round that takes it as key. A plan that asks
    for one kind, or one round's windows, derives only that.
    """
    rows, width = saved(pack(docs, vocab), "gathered"), 2 * (CONTEXT + SCORED + 1)
    views = []
    for turn in range(ROUNDS):
        each = rows.where("kind = 'window'").select("ids", F.explode(F.col("at")[turn]).alias("start"))
        views.append(each.select(F.lit("window").alias("kind"), F.lit(turn).cast("long").alias("key"), F.lit(None).cast("long").alias("count"),
                                 F.expr(f"substring(ids, 2 * start + 1, {width})").alias("ids")))
    for kind in COUNTED:
        views.append(summed(rows, kind).select(F.lit(kind).alias("kind"), "key", "count", F.lit(None).cast("binary").alias("ids")))
    return functools.reduce(DataFrame.unionAll, views)


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) arrays of at most ``most`` rows, the most frequent, whole counts at a time."""
    sizes = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = 1 << 62, 0
    for c, k in sizes:
        if n + k > most:
            break
        least, n = c, n + k
    got = counts.where(F.col("c") >= least).select("key", "c").toArrow()
    keys, c = (got.column(x).to_numpy().astype(np.int64) for x in ("key", "c"))
    order = np.argsort(keys)
    return keys[order], c[order]


def train(gathered: DataFrame, shared) -> np.ndarray:
    """Parameters after all rounds; ``shared`` is a broadcast of (single, arrays of the memory, words)."""
    theta = Attention(shared.value[0]).theta
    for turn in range(ROUNDS):
        def run(batches, theta=theta):
            single, memory, _ = shared.value
            memory = Memory.of(memory)
            model = Attention(single, theta.copy())
            past = model.views(np.full(len(theta), 1e-6, np.float32))
            used = 0
            for b in batches:
                size = 2 * (CONTEXT + SCORED + 1)
                w = np.frombuffer(b.column("ids").cast(pa.binary(size)).buffers()[1], np.uint16)[:b.num_rows * size // 2].reshape(b.num_rows, -1)
                counted = memory.of_windows(w, itself=True)
                for k in range(0, len(w), STEP):
                    model.step(w[k:k + STEP], memory, past, counted[k:k + STEP])
                used += len(w)
            if used:
                yield pa.RecordBatch.from_arrays([pa.array([model.theta.tobytes()], pa.binary()), pa.array([float(used)])], ["theta", "used"])

        done = gathered.where((F.col("kind") == "window") & (F.col("key") == turn)).select("ids").mapInArrow(tidy(run), "theta binary, used double")
        sums = done.rdd.map(lambda r: (np.frombuffer(r["theta"], np.float32) * np.float32(r["used"]), r["used"]))
        add = lambda a, x: (a[0] + x[0], a[1] + x[1])
        total = sums.treeAggregate((np.float32(0), 0.0), add, add, 2)
        if total[1]:
            theta = (total[0] / total[1]).astype(np.float32)
    return theta


def score_texts(docs: DataFrame, vocab, shared, theta: np.ndarray) -> DataFrame:
    """``docs`` without ``text``, with row, n_tokens, base_known (log10 sum), n_sent, rare hashes, score."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        single, memory, common = shared.value
        memory = Memory.of(memory)
        words = Words(vocab, common)
        model = Attention(single, theta.copy())
        number = TaskContext.get().partitionId() << 40
        for b in pieces(batches, "text", 2 << 20):
            rows, counts = words.of_texts(b.column("text"))
            ids = words.subwords_of(rows, counts)
            w, owner = windows(ids)
            p = np.empty((len(w), SCORED), np.float32)
            n = len(counts)
            for k in range(0, len(w), 1024):
                counted = memory.of_windows(w[k:k + 1024])
                for j in range(k, min(k + 1024, len(w)), BLOCK):
                    p[j:j + BLOCK] = model.probability(w[j:j + BLOCK], memory, counted=counted[j - k:j - k + BLOCK])[0]
            lp = np.where(w[:, CONTEXT + 1:] == PAD, np.float32(0), np.log10(np.maximum(p, 1e-30))).sum(axis=1, dtype=np.float64)
            log = np.bincount(owner, lp, n)
            owner = np.repeat(np.arange(n), counts)
            c = words.known.take(rows)
            base = np.bincount(owner, np.log10(np.maximum(c, 0) + 1.0), n)
            sent = np.bincount(owner, c > 0, n).astype(np.int64)
            rare = np.concatenate([[0], np.cumsum(np.bincount(owner[c < 0], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in rest), pa.array(np.arange(number, number + n)),
                 pa.array(counts + 1), pa.array(base), pa.array(sent),
                 pa.ListArray.from_arrays(pa.array(rare), pa.array(words.hashes.take(rows[c < 0]))), pa.array(log)],
                [*rest, "row", "n_tokens", "base_known", "n_sent", "rare", "score"])
            number += n

    more = StructType.fromDDL("row long, n_tokens long, base_known double, n_sent long, rare array<long>, score double")
    return docs.mapInArrow(tidy(run), StructType([*docs.select(*rest).schema.fields, *more.fields]))


def lm_scores(docs: DataFrame, text: str = "text", row_id: str = "doc_id", held_out=None,
              vocab: tuple[str, str] | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a condition on the rows that are not learned from; by default
    crc32(id) mod 7 is 2.
    """
    vocab = vocab or vocabulary()
    crc = F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    held_out = crc % 7 == 2 if held_out is None else held_out
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"), held_out.alias("held_out"),
                       (crc % WINDOW_RATE).cast("int").alias("pick"))
    learn = rows.where(~F.col("held_out"))
    gathered = gather(learn, vocab)
    counts = lambda kind, name: saved(gathered.where(F.col("kind") == kind).select("key", F.col("count").alias("c")), name)
    words = counts("word", "words")
    single = most_frequent(counts("id1", "ids"), IDS)
    ends = int(single[1][single[0] == END].sum())
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    memory = Memory(single, most_frequent(counts("id2", "pairs"), PAIR_SLOTS), most_frequent(counts("id3", "triples"), TRIPLE_SLOTS))
    shared = docs.sparkSession.sparkContext.broadcast((single, memory.arrays(), most_frequent(words, WORDS)))
    theta = train(gathered, shared)
    scored = saved(score_texts(rows.drop("pick"), vocab, shared, theta), "scored")
    shared.unpersist()
    rare = (scored.select("row", F.explode("rare").alias("key")).join(words, "key", "left")
            .groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"), F.count("c").alias("met")))
    zero = F.lit(0)
    return (scored.join(rare, "row", "left")
            .select("id", "held_out", "n_tokens",
                    (F.col("n_sent") + F.coalesce("met", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("base_known") + F.coalesce("more", F.lit(0.0)) + F.log10(F.lit(float(ends + 1)))
                     - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score"))


def op1_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs).withColumnRenamed("id", "doc_id")
