import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from carelog.llm import bpe


def test_same_as_the_tokenizers_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.Bpe(path)
    rng = random.Random(5)
    parts = [*"ab  \n\t\r'sStre019é ñ中😀\x1c\x85  |$#<>\x00", "<|endoftext|>", "<|end", "aaaa", "ing", "'ll", " ", "  ", "́", "ſ", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["", "a" * 4000, " " * 100]
    for text, ids, want in zip(texts, ours.encode(texts), theirs.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text
        assert ours.decode(ids) == theirs.decode(want.ids, skip_special_tokens=False) == text


def test_words_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 2)
    ours = bpe.Bpe(bpe.vocabulary())
    first = [x.tolist() for x in ours.encode(["some words here", "more of them"])]
    assert [x.tolist() for x in ours.encode(["some words here", "more of them"])] == first


def test_digests_and_round_trip(odd_docs, no_docs):
    got = bpe.round_trip_digests(odd_docs).collect()
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd_docs.collect())
    assert sorted(r["decoded_sha256"] for r in got) == want
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {0}
    back = bpe.decode_ids(bpe.encode_texts(odd_docs.select("doc_id", "text", "kept")), "ids").collect()
    assert all((r["text"] or "") == r["decoded"] for r in back) and len(back) == odd_docs.count()
    assert bpe.round_trip_digests(no_docs).count() == 0
