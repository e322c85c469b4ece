"""BPE and token counts: exact against the libraries, on random and odd texts."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cytoframe.llm import bpe, token_count
from cytoframe.llm.settings import tokenizer_path

ODD = [*"aaabbeett  \n\t'sSdlrevm0²½ⅧéÊ漢か😀_-–…*&\x1c\x85\xa0 　▁\x00́.,!|", "<|endoftext|>", "<s>", "the ", "ing", "    ", "\r\n"]


def texts():
    r = random.Random(2)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    return [*made, "", " ", "a" * 3000, " " * 999, "ab" * 700, "\n" * 300 + "x", "".join(map(chr, range(0x20, 0x2000)))]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_and_text(tokenizer):
    own = bpe.vocabulary(tokenizer_path("byte_bpe_50k.json"))
    for t in texts():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        code = own.encode(t)
        assert np.frombuffer(code, "<u4").tolist() == ids, t[:80]
        assert own.decode(code) == tokenizer.decode(ids, skip_special_tokens=False) == t


def test_the_cache_may_empty(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 4)
    monkeypatch.setattr(bpe, "WORDS", 2)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    own = bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    t = "one two three four five six seven one two three"
    assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encode_documents(spark, tokenizer):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x<|endoftext|>y"), (1, "a b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_documents(df, with_ids=True).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        code = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(code).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_counts_match_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    own = token_count.counter(tokenizer_path("piece_bpe_32k.model"))
    for t in texts():
        assert own.count(t) == len(model.encode(t)), t[:80]


def test_whole_tokens_are_proven():
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    own = token_count.counter(tokenizer_path("piece_bpe_32k.model"))
    some = sorted(p for p in own.whole if p.startswith("▁") and p.count("▁") == 1 and p != "▁")[::97]
    assert len(some) > 100 and all(model.encode(p[1:], out_type=str) == [p] for p in some)


def test_count_documents(spark):
    df = spark.createDataFrame([(1, "hé"), (2, None), (3, "word " * 5000), (3, ""), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(df).collect())
    assert got[1][1] == 3 and (2, 0, 0, False) in got and (3, 0, 0, False) in got and any(g[0] == 3 and g[3] for g in got)
    assert token_count.count_tokens(df.limit(0)).collect() == []
