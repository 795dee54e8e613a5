import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from ticketloom.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", "a", " ", "  ", "   x  y", "a\n\n b", "a  \n", "\n a", "a \n b", "it's I'LL 're", "x\x1c\x1cy", "a　b  c", " \t x", "é ü", "abc" * 50,
    "\r\n\r\n  z", "1 22  333", "a\x85 b", "end ", "   q", "<|endoftext|>", "日本語 テキスト", "\U0001f600 \U0001f600", "nul\x00 byte", "a" * 1500,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tokenizer(PATH, P.PATTERN).ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = "abcdefghij ABC  \n\t'.,!0123éß日 "
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(400)]


def test_ids_equal_the_library(library):
    own = bpe.tokenizer(PATH, P.PATTERN)
    given = texts()
    for text, ids in zip(given, own.encode(given)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or ""), repr(text)


def long_pieces():
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    mixed = "".join(rng.choice("etaoin") for _ in range(3_000))
    return [
        word, "=" * 20_001, "-=" * 5_000, "abc" * 7_001, "abcdefg" * 3_000, "a" * 9_999, "日本語" * 2_000, " " * 30_000 + "x",
        "".join(rng.choice("日本語中文字") for _ in range(5_000)), mixed + "=" * 3_000 + mixed, (mixed[:301] + "!") * 9, "\u00e9" * 4_000, mixed * 3,
    ]


@pytest.mark.parametrize("window", [8, bpe.WINDOW])
def test_long_pieces_equal_the_library(library, monkeypatch, window):
    """Whatever the windows, and whether or not tokens repeat in their step."""
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe.Tokenizer.join, "__defaults__", (window,))
    own = bpe.Tokenizer(PATH, P.PATTERN)
    given = [t if window > 8 else t[:1_000] for t in long_pieces()]
    for text, ids in zip(given, own.encode(given)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:20]
    assert own.decode(own.encode(given[:3])) == [t.encode() for t in given[:3]]


def test_round_trip():
    own = bpe.tokenizer(PATH, P.PATTERN)
    given = texts()
    assert own.decode(own.encode(given)) == [(t or "").encode() for t in given]
    assert own.decode([]) == [] and own.encode([]) == []


def test_a_full_store_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORED", 5)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 50)
    own = bpe.Tokenizer(PATH, P.PATTERN)
    for text in texts()[:60]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text or "")


def test_query_on_odd_rows(spark, tmp_path, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "again", "x"), (3, "again", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_byte_bpe(spark, str(tmp_path)).collect()}
    expected = set()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        expected.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_and_decode(docs, PATH, P.PATTERN).count() == 0
