import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ticketloom.llm import queries, token_files, wavelet

PATH = P.path("word_bpe_49k.json")


def shard(tokens, lengths=None):
    lengths = [len(tokens)] if lengths is None else lengths
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(lengths)), pa.int64()), pa.array(lengths, pa.int64())], ["id", "length"])
    return wavelet.Shard(io.BytesIO(wavelet.build(np.array(tokens, np.uint32), docs)))


@pytest.mark.parametrize("size, top", [(0, 1), (1, 1), (1, 70_000), (5, 2), (1000, 3), (32_768, 300), (100_001, 49_408), (70_000, 1 << 32)])
def test_access_rank_and_select_against_the_plain_sequence(size, top):
    rng = np.random.default_rng(size + 1)
    tokens = (rng.random(size) ** 4 * top).astype(np.uint32)
    own = shard(tokens)
    assert (own.tokens() == tokens).all() and len(own.tokens()) == size
    at = rng.integers(0, size, 200) if size else np.zeros(0, int)
    assert (own.access(at) == tokens[at]).all()
    for token in {*tokens[:5].tolist(), 0, top - 1, top + 5}:
        where = np.flatnonzero(tokens == token)
        assert own.count(token) == len(where)
        assert (own.find(token) == where).all() and len(own.find(token)) == len(where)
        low, high = sorted(rng.integers(0, size + 1, 2).tolist())
        assert own.count(token, low, high) == ((where >= low) & (where < high)).sum()
        assert own.find(token, low, high).tolist() == where[(where >= low) & (where < high)].tolist()
    with pytest.raises(IndexError):
        own.access([size])


def test_file_is_compressed_and_checked():
    data = wavelet.build(np.zeros(1_000_000, np.uint16), pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1_000_000])], ["id", "length"]))
    assert len(data) < 10_000
    with pytest.raises(ValueError):
        wavelet.Shard(io.BytesIO(b"x" * 200))


def texts():
    rng = np.random.default_rng(5)
    words = ["Straße", "IT'S", "日本語", "é", "́", "a\x85b", "x y", " ", "12,345", "<|endoftext|>", "ﬁ", "Σας", "\x1c", "​", "'ll", "I'LL", "İ", "..."]
    gaps = [" ", "\n\n", "\t", "\x0b", "\x0c", "\r\n", "  "]
    return ["".join(w + g for w, g in zip(rng.choice(words, n), rng.choice(gaps, n))) for n in rng.integers(0, 30, 200)]


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_one_by_one_give_the_ids_of_whole_texts():
    given = [*texts(), None, "", " \n ", "a" * 5000, "a.b,c(d)!!e 12.5%x --y_z", "x.'s y'.t it's.", "a…b.c", "À.é,ÿ÷x"]
    t = library()
    for offset in (0, 3):  # a slice of a batch keeps its offset
        got = token_files.Ids(PATH).encode(pa.array(given).slice(offset))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in given[offset:]]


def test_written_files_read_back_whole(spark, tmp_path):
    given = [*texts(), None, "", "long words here " * 40_000]
    rng = np.random.default_rng(2)
    names = rng.permutation(len(given) * 3)[: len(given)].tolist()
    rows = [(k, x, "clash", 7) for k, x in zip(names, given)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    t, at, want = library(), 0, {}
    for k, x in sorted(zip(names, given)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = queries.op12_wavelet_tokens(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_search_in_the_files(spark, tmp_path):
    given = [f"alpha beta {'alpha ' * (k % 4)}gamma" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(4)
    shards = token_files.write(docs, PATH, f"{tmp_path}/tokens", shard=20)
    assert shards.count() > 8  # several shards a task
    again = token_files.manifest(spark, f"{tmp_path}/tokens")
    t = library()
    alpha, gamma = (t.encode(w, add_special_tokens=False).ids[0] for w in ("alpha", "gamma"))
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in given]
    flat = [x for row in ids for x in row]
    assert {r.token: r.n for r in token_files.counts(again, [alpha, gamma, 1, 40_000]).collect()} == {x: flat.count(x) for x in (alpha, gamma, 1, 40_000)}
    found = sorted((r.token, r.id, r.position, r.place) for r in token_files.occurrences(again, [alpha, 1]).collect())
    starts = np.cumsum([0, *map(len, ids)])
    assert found == sorted((x, d, p, starts[d] + p) for d, row in enumerate(ids) for p, x in enumerate(row) if x in (alpha, 1))


def test_empty_table_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    shards = token_files.write(empty, PATH)
    assert shards.count() == 0 and token_files.read(shards).count() == 0 and token_files.counts(shards, [1]).count() == 0
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (3, None)], "doc_id long, text string")
    rows = token_files.read(token_files.write(docs, PATH)).collect()
    assert sorted((r.id is not None, r.id or 0, r.n_tokens) for r in rows) == [(False, 0, 2), (True, 3, 1), (True, 3, 2), (True, 3, 2)]
    assert min(r.start for r in rows if r.id is None) == 0
