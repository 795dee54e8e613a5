import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from ticketloom.llm import packing, queries

PATH = P.path("byte_bpe_50k.json")


def test_hilbert_is_a_walk_through_all_cells():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def texts():
    return [None, "", "one", "  two   spaces \n\n here ", "é日本 \U0001f600", "word " * 9000, "same text"] + ["same text"] * 5 + [f"text number {k} " * (k % 40) for k in range(200)]


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_every_id_once_and_sequences_full(spark, tmp_path):
    given = texts()
    rows = [(k, t, 0) for k, t in enumerate(given)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = queries.op4_hilbert_packing(spark, str(tmp_path)).collect()
    t = library()
    ids = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for k, x in enumerate(given)}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.length > 0 and p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        of_doc[p.doc_id].append((p.start, p.length))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    for k, own in ids.items():
        at = 0
        for start, length in sorted(of_doc[k]):
            assert start == at
            at += length
        assert at == len(own)
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded


def test_same_ids_as_the_library():
    own, t = packing.tokenizer(PATH, P.PATTERN), library()
    given = [*texts()[:12], "<|endoftext|> a<|endoftext|>", "it's I'LL\t x", "a\x85b \x1c c", "12 345  6"]
    for text, ids in zip(given, map(own.encode, given)):
        assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1], text


def test_long_runs_of_white_space():
    """Equal to the library where it manages the run, and to its pieces where it does not."""
    own, t = packing.tokenizer(PATH, P.PATTERN), library()
    for gap in (" ", "\n", " \n\t\x0b", "\u3000 ", "\x85"):
        run = (gap * 12_000)[:12_000]
        for text in (run, f"a{run}", f"{run}b", f"a{run}b {run}\n{run}c", f"x{run}'s{run}1{run}!"):
            assert own.encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], (gap, text[:2])
    ids = own.encode("a" + " " * 2_000_000 + "b")
    assert bytes(own.encoding.decode_bytes(ids[:-1].tolist())) == b"a" + b" " * 2_000_000 + b"b"
    assert ids[:1].tolist() == t.encode("a", add_special_tokens=False).ids and ids[-2:-1].tolist() == t.encode(" b", add_special_tokens=False).ids


def test_neighbours_are_alike(spark):
    rows = [(k, ("alpha beta gamma " if k % 2 else "uno dos tres quatre ") * 40) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack(docs.coalesce(1), PATH, P.PATTERN).collect()
    mixed = defaultdict(set)
    for p in found:
        mixed[p.sequence_id].add(p.id % 2)
    assert sum(len(kinds) > 1 for kinds in mixed.values()) <= 8


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH, P.PATTERN).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sum(p.length for p in packing.pack(docs, PATH, P.PATTERN).collect()) == 3 * 3 + 1
