"""Token ids of a corpus in sharded binary files, each the wavelet matrix of its documents' ids.

Documents are tokenised where they are read, dealt out by ranges of their id (bounds from a sample of the ids) and sorted; each
task writes shards of about `SHARD` ids. A shard is written under a name of its own, and only names that a finished task
returned enter the manifest, so that a repeated or lost task leaves no trace in it. Files are reached through pyarrow's file
systems (local and shared folders, HDFS, S3, GCS), by the folder's address.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..operators.scale import running_sum
from ..session import shared_dir
from .common import pieces
from .wavelet import Shard, build

END = 1  # the id after each document
SHARD = 1 << 22
MANIFEST = "part int, shard int, file string, docs long, tokens long, bytes long"
#: Distinct words, and distinct pieces, whose ids a worker remembers.
REMEMBERED = 700_000


#: Words of these characters alone have the same letters before and after normalisation, but for their case.
_PLAIN = re.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
#: The tokenizer file's own split pattern for such words (a fixed value, letters and digits written out).
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
#: Texts of plain words without an apostrophe: there a run of other signs is a piece of its own, wherever it stands.
_PLAIN_TEXT = "^[\t-\r -&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*$"
_SIGNS = r"[!-&(-/:-@\[-`{-~]+"


class _Pieces(dict):
    """Ids of lower-case pieces, by the library's merges; each piece is merged once."""

    def __init__(self, library: Tokenizer, kind: np.dtype):
        super().__init__()
        self.merge, self.kind = library.model.tokenize, kind
        # the file writes bytes that are no visible character as code points from 256 on
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: 256 + k for k, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        ids = self[piece] = np.array([t.id for t in self.merge(letters)], self.kind).tobytes()
        return ids


class Ids:
    """Ids of whole texts by a tokenizer file that lower-cases and drops white space.

    Each word between ASCII blanks is looked up once. Plain words are cut into the file's pieces, whose merges the library does
    once a piece; all others go to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        top = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.pieces = _Pieces(self.library, self.kind)

    def _learn(self, words: list[str]) -> None:
        others = []
        for word in words:
            if _PLAIN.fullmatch(word):
                self.known[word] = b"".join(map(self.pieces.__getitem__, _SPLIT.findall(word.lower())))
            else:
                others.append(word)
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            for word, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                self.known[word] = np.array(found.ids, self.kind).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text, the end id last; null is empty."""
        texts = pc.fill_null(texts, "")
        apart = pc.replace_substring_regex(texts, _SIGNS, r" \0 ")  # so "word," and "word" are one word to look up
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _PLAIN_TEXT), apart, texts))
        lists = words.cast(pa.large_list(pa.string()))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for held in (self.known, self.pieces):
            if len(held) > REMEMBERED:
                held.clear()
        self._learn([w for w in distinct if w not in self.known])
        parts = list(map(self.known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(parts), self.kind)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        first = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        length = size[code]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat(first[code] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        end = np.array([END], self.kind).tobytes()
        return [ids[a:b].tobytes() + end for a, b in zip(bounds, bounds[1:])]


@cache
def tokenizer(path: str) -> Ids:
    return Ids(path)


# ---- writing ------------------------------------------------------------------------------------------------------------


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(
    docs: DataFrame, path: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", shard: int = SHARD,
) -> DataFrame:
    """Write the ids of all texts, in order of the id column (whole numbers), as shards below `folder`; the manifest's rows.

    path: a tokenizer file that drops white space. folder: an address all executors reach; by default a new one in the
    session's shared folder. A null or empty text has the end id alone; a text of any length lies in one shard; a null id
    comes first; repeated ids keep all their rows, in any order among themselves; an empty table has an empty manifest; other
    columns are not read. The manifest is written beside the shards, in `folder`/manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    cuts = [k / deal for k in range(1, deal)]
    bounds = np.unique(np.array((source.agg(F.percentile_approx("id", cuts, 10 * deal)).first()[0] if cuts else None) or [], np.int64))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in pieces(batches, limit=16_000_000):
            ids = pc.fill_null(batch.column(0), -(1 << 63)).to_numpy()
            part = np.searchsorted(bounds, ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part), pa.array(own.encode(batch.column(1)), pa.binary())], ["id", "part", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _folder(folder)
        system.create_dir(base, recursive=True)
        task, kind = uuid.uuid4().hex, tokenizer(path).kind
        number = part = 0
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal names, parts, held, number
            data = b"".join(parts)
            listed = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(p) // kind.itemsize for p in parts], pa.int64())], ["id", "length"])
            ready = build(np.frombuffer(data, kind), listed)
            file = f"{part:06d}-{number:06d}-{task}.wavelet"
            with system.open_output_stream(f"{base}/{file}") as out:
                out.write(ready)
            row = (part, number, f"{folder}/{file}", len(names), len(data) // kind.itemsize, len(ready))
            names, parts, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3))], ["part", "shard", "file", "docs", "tokens", "bytes"])

        for batch in batches:
            for name, at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                size = len(ids) // kind.itemsize
                if names and (at != part or held + size > shard):
                    yield close()
                part, held = at, held + size
                names.append(name)
                parts.append(ids)
        if names:
            yield close()

    tokens = source.mapInArrow(tokenise, "id long, part int, ids binary")
    shards = tokens.repartitionById(deal, "part").sortWithinPartitions("part", "id").mapInArrow(save, MANIFEST)
    shards.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a written folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# ---- reading ------------------------------------------------------------------------------------------------------------


def _open(file: str) -> Shard:
    system, path = _folder(file)
    return Shard(system.open_input_file(path))


def _whole(file: str) -> Shard:
    """For reading all of a file: one request instead of one a plane."""
    system, path = _folder(file)
    with system.open_input_stream(path) as stream:
        return Shard(io.BytesIO(stream.read()))


def _placed(shards: DataFrame) -> DataFrame:
    """The manifest with the number of ids before each shard, one shard a task."""
    placed = running_sum(shards, [], ["part", "shard"], F.col("part"), F.col("tokens"), "after")
    return placed.select("file", (F.col("after") - F.col("tokens")).alias("before"))


def read(shards: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of every document from the files: ids are little-endian unsigned 32-bit integers, start the
    number of ids in all documents before it.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _whole(file)
                ids, names, sizes = own.tokens(), own.docs.column("id").combine_chunks(), own.docs.column("length").to_numpy()
                ends = np.concatenate([[0], np.cumsum(sizes)])
                step = max(1, int(1_000_000 * len(sizes) / max(1, len(ids))))  # about 4 MB a batch
                for at in range(0, len(sizes), step):
                    cut = ends[at : at + step + 1].tolist()
                    values = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(at, step), pa.array(before + ends[at : at + len(values)]), pa.array(sizes[at : at + step]), pa.array(values, pa.binary())],
                        ["id", "start", "n_tokens", "ids"],
                    )

    return _spread(shards).mapInArrow(load, "id long, start long, n_tokens long, ids binary")


def _spread(shards: DataFrame) -> DataFrame:
    deal = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _placed(shards).repartition(deal, "file")


def counts(shards: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """(token, n): how often each of these tokens occurs in all files; only a few blocks of each file are read."""
    wanted = sorted(set(tokens))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                own = _open(file)
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([own.count(t) for t in wanted], pa.int64())], ["token", "n"])

    return _spread(shards).mapInArrow(load, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, tokens: Iterable[int]) -> DataFrame:
    """(token, id, position, place): each occurrence, by its position in its document and its place in the corpus."""
    wanted = sorted(set(tokens))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _open(file)
                names = own.docs.column("id").combine_chunks()
                sizes = own.docs.column("length").to_numpy()
                starts = np.cumsum(sizes) - sizes
                for token in wanted:
                    at = own.find(token)
                    of = np.searchsorted(starts, at, "right") - 1  # no document is without an id
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), token)), names.take(pa.array(of)), pa.array(at - starts[of]), pa.array(before + at)],
                        ["token", "id", "position", "place"],
                    )

    return _spread(shards).mapInArrow(load, "token long, id long, position long, place long")
