"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

A text is cut into pieces by the tokenizer's pattern. A piece that is a token is done; each other distinct piece of a batch is
a word of token-position rows, one for each byte. The recursive query joins neighbours with the merge table, contracts each
word's leftmost pair of minimum rank, and ends when no word has a pair left. The last rows in order are the ids; an ordered join
with the vocabulary gives their bytes, whose column is the decoded text.

A word of n letters takes up to n rounds, so a long unbroken piece is read in overlapping windows, each a word of its own, and put
together where two windows agree on a token (`Tokenizer.join`). The ids are those of the whole piece: contracting goes by rank and
then by place, so a list of tokens is a text's encoding exactly if each two neighbours are the encoding of their own letters.

Words that occur again, in the same batch or in another one of the same worker, are looked up instead of contracted again
(the store is emptied at `STORED` words; it saves work and never changes a result).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces

#: Bytes of words in one recursive query, and the sum of their squared lengths (rows over all rounds).
QUERY_BYTES, QUERY_ROWS = 400_000, 6_000_000
#: Bytes of a window of a long piece; the next one begins half a window later. Pieces of up to two windows are one word.
WINDOW = 128
#: Words, and pieces of words, whose ids a worker keeps.
STORED = 300_000

#: Each row knows its right neighbour, so that a round needs no sort: the row of the left half takes the merged token and the
#: neighbour beyond the right half, the row before it sees the merged token, and the right half's row goes.
ENCODE = """
WITH RECURSIVE step AS (
    SELECT 0 AS round, word, pos, token, lead(token) OVER w AS after, lead(pos) OVER w AS after_pos
    FROM letters WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    (
        WITH least AS (
            SELECT word, min(merged * 4294967296 + pos) AS best, arg_min(after_pos, merged * 4294967296 + pos) AS gone
            FROM step JOIN merges ON token = first AND after = second GROUP BY word
        ), pair AS (
            SELECT l.word, best // 4294967296 AS merged, best % 4294967296 AS here, gone, s.after AS beyond, s.after_pos AS beyond_pos
            FROM step s JOIN least l ON s.word = l.word AND s.pos = l.gone
        )
        SELECT round + 1, s.word, pos, CASE WHEN pos = here THEN merged ELSE token END,
            CASE WHEN pos = here THEN beyond WHEN after_pos = here THEN merged ELSE after END,
            CASE WHEN pos = here THEN beyond_pos ELSE after_pos END
        FROM step s JOIN pair p ON s.word = p.word WHERE pos <> gone
    )
), last AS (SELECT word, max(round) AS round FROM step GROUP BY word)
SELECT s.word, token FROM step s JOIN last l ON s.word = l.word AND s.round = l.round ORDER BY s.word, pos
"""
#: In the order of the tokens, the letters' column is the decoded texts one after another.
DECODE = "SELECT letters FROM ids JOIN vocabulary USING (token) ORDER BY pos"


class Tokenizer:
    """Encoder and decoder of one vocabulary file (ranks of byte strings) and its pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern, self.runs = regex.compile(pattern), regex.compile(r" \s")
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.size = np.zeros(max(self.bytes) + 1, np.int64)
        self.size[list(self.bytes)] = [len(t) for t in self.bytes.values()]
        self.letter = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("SET enable_progress_bar = false")
        self.db.execute("SET temp_directory = ''")  # QUERY_ROWS bounds a query's memory: nothing is spilled to a local folder
        # DuckDB is given the tables once; the merge table has a row for each way to put a token together of two others
        halves = [
            (self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        first, second, merged = (pa.array(c, t) for c, t in zip(zip(*halves), (pa.int32(), pa.int32(), pa.int64())))
        merges = pa.table({"first": first, "second": second, "merged": merged})
        vocabulary = pa.table({"token": pa.array(self.bytes, pa.int32()), "letters": pa.array(self.bytes.values(), pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")

    # -- encoding

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by the recursive query, in groups of about QUERY_BYTES. Words of a group have like lengths."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        group = np.cumsum(np.maximum(size[order] * QUERY_ROWS // QUERY_BYTES, size[order] ** 2)) // QUERY_ROWS
        for g in np.unique(group):
            at = order[group == g]
            some, length = [words[i] for i in at], size[at]
            letters = self.letter[np.frombuffer(b"".join(some), np.uint8)]
            word = np.repeat(np.arange(len(some), dtype=np.int32), length)
            pos = (np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
            self.db.register("letters", pa.table({"word": word, "pos": pos, "token": letters}))
            rows = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("letters")
            flat = rows.column("token").to_numpy().astype("<u4").tobytes()
            cuts = [0, *(4 * (np.flatnonzero(np.diff(rows.column("word").to_numpy())) + 1)).tolist(), len(flat)]
            for i, a, b in zip(at.tolist(), cuts, cuts[1:]):
                out[i] = flat[a:b]
        return out

    def spans(self, ids: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and where each of them begins, with the end of the last one."""
        tokens = np.frombuffer(ids, "<u4")
        return tokens, start + np.concatenate([[0], np.cumsum(self.size[tokens])])

    def join(self, letters: bytes, known: dict[bytes, bytes], wide: int = WINDOW) -> bytes:
        """Ids of a long piece from windows of `wide` bytes; those in `known` are looked up.

        Where two windows have a token at the same place, the left one is followed up to it and the right one from it on: each
        two neighbours then stand together in one of the windows. A window without such a token (tokens that repeat in another
        step than the windows do) begins at a token of the left one instead; if that does not help, windows are doubled.
        """
        if wide >= len(letters):
            return self.contract([letters])[0]
        stride = wide // 2
        grid = {letters[k : k + wide] for k in range(0, len(letters), stride)} - known.keys()
        known.update(zip(grid, self.contract(list(grid))))

        def window(start: int) -> tuple[np.ndarray, np.ndarray]:
            part = letters[start : start + wide]
            if part not in known:
                known[part] = self.contract([part])[0]
            return self.spans(known[part], start)

        out: list[bytes] = []
        tokens, places = window(0)
        while (last := int(places[-1])) < len(letters):
            on_grid = (last - stride) // stride * stride
            at_token = int(places[np.searchsorted(places, last - stride, side="right") - 1])
            for follow in (on_grid, at_token):
                if follow <= last - wide or follow < places[0]:
                    continue
                more, at = window(follow)
                same, left, right = np.intersect1d(places[:-1], at[:-1], assume_unique=True, return_indices=True)
                if len(equal := np.flatnonzero(tokens[left] == more[right])):
                    k = equal[0]
                    out.append(tokens[: left[k]].astype("<u4").tobytes())
                    tokens, places = more[right[k] :], at[right[k] :]
                    break
            else:
                return self.join(letters, known, 2 * wide)
        out.append(tokens.astype("<u4").tobytes())
        return b"".join(out)

    def encode_pieces(self, found: list[bytes]) -> list[bytes]:
        """Ids of each piece; those of more than two windows are put together from windows."""
        words = {p for p in found if len(p) <= 2 * WINDOW}
        words.update(p[k : k + WINDOW] for p in found if len(p) > 2 * WINDOW for k in range(0, len(p), WINDOW // 2))
        distinct = list(words)
        known = dict(zip(distinct, self.contract(distinct)))
        return [known[p] if len(p) <= 2 * WINDOW else self.join(p, known) for p in found]

    def learn(self, words: list[str]) -> None:
        """Put the ids of these words (with their leading white space) into the store."""
        if len(self.pieces) > STORED:
            self.pieces.clear()
        findall, known, stored = self.pattern.findall, self.pieces, self.words
        cut = [findall(w) for w in words]
        fresh = list(set(chain.from_iterable(cut)) - known.keys())
        letters = [p.encode("utf-8", "surrogatepass") for p in fresh]
        ranks = list(map(self.ranks.get, letters))
        known.update((p, r.to_bytes(4, "little")) for p, r in zip(fresh, ranks) if r is not None)
        known.update(zip([p for p, r in zip(fresh, ranks) if r is None], self.encode_pieces([b for b, r in zip(letters, ranks) if r is None])))
        for word, found in zip(words, cut):
            stored[word] = known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])

    def cut(self, text: str) -> list[str]:
        """Words that can be encoded apart: no piece reaches over a space that follows and precedes other characters."""
        if not text:
            return []
        if self.runs.search(text):  # runs of white space: cut where white space begins
            return regex.findall(r"\s*\S+|\s+", text)
        head, *rest = text.split(" ")
        return [*([head] if head else []), *[" " + w for w in rest]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t or "") for t in texts]
        needed = set(chain.from_iterable(cut))
        if len(self.words) > STORED:
            self.words.clear()
        if new := needed - self.words.keys():
            self.learn(list(new))
        found = self.words.__getitem__
        return [b"".join(map(found, words)) for words in cut]

    # -- decoding

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        self.db.register("ids", pa.table({"pos": np.arange(len(flat), dtype=np.int32), "token": flat}))
        letters = self.db.sql(DECODE).to_arrow_table().column("letters").combine_chunks()
        self.db.unregister("ids")
        ends = np.frombuffer(letters.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        data = letters.buffers()[2].to_pybytes() if len(flat) else b""
        cuts = ends[np.concatenate([[0], np.cumsum(size)])]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of the whole text as little-endian unsigned 32-bit integers, and the bytes they stand for.

    `path` names the vocabulary file, which every executor has at the same place. A null text counts as empty and has no
    ids. Repeated rows give repeated results, an empty table an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in pieces(batches, limit=8_000_000):
            ids = own.encode(column(batch, "text"))
            for at in range(0, len(ids), 256):
                some = ids[at : at + 256]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(some, pa.binary()), pa.array(own.decode(some), pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")


