"""Arrow batches of texts in slices of bounded size, and hashes of word runs over a slice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the words of a run, by place.
_PLACES = np.cumprod(np.full(64, 0x5851F42D4C957F2D, np.uint64))


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut where the bytes of column `text` pass a multiple of `limit`; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
        number = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(size)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


class WordRuns:
    """The words of a column of texts in which single blanks separate words, and the hash of each run of `width` words.

    `hashes[i]` belongs to the run that starts at word i of all words in order; `whole[i]` says whether the run lies in one text.
    """

    def __init__(self, texts: pa.Array, width: int):
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ").cast(pa.large_list(pa.string()))
        self.words = lists.flatten()
        offsets = lists.offsets.to_numpy()
        self.starts = offsets - offsets[0]
        coded = self.words.dictionary_encode()
        names = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        single = names[coded.indices.to_numpy()] if len(self.words) else np.zeros(0, np.uint64)
        n = max(0, len(single) - width + 1)
        mixed = sum((single[k : k + n] * _PLACES[k] for k in range(width)), np.zeros(n, np.uint64))
        self.hashes = (mixed ^ mixed >> np.uint64(29)).view(np.int64)
        ends = np.repeat(self.starts[1:], np.diff(self.starts))[:n]
        self.whole = np.arange(n) + width <= ends

    def text_of(self, start: int, end: int) -> str:
        return " ".join(self.words.slice(start, end - start).to_pylist())
