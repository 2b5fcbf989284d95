"""Distinct-chunk tables: encode each distinct chunk of a slice of texts once, and join the ids back by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are cut, encoded and joined at a time, and chunks that a task keeps between slices.
SLICE, KEPT = 4_000_000, 1_000_000


class ChunkTable:
    """``encode`` gives the ids of a list of distinct chunks, as 4-byte integers; no id may span two chunks.

    Texts without a match of the regular expression ``odd`` are cut at each blank, after ``first`` is put before the
    text, so that its first chunk can be told from the others; ``cut`` gives the chunks of an odd text.
    The table of a task holds distinct chunks and their ids. When it has grown beyond ``KEPT`` chunks it starts
    anew, so memory stays bounded; chunks seen again are then encoded again.
    """

    def __init__(self, odd: str, first: str, cut: Callable[[str], list[str]],
                 encode: Callable[[list[str]], list[bytes]]):
        self.odd, self.first, self.cut, self.encode = odd, first, cut, encode
        self.table: dict[str, bytes] = {}

    def _ids(self, distinct: list[str]) -> list[bytes]:
        if len(self.table) > KEPT:
            self.table.clear()
        table = self.table
        new = [c for c in distinct if c not in table]
        if new:
            table.update(zip(new, self.encode(new)))
        return [table[c] for c in distinct]

    def slices(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids of all their chunks in order, id offsets by row) of slices of the texts; each row comes once."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False).astype(bool)
        size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        for kind in (False, True):
            rows = np.flatnonzero(odd == kind)
            if not len(rows):
                continue
            part = np.concatenate(([0], np.flatnonzero(np.diff(size[rows] // SLICE)) + 1, [len(rows)]))
            for a, b in zip(part[:-1], part[1:]):
                yield (rows[a:b], *self._joined(texts.take(pa.array(rows[a:b])), kind))

    def _joined(self, texts: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        if odd:
            cut = [self.cut(t) for t in texts.to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
            flat = pa.array([c for part in cut for c in part], pa.large_string())
        else:
            if self.first:
                texts = pc.binary_join_element_wise(
                    pa.scalar(self.first, pa.large_string()), texts, pa.scalar("", pa.large_string()))
            lists = pc.split_pattern(texts, " ")
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = held.take(coded.indices)
        ends = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))
        return taken.flatten().to_numpy(), ends[bounds]
