"""Byte-level BPE encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces that a worker remembers at most, and documents that it sends on at once.
REMEMBERED, AT_ONCE = 300_000, 128
#: Children of a node of the segment tree.
FAN = 16
_NONE = 1 << 62


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: the leftmost pair of lowest rank is merged until no pair has a rank.

    A leaf of the segment tree belongs to the byte position at which a live token starts, and holds the rank of
    the pair of that token and the next one, with the position below it; the least is then the leftmost minimum.
    Nodes have ``FAN`` children, as the least of so many is one call. A merge changes the leaves of the token, of
    its left neighbour and of the one swallowed, each in log(n) steps; a short piece's leaves hang from the root.
    """
    n, get = len(piece), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    leaves = [_NONE if (rank := get(piece[at : at + 2])) is None else rank << shift | at for at in range(n - 1)]
    leaves.append(_NONE)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        low = levels[-1]
        levels.append([min(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    root, deep = levels[-1], len(levels) > 1

    end, before = list(range(1, n + 1)), list(range(-1, n))
    while (least := min(root)) < _NONE:
        at = least & mask
        gone = end[at]
        after = end[at] = end[gone]
        before[after] = at
        leaves[gone] = leaves[at] = _NONE
        if after < n and (rank := get(piece[at : end[after]])) is not None:
            leaves[at] = rank << shift | at
        left = before[at] if at else 0
        if at:
            rank = get(piece[left:after])
            leaves[left] = _NONE if rank is None else rank << shift | left
        if deep:
            for i in (gone, at, left):
                for low, up in zip(levels, levels[1:], strict=False):
                    i //= FAN
                    least = min(low[i * FAN : i * FAN + FAN])
                    if up[i] == least:
                        break
                    up[i] = least
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return tuple(out)


class Pieces(dict):
    """The ids of pieces seen before. When half of what it may remember is new, what is older and was not asked for since is
    forgotten, so its memory is bounded and frequent pieces stay.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = merge(raw, self.ranks) if whole is None else (whole,)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """What a worker remembers of a vocabulary, from one task to the next."""
    return Pieces(load_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids: the token ids of every whole text, without special tokens.

    ``path`` is a rank file that executors can read, ``pattern`` splits a text into pieces that are merged apart.
    Null and empty texts have no ids. Repeated rows stay as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, split = pieces(path), regex.compile(pattern).findall
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                ids = [
                    np.fromiter(chain.from_iterable(map(seen.__getitem__, split(text or ""))), dtype=np.int32)
                    for text in part.column(1).to_pylist()
                ]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, ids array<int>")


def id_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The id arrays of a list column, without copies; null is empty."""
    flat = column.values.to_numpy(zero_copy_only=False)
    bounds = column.offsets.to_numpy()
    for i in range(len(column)):
        yield flat[bounds[i] : bounds[i + 1]] if column[i].is_valid else flat[:0]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded: the bytes that the ids stand for. Null ids decode to nothing, unknown ids are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in load_ranks(path).items()}.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                raw = [b"".join(map(token, ids.tolist())) for ids in id_lists(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
