"""Best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import load_ranks
from .common import staged

#: How the vocabulary's files split a text before merging: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that a worker tokenises at once; runs of white space from this length on go to the tokenizers library itself.
AT_ONCE, LONG_SPACE = 128, re.compile(r"\s{1000}")


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    own = Tokenizer.from_file(tokenizer)
    own.encode_special_tokens = True
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(ranks), special_tokens={})


def encode(text: str, tokenizer: str, ranks: str) -> list[int]:
    """The ids that the tokenizers library gives ``text`` by the file ``tokenizer``, special tokens as ordinary text.

    ``ranks`` is the same vocabulary for tiktoken, which gives the same ids (tested on every code point and random
    texts) in a fifth of the time, but fails on long runs of white space.
    """
    own, fast = _encoders(tokenizer, ranks)
    return own.encode(text, add_special_tokens=False).ids if LONG_SPACE.search(text) else fast.encode_ordinary(text)


def cut(docs: DataFrame, tokenizer: str, ranks: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and ``end`` in pieces of at most ``size``: doc_id, piece, start, length, ids, ids_crc32, and
    place and nth, which tell pieces of one length apart. Written to the shared folder.

    Only longer documents are cut, into pieces of ``size``, but the first, which has what is over. A null text is empty
    and has the one id ``end``. place is the task that made the piece, nth its number among the task's pieces of its
    length: ranks within a length then need counts of each task and no sorting, whatever the share of one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                ids = [np.array([*encode(text or "", tokenizer, ranks), end], dtype=np.int32) for text in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids])
                pieces = -(-sizes // size)
                owner = np.repeat(np.arange(len(ids)), pieces)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = sizes - (pieces - 1) * size
                start = np.where(nth > 0, first[owner] + (nth - 1) * size, 0)
                length = np.where(nth > 0, size, first[owner])
                order = np.argsort(length, kind="stable")
                run_of, begins = np.unique(length[order], return_index=True)
                among = np.empty(len(owner), dtype=np.int64)
                among[order] = np.arange(len(owner)) - np.repeat(begins, np.diff([*begins, len(owner)]))
                among += made[length]
                made[run_of] += np.diff([*begins, len(owner)])
                flat, bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum(length)])
                raw = flat.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                columns = [
                    part.column(0).take(pa.array(owner)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), lists,
                    pa.array(sums, pa.int64()), pa.array(np.full(len(owner), place, dtype=np.int32)), pa.array(among),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "place", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, place int, nth long"))


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Kinds of bins and how many of each: (times, {length: how many in a bin}), for ``counts`` documents of each length.

    A bin is filled greedily, the longest that fits first. Then its smallest document gives way to two unpacked ones
    if they fit the gap that it leaves more tightly. A kind is used until some length of it runs out, so there are few kinds,
    however many documents. Short documents can be set aside at first, to fill what gaps the others leave. Several bounds
    for that are tried, with such changes made as often as they help, once a bin or not at all, until no plan can have fewer bins.
    """
    fewest, best = -(-sum(n * c for n, c in counts.items()) // size), None
    for swaps in (size, 1, 0):
        for aside in (size // 6, size // 12, size // 3, size // 24, 1):
            kinds = _plan(counts, size, aside, swaps)
            if best is None or sum(t for t, _ in kinds) < sum(t for t, _ in best):
                best = kinds
            if sum(t for t, _ in best) == fewest:
                return best
    return best


def _plan(counts: dict[int, int], size: int, aside: int, swaps: int) -> list[tuple[int, dict[int, int]]]:
    left = {n: c for n, c in counts.items() if c > 0}
    short = (1 << aside) - 1  # bit n: documents of length n
    begun, kinds = [], []
    while long := sum(1 << n for n, c in left.items() if c and n >= aside):
        begun.append(_use(Counter(), size, long, left, None, swaps))
    for times, bin_ in sorted(begun, key=lambda kind: sum(n * c for n, c in kind[1].items())):
        gap = size - sum(n * c for n, c in bin_.items())
        while times:
            kinds.append(_use(Counter(bin_), gap, short & sum(1 << n for n, c in left.items() if c), left, times, swaps))
            times -= kinds[-1][0]
    while rest := sum(1 << n for n, c in left.items() if c):
        kinds.append(_use(Counter(), size, rest, left, None, swaps))
    return [(times, dict(sorted(bin_.items(), reverse=True))) for times, bin_ in kinds]


def _use(begun: Counter, gap: int, open_: int, left: dict[int, int], most: int | None, swaps: int) -> tuple[int, Counter]:
    """A kind that begins as ``begun`` with ``gap`` left, filled from the lengths in ``open_``, and how often it is used,
    ``most`` times at most, its smallest document changed ``swaps`` times at most; takes from ``left`` what it has besides ``begun``.
    """
    own = Counter()

    def take(n: int, many: int = 1) -> None:
        nonlocal gap, open_
        own[n] += many
        gap -= many * n
        open_ = open_ | 1 << n if left[n] > own[n] else open_ & ~(1 << n)

    while fits := open_ & ((2 << gap) - 1):
        n = fits.bit_length() - 1
        take(n, min(gap // n, left[n] - own[n]))
    while swaps and gap and own and own.total() + begun.total() > 1:
        small = min(n for n, c in own.items() if c)
        pair = _tighter(open_, left, own, small, gap)
        if pair is None:
            break
        swaps -= 1
        take(small, -1)
        for n in pair:
            take(n)
    own = +own
    times = min([left[n] // c for n, c in own.items()] + ([most] if most else []))
    for n, c in own.items():
        left[n] -= times * c
    return times, begun + own


def _tighter(open_: int, left: dict[int, int], bin_: Counter, small: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest over ``small`` that ``small`` and ``gap`` have room for."""
    width = small + gap + 1
    low = open_ & ((1 << width) - 1)
    mirrored = int(f"{low:0{width}b}"[::-1], 2)  # bit width - 1 - n
    for total in range(small + gap, small, -1):
        both = low & (mirrored >> (width - 1 - total))  # bit n: n and total - n
        if not total % 2 and both >> total // 2 & 1 and left[total // 2] - bin_[total // 2] < 2:
            both &= ~(1 << total // 2)
        if both:
            n = both.bit_length() - 1
            return n, total - n
    return None


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """The sequence of every piece and its offset there: the columns of ``pieces`` but ids, sequence_id and offset.

    Sequences are numbered from 0, offsets are gapless from 0. Only how many pieces have each length, ``size`` numbers
    at most, reaches the driver, and the plan that goes back has a bounded number of rows too. Equal lengths are told apart by their
    rank, from the counts of the tasks that made them. No pieces give no rows.
    """
    counts = pieces.groupBy("place", "length").agg(F.count("*").alias("n"))
    counts = staged(counts)
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, used, base = [], Counter(), 0
    for times, bin_ in plan(totals, size):
        at = 0
        for n, c in bin_.items():
            rows.append((n, used[n], c, base, at))
            used[n] += times * c
            at += n * c
        base += times
    span = max(totals.values(), default=0) + 1
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    keys, (_, since, many, bases, ats) = table[:, 0] * span + table[:, 1], table.T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            kind = np.searchsorted(keys, length * span + rank, side="right") - 1
            turn, nth = np.divmod(rank - since[kind], many[kind])
            columns = [*(batch.column(i) for i, c in enumerate(names) if c != "rank"), pa.array(bases[kind] + turn), pa.array(ats[kind] + nth * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(c for c in names if c != "rank"), "sequence_id", "offset"])

    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("place", "length", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    ranked = pieces.drop("ids").join(starts, ["place", "length"]).withColumn("rank", F.col("nth") + F.col("ahead")).drop("ahead")
    kept = "doc_id long, piece int, start long, length long, ids_crc32 long, place int, nth long"
    return ranked.select(*(c.split()[0] for c in kept.split(", ")), "rank").mapInArrow(place, f"{kept}, sequence_id long, offset long")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the tokens of every sequence in order, at most its size."""
    rows = packed.join(pieces.select("place", "length", "nth", "ids"), ["place", "length", "nth"])
    rows = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
