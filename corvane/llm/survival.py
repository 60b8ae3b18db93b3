"""How filters interact: survivors of every subset of filters, in every order of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_CAPITALS, _LATER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: For each set of filters that a document fails, the word whose bit s says that it survives the subset s.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)


def failures(raw: bytes, least: int, distinct: int, capitals: int, symbols: bytes) -> int:
    """The filters A to D that a text fails, as bits. ``bytes.split`` parts at space and the ASCII controls from tab to carriage return."""
    words = raw.split()
    chars = len(raw.translate(None, _LATER_BYTES))
    upper = len(raw) - len(raw.translate(None, _CAPITALS))
    few = len(words) < least
    same = 100 * len(set(words)) < distinct * len(words)
    return few | same << 1 | (100 * upper > capitals * chars) << 2 | (len(raw.translate(None, symbols)) < len(raw)) << 3


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each bit. Carry-save adders turn three words of a weight into one of the same and one
    of twice the weight; at most two words of each weight are left to be read bit by bit.
    """
    bits, counts, weight = np.arange(SUBSETS, dtype=np.uint32), np.zeros(SUBSETS, dtype=np.int64), 0
    while len(words):
        carries = []
        while len(words) > 2:
            a, b, c = np.pad(words, (0, -len(words) % 3)).reshape(-1, 3).T
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = half ^ c
        for word in words:
            counts += ((word >> bits) & np.uint32(1)).astype(np.int64) << weight
        words, weight = np.concatenate([np.empty(0, dtype=np.uint32), *carries]), weight + 1
    return counts


def judged(
    docs: DataFrame, least: int = 100, distinct: int = 80, capitals: int = 10, symbols: str = "#$%&*|",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """doc_id, part, failed: the filters that each document fails, as bits: A to D by its own text, E because another row
    of a smaller id has the same text.

    Null texts are empty, null parts are ''. Rows of one id and text are none smaller than the other; a null id is
    neither smaller nor larger than any. Texts are compared by their SHA-256. The first id of each text meets its own
    row by id and text, so a text that a third of all rows have is no hot key.
    """
    signs = symbols.encode()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [], []
            for value in batch.column(2):
                raw = value.as_py()
                failed.append(failures(raw, least, distinct, capitals, signs))
                digests.append(hashlib.sha256(raw).digest())
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "failed"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"),
    )
    rows = staged(rows.mapInArrow(look, "doc_id long, part string, digest binary, failed int"))
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    rows = rows.join(first, ["doc_id", "digest"], "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    return rows.select("doc_id", "part", F.col("failed").bitwiseOR(again).alias("failed"))


def survivors(rows: DataFrame) -> DataFrame:
    """part, n, good, toxic: for each part an array of how many documents survive each subset of filters, of all and of
    those with a label. ``rows`` has part, failed, good and toxic. Every batch is counted by itself, so a part of any
    size goes over all tasks, and what is shuffled are counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, names = pd.factorize(batch.column(0).to_pandas())
            words, good, toxic = WORDS[batch.column(1).to_numpy()], *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            out = {"part": [], "subset": [], "n": [], "good": [], "toxic": []}
            for i, name in enumerate(names):
                here = parts == i
                out["part"] += [name] * SUBSETS
                out["subset"] += range(SUBSETS)
                for column, chosen in (("n", here), ("good", here & good), ("toxic", here & toxic)):
                    out[column] += positional_popcount(words[chosen]).tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.string()), ("subset", pa.int32()), *((c, pa.int64()) for c in ("n", "good", "toxic"))]))

    counts = rows.select("part", "failed", "good", "toxic").mapInArrow(count, "part string, subset int, n long, good long, toxic long")
    sums = counts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("subset", c))), lambda x: x[c]).alias(c)
    return sums.groupBy("part").agg(*map(listed, ("n", "good", "toxic")))


def _orders(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    everything = SUBSETS - 1
    for rows in parts:
        for part, *arrays in rows.itertuples(index=False):
            n, good, toxic = (np.asarray(a) for a in arrays)
            value = {}
            for i, name in enumerate(FILTERS):
                bit, others = 1 << i, [s for s in range(SUBSETS) if not s >> i & 1]
                value[name] = sum(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) * int(n[s] - n[s | bit]) for s in others)
            out = []
            for order in permutations(FILTERS):
                before = 0
                for step, name in enumerate(order, 1):
                    bit = 1 << FILTERS.index(name)
                    after = before | bit
                    gone = lambda a: int(a[before] - a[after])
                    out.append((
                        part, "".join(order), step, int(n[after]), gone(n), int(n[0] - n[bit]) - gone(n),
                        int(n[everything ^ bit] - n[everything]), gone(good), gone(toxic), value[name],
                    ))
                    before = after
            yield pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **thresholds) -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley, as counts of documents.

    Every document becomes a word of 32 bits, one for each subset of filters that it survives; the counts of all words
    of a part give every order. ``labels`` has the id, quality and toxic; an id with several labels has each that
    any of its rows names, one without labels or a null id has none. Repeated rows are documents of their own; an
    empty table has no parts and gives no rows. Other columns are ignored.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = judged(docs, id_col=id_col, **thresholds).join(marks, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return survivors(rows).mapInPandas(_orders, schema)
