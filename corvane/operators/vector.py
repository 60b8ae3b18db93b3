"""Vectors: a hashing encoder, dot products, top-k for batches of queries, coverage and pending work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import terms


#: Queries of a batch that tasks hold at once, vectors that meet them in one go, and vectors of a block where there are more queries.
HELD, STRIP, MET = 10_000, 512, 100_000
#: Texts that are encoded at once.
ENCODED = 1024


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fnv1a(word: str) -> int:
    h = 0x811C9DC5
    for unit in np.frombuffer(word.encode("utf-16-le"), dtype="<u2").tolist():
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return h


def hashing_encoder(text: Column, dims: int = 384) -> Column:
    """A unit vector of hashed words; a text without words is a zero vector. Words of ``ENCODED`` texts are counted at once."""

    @arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place: dict[str, int] = {}
        for batch in batches:
            parts = []
            for at in range(0, len(batch), ENCODED):
                words = batch.slice(at, ENCODED)
                coded = words.flatten().dictionary_encode()
                if len(place) > 500_000:
                    place.clear()
                for w in coded.dictionary.to_pylist():
                    if w not in place:
                        place[w] = fnv1a(w) % dims
                places = np.array([place[w] for w in coded.dictionary.to_pylist()], dtype=np.int64)
                owner = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
                cells = owner * dims + (places[coded.indices.to_numpy()] if len(places) else owner)
                v = np.bincount(cells, minlength=len(words) * dims).reshape(len(words), dims).astype(np.float64)
                # sums of squares of counts are whole numbers, so they are exact in any order
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = (v / np.where(norm > 0, norm, 1)).astype(np.float32)
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dims), pa.array(v.reshape(-1))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return encode(terms(text))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 60, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, score, rank): for each query its ``k`` nearest vectors by dot product, ties to the smaller id.

    ``queries`` (query_id, query) is a stated set against all rows. It is counted first: up to ``HELD`` queries go to
    every task; more of them meet the vectors in blocks of some ``HELD`` queries and ``MET`` vectors, dealt by hashes, and nothing
    of them passes through the driver. A task multiplies strips of vectors with its queries and keeps ``k`` rows of each, so
    that no more than these are shuffled. Scores have six decimals. Null vectors, those of another length than the query and
    those with a null or non-finite component are near nothing.
    """
    asked = queries.where("query IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    n = queries.count()
    scored = _in_blocks(rows, asked, n, k) if n > HELD else _at_once(rows, asked, k)
    scored = scored.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_SCORED = "query_id long, id long, score double"


class _Nearest:
    """The ``k`` nearest vectors of each query among those shown so far; queries of a length have a matrix."""

    def __init__(self, queries: list[tuple[int, list[float]]], k: int):
        self.k = k
        sizes = {len(v) for _, v in queries}
        self.matrices = {d: ([q for q, v in queries if len(v) == d], np.array([v for _, v in queries if len(v) == d], dtype=np.float64)) for d in sizes}
        self.kept = {d: (np.full((len(m), 0), -np.inf), np.empty((len(m), 0), dtype=np.int64)) for d, (_, m) in self.matrices.items()}

    def best(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` of each row, by score and then by id; only what reaches the k-th score is sorted."""
        if scores.shape[1] > self.k:
            reach = scores >= np.partition(scores, -self.k, axis=1)[:, -self.k : scores.shape[1] - self.k + 1]
            front = np.argsort(~reach, axis=1, kind="stable")[:, : int(reach.sum(axis=1).max())]
            scores, ids = np.take_along_axis(scores, front, 1), np.take_along_axis(ids, front, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def show(self, batch: pa.RecordBatch) -> None:
        """Compares a batch of (id, v), strip by strip."""
        lengths = batch.column(1).value_lengths().to_numpy()
        for d, (_, queried) in self.matrices.items():
            some = np.flatnonzero(lengths == d)
            for at in range(0, len(some), STRIP):
                part = batch.take(pa.array(some[at : at + STRIP]))
                ids, v = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                sound = np.isfinite(v).all(axis=1)
                scores = np.floor(queried @ v[sound].T * 1e6 + 0.5) / 1e6
                held, names = self.kept[d]
                self.kept[d] = self.best(np.hstack([held, scores]), np.hstack([names, np.broadcast_to(ids[sound], scores.shape)]))

    def told(self) -> Iterator[pa.RecordBatch]:
        for d, (names, _) in self.matrices.items():
            scores, ids = self.kept[d]
            columns = [pa.array(np.repeat(names, scores.shape[1]), pa.int64()), pa.array(ids.ravel()), pa.array(scores.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])


def _at_once(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    queries = [(r["query_id"], r["query"]) for r in asked.collect()]  # HELD at most, as counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Nearest(queries, k)
        for batch in batches:
            near.show(batch)
        yield from near.told()

    return rows.mapInArrow(run, _SCORED)


def _in_blocks(rows: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    slots, shares = -(-n // HELD), rows.count() // MET + 1
    deal = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asked = asked.select("query_id", "query", deal("query_id", slots).alias("slot"), every(shares).alias("share"))
    rows = rows.select("id", "v", every(slots).alias("slot"), deal("id", shares).alias("share"))

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        near = _Nearest(list(zip(queries["query_id"].to_pylist(), queries["query"].to_pylist(), strict=True)), k)
        for batch in vectors.select(["id", "v"]).to_batches():
            near.show(batch)
        out = list(near.told())
        return pa.Table.from_batches(out, schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    return asked.groupBy("slot", "share").cogroup(rows.groupBy("slot", "share")).applyInArrow(run, _SCORED)


def related(items: DataFrame, fact: DataFrame, least: float, newest: int, best: int) -> DataFrame:
    """The ``best`` items among the ``newest`` with a cosine of ``least`` or more; ``items`` has id, ts and v, ``fact`` one q."""
    recent = items.orderBy(F.col("ts").desc(), "id").limit(newest)
    scored = recent.join(F.broadcast(fact), how="cross").select("id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(best)


def in_scope(scope: Column, asked: str | int | None) -> Column:
    """A decision of no scope holds everywhere; without a scope asked for, all do."""
    return F.lit(True) if asked is None else scope.isNull() | (scope == asked)


def related_decisions(decisions: DataFrame, fact: DataFrame, scope: str | int | None = None, least: float = 0.82, newest: int = 300, best: int = 5) -> DataFrame:
    """What ``related`` finds among the decisions (id, ts, v, scope, superseded_by) that stand and hold in ``scope``."""
    return related(decisions.where(F.col("superseded_by").isNull() & in_scope(F.col("scope"), scope)), fact, least, newest, best)


def blobs(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with the vector as little-endian 32-bit floats in ``blob``; a null vector has a null one."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return vectors.withColumn("blob", pack(F.col(vector_col)))


def unpacked(rows: DataFrame, blob_col: str = "blob") -> DataFrame:
    """``rows`` with the vector of each blob in ``vector``."""

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return rows.withColumn("vector", unpack(F.col(blob_col)))


def overlap(a: Column, b: Column) -> Column:
    """The share of the tokens of ``a`` that ``b`` has too."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(a)))


def coverage(items: DataFrame, vectors: DataFrame, id_col: str, vector_id: str) -> DataFrame:
    """One row: how many items there are, how many have a vector, how many wait for one."""
    have = vectors.where(F.col("embedding").isNotNull()).select(F.col(vector_id).alias("_v")).distinct()
    joined = items.select(id_col).join(have, F.col(id_col) == F.col("_v"), "left")
    return joined.agg(F.count("*").alias("total"), F.count("_v").alias("with_vector"), F.count_if(F.col("_v").isNull()).alias("pending"))


def pending(items: DataFrame, vectors: DataFrame, id_col: str, vector_id: str) -> DataFrame:
    """The items without a vector: what a backfill still has to do, whatever was done before."""
    have = vectors.where(F.col("embedding").isNotNull()).select(F.col(vector_id).alias(id_col))
    return items.join(have, id_col, "left_anti")


def backfill(items: DataFrame, vectors: DataFrame, limit: int, id_col: str = "doc_id", vector_id: str = "vec_id", text_col: str = "text", dims: int = 384) -> DataFrame:
    """(vector_id, embedding) for the first ``limit`` items without a vector: a delta to append; a rerun does what is left."""
    todo = pending(items, vectors, id_col, vector_id).orderBy(id_col).limit(limit)
    return todo.select(F.col(id_col).alias(vector_id), hashing_encoder(F.col(text_col), dims).alias("embedding"))
