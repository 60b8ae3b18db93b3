"""Embedding near-duplicates: a subspace pigeonhole join on rotated vectors.

Unit vectors with cosine c are at squared distance 2 - 2c. Rotated and cut into blocks, two vectors within that
distance are within a proportional share of it in one block at least. So each block is joined on its own by range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged

#: Vectors on each side of a tile, and rows of it that are compared in one go.
TILE, STRIP = 16_384, 512


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def turned(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ rotation(vectors.shape[1])


def blocks(dims: int, parts: int) -> list[slice]:
    cuts = np.linspace(0, dims, min(parts, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def cells(classes: DataFrame, cosine: float, parts: int, kind: str) -> DataFrame:
    """rep, copies, vector, dims, and for each block the cell of its first coordinate; cells are as wide as the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(x) // np.dtype(kind).itemsize for x in raw])
            for dims in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == dims)
                at = turned(np.frombuffer(b"".join(raw[i] for i in some), dtype=kind).reshape(len(some), dims).astype(np.float64))
                mine = batch.take(pa.array(some))
                for b, part in enumerate(blocks(dims, parts)):
                    reach = np.sqrt((2 - 2 * cosine) * (part.stop - part.start) / dims) * (1 + 1e-9) + 1e-12
                    cell = np.floor(at[:, part.start] / reach).astype(np.int32)
                    columns = [*mine.columns, *(pa.array(np.full(len(some), x, dtype=np.int32)) for x in (dims, b)), pa.array(cell)]
                    yield pa.RecordBatch.from_arrays(columns, names=["rep", "copies", "vector", "dims", "block", "cell"])

    return classes.select("rep", "copies", "vector").mapInArrow(run, "rep long, copies long, vector binary, dims int, block int, cell int")


def join_tile(block: int, left: pd.DataFrame, right: pd.DataFrame, same: bool, cosine: float, parts: int, kind: str) -> pd.DataFrame:
    """rep, links, root for what is linked in one tile; a pair counts in the first block in which it is in range."""
    raw = [np.frombuffer(b"".join(x["vector"]), dtype=kind).reshape(len(x), -1).astype(np.float64) for x in (left, right)]
    a, b = map(turned, raw)
    cut = blocks(a.shape[1], parts)
    limit = np.array([(2 - 2 * cosine) * (c.stop - c.start) / a.shape[1] for c in cut]) * (1 + 1e-9) + 1e-12
    x, y = (z[:, cut[block]].astype(np.float32) for z in (a, b))
    yy, found = (y * y).sum(axis=1), []
    lengths = [np.linalg.norm(z, axis=1) for z in raw]
    for s in range(0, len(x), STRIP):
        strip = x[s : s + STRIP]
        gap = yy - 2 * (strip @ y.T)
        i, j = np.nonzero(gap <= np.float32(limit[block] + 1e-5) - (strip * strip).sum(axis=1)[:, None])
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            near = np.einsum("nd,nd->n", raw[0][p], raw[1][q]) / (lengths[0][p] * lengths[1][q]) >= cosine
            p, q = p[near], q[near]
            square = (a[p] - b[q]) ** 2
            within = np.stack([square[:, c].sum(axis=1) for c in cut], axis=1) <= limit
            first = within.argmax(axis=1) == block
            found.append((p[first], q[first]))
    p, q = (np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (0, 1))
    if not len(p):
        return pd.DataFrame({"rep": [], "links": [], "root": []}, dtype="int64")
    u, v = left["rep"].to_numpy()[p], right["rep"].to_numpy()[q]
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    e, f = ends[: len(u)], ends[len(u) :]
    links = np.bincount(e, right["copies"].to_numpy()[q], len(nodes)) + np.bincount(f, left["copies"].to_numpy()[p], len(nodes))
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[e], root[f])
        np.minimum.at(root, e, low)
        np.minimum.at(root, f, low)
        root = root[root]
    return pd.DataFrame({"rep": nodes, "links": links.astype(np.int64), "root": nodes[root]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, parts: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``.

    Vectors link at a cosine of ``cosine`` or more, in double precision, whatever their lengths; n_links counts the
    other rows linked directly, component_id is the smallest id reachable, kept marks that row. Vectors that are
    null, empty or zero, or hold a null or non-finite component, link with nothing; so do vectors with a null id.
    Vectors of different dimension never link. Rows that share an id are one node; other columns are ignored.

    Equal vectors are one class with a count. A cell with many classes is cut into tiles of at most about ``TILE``
    a side, so no task holds a cell; pairs stay inside their task, which returns counts and a star for each
    component. The join finds every pair, but its work grows with the square of what shares a cell: at this angle,
    vectors without structure spread over few cells.
    """
    kind = "<f8" if "double" in dict(vectors.dtypes)[vector_col] else "<f4"
    sql = "double" if kind == "<f8" else "float"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{sql}>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0)
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    base = base.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), F.col("v"))})
    classes = base.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = staged(_packed(classes, kind))
    homes = staged(cells(classes, cosine, parts, kind))
    spot = ["dims", "block", "cell"]
    counts = homes.groupBy(*spot).agg(F.count("*").alias("n"))
    below = counts.select("dims", "block", (F.col("cell") + 1).alias("cell"), F.col("n").alias("m"))
    sizes = counts.join(below, spot, "left").select(*spot, F.ceil(F.col("n") / TILE).alias("own"), F.ceil(F.coalesce("m", F.lit(0)) / TILE).alias("guests"))
    sizes = staged(sizes)
    slot = lambda n: F.pmod(F.xxhash64("rep"), n)
    upto = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    zero = F.lit(0).cast("long")
    own = homes.join(sizes, spot).withColumn("s", slot(F.col("own")))
    cols = [*spot, "a", "b", "guest", "side", "rep", "copies", "vector"]
    made = [
        own.withColumns({"a": F.col("s"), "b": F.explode(upto(F.col("s"), F.col("own") - 1)), "guest": F.lit(False), "side": F.lit(0)}),
        own.withColumns({"b": F.col("s"), "a": F.explode(upto(zero, F.col("s") - 1)), "guest": F.lit(False), "side": F.lit(1)}),
        own.withColumns({"a": F.col("s"), "b": F.explode(upto(zero, F.col("guests") - 1)), "guest": F.lit(True), "side": F.lit(0)}),
        homes.withColumn("cell", F.col("cell") + 1).join(sizes, spot)
        .withColumns({"b": slot(F.col("guests")), "a": F.explode(upto(zero, F.col("own") - 1)), "guest": F.lit(True), "side": F.lit(1)}),
    ]
    tiles = made[0].select(cols)
    for more in made[1:]:
        tiles = tiles.unionByName(more.select(cols))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        left = rows[rows["side"] == 0]
        same = not one["guest"] and one["a"] == one["b"]
        right = left if same else rows[rows["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []}, dtype="int64")
        return join_tile(int(one["block"]), left, right, same, cosine, parts, kind)

    linked = staged(tiles.groupBy(*spot, "a", "b", "guest").applyInPandas(run, "rep long, links long, root long"))
    found = connected_components(linked, "rep", "root").withColumnRenamed("node", "rep")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(found, "rep", "left")
    facts = facts.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    narrow = base.select("vec_id", "sound", "k1", "k2")
    out = narrow.where("sound").join(facts, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(narrow.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _packed(classes: DataFrame, kind: str) -> DataFrame:
    """The vectors of ``classes`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, dtype=kind).tobytes() for v in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw, pa.binary())], names=["k1", "k2", "rep", "copies", "vector"])

    return classes.mapInArrow(run, "k1 long, k2 long, rep long, copies long, vector binary")
