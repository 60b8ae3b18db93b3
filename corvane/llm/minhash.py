"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, constants, mix64, shingle_set, staged


def donors(bins: int, seed: int = 7) -> np.ndarray:
    """For each bin, a permutation of all bins: the order in which it looks for a value when it is empty."""
    return np.stack([np.random.default_rng([seed, b]).permutation(bins) for b in range(bins)])


def signature(shingles: np.ndarray, bins: int, table: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set of hashes: the leading bits of a hash choose its bin.

    An empty bin takes the value of the first filled bin in its own random order (optimal densification), so
    two sets agree in it with a probability equal to their Jaccard similarity.
    """
    at = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1))
    filled = at < np.append(at[1:], len(shingles))
    values = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        values[empty] = values[table[empty, np.argmax(filled[table[empty]], axis=1)]]
    return values


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band of ``rows`` values; the band's number is part of it."""
    by = values.reshape(-1, rows)
    key = constants(len(by), 3)
    for i in range(rows):
        key = mix64(key ^ by[:, i]) + key
    return key.view(np.int64)


def profiles(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, and its bucket for each band; ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = donors(bands * rows)
        for batch in batches:
            counts, digests, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(text, k)
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(found, bands * rows, table), rows) if len(found) else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x, k).view(np.int64) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose whole shingle sets have a Jaccard similarity of ``percent`` or more."""
    with_b = edges.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    sizes = (F.size("of_a") + F.size("of_b")).cast("long")
    return both.where(100 * shared >= percent * (sizes - shared)).select("a", "b")


#: Smallest hashes of a set that are compared before whole sets are; rows of a tile on its two sides.
SKETCH, OUTSIDERS, MEMBERS = 256, 512, 2048


def sketches(sets: DataFrame) -> DataFrame:
    """doc_id and the leading 32 bits of the ``SKETCH`` smallest hashes of its shingle set: all of it if it is small."""
    return sets.select("doc_id", F.transform(F.slice("shingles", 1, SKETCH), lambda x: F.shiftrightunsigned(x, 32)).alias("sketch"))


def hopeful(key: int, rows: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one tile that lie in different parts and whose sketches leave a similarity of ``percent`` possible.

    A pair is looked at in the first bucket that it shares alone. Where both sketches are whole sets the test is
    exact; else it lets through what lies within five standard deviations below the threshold.
    """
    rows = [r for r in rows if r["sketch"]]
    inner, outer = [r for r in rows if not r["outsider"]], [r for r in rows if r["outsider"]]
    if not inner or not outer:
        return
    bands = np.array([r["bands"] for r in inner])
    rep, part, n, home = (np.array([r[c] for r in inner]) for c in ("rep", "part", "n", "stray"))
    lists = [np.asarray(r["sketch"]) for r in inner]
    for r in outer:
        same = bands == np.array(r["bands"])
        first = bands[np.arange(len(bands)), same.argmax(axis=1)]
        small, large = np.minimum(n, r["n"]), np.maximum(n, r["n"])
        at = np.flatnonzero((first == key) & (part != r["part"]) & (100 * small >= percent * large) & (~home | (rep > r["rep"])))
        if not len(at):
            continue
        own = np.asarray(r["sketch"])
        whole = len(own) >= r["n"]
        flat, starts = np.concatenate([lists[i] for i in at]), np.cumsum([0, *(len(lists[i]) for i in at[:-1])])
        last = np.array([lists[i][-1] for i in at])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit, starts, dtype=np.int64)
        full = np.array([len(lists[i]) >= n[i] for i in at])
        mine = np.where(full, len(own), np.searchsorted(own, last, "right"))
        theirs = np.add.reduceat(flat <= (own[-1] if not whole else np.iinfo(np.int64).max), starts, dtype=np.int64)
        union = mine + theirs - both
        slack = np.where(full & whole, 0.0, 2 / np.sqrt(np.maximum(union, 1)))
        for i in at[both >= (percent / 100 - slack) * union - 1e-9]:
            yield r["rep"], int(rep[i])


def across_parts(split: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate edges (a, b) between classes of one bucket that are in different parts; ``split``: key, rep, n, part.

    Outside its largest part, a bucket has few classes: those meet all its classes, in tiles of bounded size.
    """
    counts = split.groupBy("key", "part").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.max_by("part", "c").alias("main"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("strays"))
    rows = split.join(keys.where("strays > 0"), "key").withColumn("stray", F.col("part") != F.col("main"))
    rows = rows.withColumns({"across": F.ceil(F.col("strays") / OUTSIDERS), "down": F.ceil(F.col("all") / MEMBERS)})
    slot = lambda n: F.pmod(F.xxhash64("rep"), n)
    inner = rows.withColumns({"outsider": F.lit(False), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)), "j": slot(F.col("down"))})
    outer = rows.where("stray").withColumns({"outsider": F.lit(True), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)), "i": slot(F.col("across"))})
    tiles = staged(inner.unionByName(outer).select("key", "i", "j", "outsider", "stray", "rep", "part", "n"))
    wanted = tiles.select(F.col("rep").alias("doc_id")).distinct()
    low = sketches(sets.join(wanted, "doc_id", "left_semi")).withColumnRenamed("doc_id", "rep")
    whole = tiles.join(low.join(classes.select("rep", "bands"), "rep"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for tile in tiled(batches, ("key", "i", "j")):
            found += hopeful(tile[0]["key"], tile, percent)
            if len(found) >= 10_000:
                yield pairs(found)
                found = []
        yield pairs(found)

    return whole.mapInArrow(run, "a long, b long").distinct()


def tiled(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows that agree in ``by``, from sorted batches."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for row in batch.slice(at, 500).to_pylist():
                if held and any(held[0][c] != row[c] for c in by):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    low, high = [min(x) for x in found], [max(x) for x in found]
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80, bands: int = 32, rows: int = 4
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked when their sets of ``k``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``percent`` or more; component_id is the smallest id reachable by links and kept marks that document.
    With 32 bands of 4 values, a pair at 0.8 is missed with a probability of 5e-8.

    1. Equal sets are one class, named by its smallest id; only classes go on, so copies cost no pairs.
    2. In each bucket, the smallest class is the centre of a star, and each other class is compared with it.
    3. A bucket whose classes are then still in several components could hide a link between two that both
       differ from the centre. There, the classes outside the largest component
       are compared across components, by sketches first and then by whole sets.

    Null and empty texts and texts of separators alone have no shingles and link with nothing. Rows with a null
    id link with nothing and are kept. Repeated ids share a component. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = staged(profiles(base, k, bands, rows))
    real = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(
        real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    entries = classes.select("rep", "n", F.explode("bands").alias("key"))
    crowded = entries.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = staged(entries.join(crowded, "key"))

    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    sizes = classes.select(F.col("rep").alias("centre"), F.col("n").alias("centre_n"))
    stars = members.where("rep != centre").select("centre", "rep", "n").distinct().join(sizes, "centre").where(fits(F.col("n"), F.col("centre_n")))
    stars = staged(stars.select(F.col("centre").alias("a"), F.col("rep").alias("b")))
    # texts are read again rather than all their sets kept; the ids grow with the corpus, so they are not broadcast
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = staged(shingle_sets(base.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), k))
    links = staged(confirmed(stars, sets, percent))
    parts = connected_components(links, "a", "b")

    split = staged(
        members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part"))
    )
    across = staged(across_parts(split, classes, sets, percent))
    if not across.isEmpty():
        links = staged(links.unionByName(confirmed(across, sets, percent)))
        parts = connected_components(links, "a", "b")

    labels = classes.select("digest", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.select("digest", F.coalesce("component", "rep").alias("component"))
    linked = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest").join(labels, "digest")
    alone = profile.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
    out = linked.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(
        alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
