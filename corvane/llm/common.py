"""What several operators share: words, shingles, staged tables and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator: space and the five ASCII controls from tab to carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java regular expression that matches one word.
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([b not in SEPARATORS for b in range(256)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a master on this machine alone has one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name`` with underscores before it, as many as it takes."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def release(df: DataFrame) -> None:
    """Removes what ``staged`` wrote for ``df``, once all that was made of it is written itself."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def clear_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing holds any more; it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternates large-star and small-star steps, each two hash aggregations and a join, until the edge set
    stands still. Edges stay in tables throughout; only a row count and a checksum reach the driver.
    """
    now = staged(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u")
        small = (
            down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = staged(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots.join(nodes, "node", "left_anti"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend on ``seed`` alone."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BASE = 0x5851F42D4C957F2B  # 3 modulo 8
_BYTE = constants(256, 1) * np.array(_IS_WORD, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash for each word of ``text`` in order, A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    start, end = word_bounds(raw)
    size = 1 << max(16, int(len(raw)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words in order; fewer words make one shingle of them all, none make none."""
    n = len(words)
    if n == 0:
        return words
    by = constants(k + 1, 2)
    width = min(n, k)
    out = np.full(n - width + 1, by[k], dtype=np.uint64) * np.uint64(width)
    for i in range(width):
        out += words[i : n - width + 1 + i] * by[i]
        out = mix64(out)
    return out


def many_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of each text one after the other, and how many words each has.

    Texts are hashed together, so that short ones cost no calls of their own.
    """
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER), dtype=np.uint8)
    start, end = word_bounds(raw)
    up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    words = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])))


def many_shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingle_hashes`` of the words of each text one after the other, where each text's begin, and how many words each has."""
    words, counts = many_word_hashes(texts)
    first = np.cumsum(counts) - counts
    # runs of words that lie in one text
    whole = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    sizes = np.where(short, 1, whole)
    begins = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    if len(words) >= k:
        within = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
        out[np.repeat(~short, sizes)] = shingle_hashes(words, k)[np.repeat(first, whole) + within]
    for i in np.flatnonzero(short):
        out[begins[i]] = shingle_hashes(words[first[i] : first[i] + counts[i]], k)[0]
    return out, begins, counts


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles of ``text`` as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(word_hashes(text), k))
