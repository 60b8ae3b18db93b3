"""Which fragments stand in which texts: a trigram index proposes pairs, which are then looked at."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Grams of a fragment that a text has to hold before the two are compared; grams that are looked for where texts are read;
#: letters of fragments that are compared there; texts that a task looks at in one go, and grams that it counts together.
PROBES, ASKED, LETTERS, AT_ONCE, COUNTED = 4, 1 << 20, 1 << 24, 256, 1 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``AT_ONCE`` rows at a time, so that what a task holds of them doesn't grow with a batch."""
    return (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE))


def grams(text: str, size: int) -> np.ndarray:
    """The runs of ``size`` code points of a text, 3 at most, each as one number, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out = np.full(max(len(points) - size + 1, 0), size, dtype=np.int64)
    for i in range(size):
        out = out << 20 | (points[i : len(points) - size + 1 + i] & 0xFFFFF)
    return out


def _gram_rows(rows: DataFrame, sizes: list[int], wanted: np.ndarray | None, counted: bool) -> DataFrame:
    """(id, gram): the distinct grams of each text, only ``wanted`` ones if given; with ``counted``, (gram, n) summed in parts."""

    def own_grams(text: str) -> np.ndarray:
        own = np.unique(np.concatenate([grams(text, n) for n in sizes] or [np.empty(0, dtype=np.int64)]))
        if wanted is not None and len(own):
            at = np.searchsorted(wanted, own)
            own = own[(at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == own)] if len(wanted) else own[:0]
        return own

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [own_grams(text) for text in part.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(np.concatenate(found))], names=["id", "gram"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n, new, size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], 0
        for part in chain(_parts(batches), [None]):
            for text in [] if part is None else part.column(1).to_pylist():
                new.append(own_grams(text))
                size += len(new[-1])
                if size >= COUNTED:
                    values, n, new, size = *_added(values, n, new), [], 0
            if part is None or len(values) >= COUNTED:
                values, n = _added(values, n, new)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["gram", "n"])
                values, n, new, size = values[:0], n[:0], [], 0

    kind = rows.schema[rows.columns[0]].dataType.simpleString()
    return rows.mapInArrow(summed, "gram long, n long") if counted else rows.mapInArrow(listed, f"id {kind}, gram long")


def _added(values: np.ndarray, n: np.ndarray, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different grams in order and their counts, with one more for each of ``new``."""
    every = np.concatenate([values, *new])
    counts = np.ones(len(every), dtype=np.int64)
    counts[: len(n)] = n
    order = np.argsort(every)
    every, counts = every[order], counts[order]
    first = np.flatnonzero(np.diff(every, prepend=every[:1] - 1))
    return every[first], np.add.reduceat(counts, first) if len(first) else counts


def _within(texts: DataFrame, sizes: list[int], rare: DataFrame) -> DataFrame:
    """(fragment, id) of texts that hold a fragment, told where they are read: ``rare`` (fragment, gram, probes) is bounded.

    Grams of a text lead to the fragments that they are probes of; fragments whose probes are all there are looked for.
    """
    rows = rare.select("fragment", "gram").collect()
    names = sorted({r["fragment"] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    own, of = np.array([r["gram"] for r in rows], dtype=np.int64), np.array([number[r["fragment"]] for r in rows], dtype=np.int64)
    order = np.argsort(own, kind="stable")
    own, of, needed = own[order], of[order], np.bincount(of, minlength=len(names))
    wanted, begins = np.unique(own, return_index=True)
    ends = np.append(begins[1:], len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            owners, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                here = np.unique(np.concatenate([grams(text, n) for n in sizes]))
                at = np.searchsorted(here, wanted)
                hits = np.flatnonzero(here[np.minimum(at, len(here) - 1)] == wanted) if len(here) else at[:0]
                if not len(hits):
                    continue
                proposed, n = np.unique(np.concatenate([of[begins[h] : ends[h]] for h in hits]), return_counts=True)
                held = [names[j] for j in proposed[n == needed[proposed]] if names[j] in text]
                owners += [i] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(pa.array(owners, pa.int64()))], names=["fragment", "id"])

    return texts.mapInArrow(run, f"fragment string, id {texts.schema['id'].dataType.simpleString()}")


def contained(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """(fragment_id, id): every pair of ``fragments`` (fragment_id, fragment) and ``texts`` (id, text) whose text holds the
    fragment, letter for letter.

    Every run of three letters of a fragment stands in a text that holds it. Of each fragment, the ``PROBES`` runs that
    fewest texts have are looked for; texts that hold all of them are compared. Shorter fragments are their own run of one or two
    letters. What is chosen changes the work, not the result. Fragments of up to ``ASKED`` runs and ``LETTERS`` letters go to
    the tasks that read texts, and only pairs leave these; more of them meet the texts' runs in joins. Null and empty
    fragments stand nowhere, a null text holds none. Fragments of one id count one by one, pairs are distinct.
    """
    fragments = fragments.select("fragment_id", "fragment").where("fragment IS NOT NULL").distinct()
    texts = texts.select("id", "text").where("text IS NOT NULL")
    some = staged(fragments.where("fragment <> ''"))
    each = some.select("fragment").distinct()
    own = None
    for n in (1, 2, 3):
        part = each.where(F.least(F.length("fragment"), F.lit(3)) == n).select("fragment", F.col("fragment").alias("text"))
        part = _gram_rows(part, [n], None, False).withColumnRenamed("id", "fragment")
        own = part if own is None else own.unionByName(part)
    own = staged(own)
    sizes = sorted(r["n"] for r in each.select(F.least(F.length("fragment"), F.lit(3)).alias("n")).distinct().collect())
    asked = _bounded(own)
    df = _gram_rows(texts, sizes, asked, True).groupBy("gram").agg(F.sum("n").alias("df"))
    # a run that no text has rules its fragment out
    rare = own.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = rare.withColumn("nth", F.row_number().over(Window.partitionBy("fragment").orderBy("df", "gram"))).where(F.col("nth") <= PROBES)
    rare = staged(rare.withColumn("probes", F.max("nth").over(Window.partitionBy("fragment"))).select("fragment", "gram", "probes"))
    size = rare.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("fragment")), F.lit(0)).alias("letters")).first()
    if size["n"] <= ASKED and size["letters"] <= LETTERS * PROBES:
        pairs = _within(texts, sizes, rare)
    else:
        found = _gram_rows(texts, sizes, _bounded(rare), False)
        proposed = found.join(rare, "gram").groupBy("fragment", "id", "probes").agg(F.count("*").alias("n")).where("n = probes").select("fragment", "id")
        pairs = texts.join(staged(proposed), "id").where(F.contains("text", F.col("fragment"))).select("fragment", "id")
    return some.join(pairs, "fragment").select("fragment_id", "id").distinct()


def _bounded(rows: DataFrame) -> np.ndarray | None:
    """The distinct grams of ``rows`` in order, none if there are more than ``ASKED``."""
    values = [r["gram"] for r in rows.select("gram").distinct().limit(ASKED + 1).collect()]
    return None if len(values) > ASKED else np.sort(np.array(values, dtype=np.int64))
