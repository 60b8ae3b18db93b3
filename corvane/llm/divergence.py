"""How far the sources of a language differ in their terms, in exact integers."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Terms that a task counts before it sends them on, and corrections that it adds up at once.
COUNTED, ADDED = 300_000, 1 << 20
#: Everything but ASCII letters and bytes beyond ASCII parts terms; only A-Z are lower-cased.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: How many shares of each source the roster of a language is copied to.
SHARES = 32


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in order."""
    return raw.translate(_TERMS).split()


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term and documents with it, summed over the table; each group has
    a row with a null term, so that a group without terms is there too. Nulls count as ''.

    Tasks add up what they read until they hold ``COUNTED`` terms, so frequent terms shuffle a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs, holds, size = defaultdict(Counter), defaultdict(Counter), 0

        def told() -> pa.RecordBatch:
            out = [], [], [], [], []
            for (lang, source), found in occurs.items():
                within = holds[lang, source]
                for column, values in zip(out, ([lang] * len(found), [source] * len(found), found, found.values(), (within[t] for t in found)), strict=True):
                    column.extend(values)
            columns = [*map(pa.array, out[:2], [pa.string()] * 2), pa.array(out[2], pa.binary()), *map(pa.array, out[3:], [pa.int64()] * 2)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = terms(value.as_py())
                group = occurs[lang, source]
                size -= len(group)
                group[None] += 0
                group.update(found)
                holds[lang, source].update(set(found))
                size += len(group)
                if size > COUNTED:
                    yield told()
                    occurs, holds, size = defaultdict(Counter), defaultdict(Counter), 0
        yield told()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("raw"))
    rows = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column, scale: int, prior: int) -> Column:
    """1 and the smoothed share of ``n`` in ``total``, ``kept`` terms, in whole parts of ``scale``."""
    above, below = (n + prior).cast("decimal(20,0)") * F.lit(scale).cast("decimal(18,0)"), (total + prior * kept).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def corrections(rows: DataFrame) -> DataFrame:
    """lang, a, b, value: what the terms that both sources have change in the difference of sources a < b.

    ``rows`` are (lang, items, terms): the nonzero shares of a term in order of the sources, each as a struct of the
    source's place, the share and the share of a term that the source does not have, and how many terms have exactly these.
    A frequent-pattern tree over them has a node for each different beginning. Rows are dealt and sorted by their
    items, so rows with a common beginning are neighbours and a task walks the tree along its own rows with one path in memory, as
    deep as there are sources. When the walk leaves a node, it is counted with each ancestor once, times the terms below it.
    A beginning that two tasks meet is two nodes with parts of its terms.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, depth = None, 0
        path = np.zeros((16, 4), dtype=np.int64)  # place, share, share of an absent term, terms
        added: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def told() -> pa.RecordBatch:
            nonlocal added, size
            a, b, value = (np.concatenate([x[i] for x in added] or [np.empty(0, dtype=np.int64)]) for i in range(3))
            order = np.lexsort((b, a))
            a, b, value = a[order], b[order], value[order]
            begins = np.flatnonzero(np.diff(a, prepend=-1) | np.diff(b, prepend=-1))
            sums = np.add.reduceat(value, begins) if len(begins) else value
            added, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(begins), pa.string()), *map(pa.array, (a[begins], b[begins], sums))], names=["lang", "a", "b", "value"])

        def leave(to: int) -> None:
            nonlocal depth, size
            while depth > to:
                depth -= 1
                place, p, absent, below = path[depth]
                above = path[:depth]
                both = np.abs(p - above[:, 1]) - np.abs(p - above[:, 2]) - np.abs(absent - above[:, 1]) + np.abs(absent - above[:, 2])
                added.append((above[:, 0].copy(), np.full(depth, place), both * below))
                size += depth

        for batch in batches:
            items = batch.column(1)
            bounds, flat = items.offsets.to_numpy(), items.values
            values = np.stack([flat.field(i).to_numpy().astype(np.int64) for i in range(3)], axis=1) if len(flat) else path[:0, :3]
            for i, (name, many) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                row = values[bounds[i] : bounds[i + 1]]
                if name != lang:
                    leave(0)
                    if added:
                        yield told()
                    lang = name
                shared = min(depth, len(row))
                differ = np.flatnonzero((path[:shared, :2] != row[:shared, :2]).any(axis=1))
                shared = int(differ[0]) if len(differ) else shared
                leave(shared)
                while len(row) > len(path):
                    path = np.concatenate([path, np.zeros_like(path)])
                path[shared : len(row), :3] = row[shared:]
                path[shared : len(row), 3] = 0
                depth = len(row)
                path[:depth, 3] += many
                if size > ADDED:
                    yield told()
        leave(0)
        if added:
            yield told()

    return rows.select("lang", "items", "terms").mapInArrow(walk, "lang string, a long, b long, value long")


def audit(
    docs: DataFrame, least: int = 30, scale: int = 1_000_000_000, prior: int = 5, most: int = 50,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source is from each other one of its language (part ``pair``, all
    of them) and which terms it has more of than the language has (part ``term``, at most ``most``).

    A language keeps the terms that at least ``least`` of its documents have. A term's share in a group is 1 and
    ``scale`` times its smoothed frequency, rounded down; absent terms have a share too. A pair's value is the sum of absolute
    differences over all kept terms. It is put together from three parts: all terms as if both sources had
    none, what the terms of one source change, and what terms of both change (``corrections``). Null texts, languages
    and sources are ''. A group without terms is compared too; a language without kept terms has pairs of value 0; one with a
    single source has none. Repeated rows are documents of their own. No rows give no rows.
    """
    found = staged(counted(docs, lang_col, source_col, text_col))
    listed = F.collect_list(F.struct("source", "n"))
    rows = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), listed.alias("by"), F.sum("n").alias("all"))
    rows = staged(rows.where(F.col("docs") >= least).drop("docs"))
    each = rows.select("lang", "term", "all", F.inline("by"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    groups = found.where("term IS NULL").select("lang", "source")
    groups = groups.join(each.groupBy("lang", "source").agg(F.sum("n").alias("source_n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("source_n", "v", "lang_n")})
    # small sources first: their counts are small and often the same, so paths share more
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source_n", "source")).cast("long")
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("source_n"), F.col("v"), scale, prior)).otherwise(0)
    groups = staged(groups.withColumns({"place": place, "absent": absent}))
    each = each.join(groups, ["lang", "source"])
    each = each.withColumns({"p": share(F.col("n"), F.col("source_n"), F.col("v"), scale, prior), "q": share(F.col("all"), F.col("lang_n"), F.col("v"), scale, prior)})
    each = staged(each.select("lang", "source", "term", "place", "absent", "p", "q"))

    paths = each.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("place", "p", "absent"))).alias("items"))
    paths = staged(paths.groupBy("lang", "items").agg(F.count("*").alias("terms")))
    # bounds of ranges are samples of rows: short beginnings, and a hash that parts rows with the same one
    dealt = paths.repartitionByRange("lang", F.slice("items", 1, 2), F.xxhash64("items"))
    both = corrections(dealt.sortWithinPartitions("lang", "items"))

    kinds = each.groupBy("lang", "place", "p").agg(F.count("*").alias("m"))
    kinds = kinds.groupBy("lang", "place").agg(F.collect_list(F.struct("p", "m")).alias("kinds"))
    salt = F.pmod("place", F.lit(SHARES)).alias("salt")
    roster = groups.groupBy("lang").agg(F.collect_list(F.struct("place", "absent")).alias("roster"))
    roster = roster.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    own = groups.select("lang", "place", "absent", "v", salt).join(kinds, ["lang", "place"], "left").join(roster, ["lang", "salt"])
    apart = lambda r: F.abs(F.col("absent") - r["absent"])
    alone = lambda r: F.aggregate(F.coalesce("kinds", F.array()), F.lit(0).cast("long"), lambda x, k: x + k["m"] * (F.abs(k["p"] - r["absent"]) - apart(r)))
    others = F.filter("roster", lambda r: r["place"] != F.col("place"))
    other = F.transform(others, lambda r: F.struct(F.least(F.col("place"), r["place"]).alias("a"), F.greatest(F.col("place"), r["place"]).alias("b"), (alone(r) + F.when(F.col("place") < r["place"], F.col("v") * apart(r)).otherwise(0)).alias("value")))
    values = own.select("lang", F.inline(other)).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    values = values.select("lang", F.inline(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("value")))))
    name = lambda place, source: groups.select("lang", F.col("place").alias(place), F.col("source").alias(source))
    pairs = values.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).where(F.col("rank") <= most))
