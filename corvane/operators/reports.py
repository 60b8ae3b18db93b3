"""Catalogue, timeline, activity and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalogue(docs: DataFrame, active_only: bool = False) -> DataFrame:
    """One row for each feature and repository: archived or not, its kinds of documents, how many, the last date."""
    rows = docs.where("feature IS NOT NULL").groupBy("feature", "repo").agg(
        F.max(F.when(F.col("status") == "arquivado", 1).otherwise(0)).alias("archived"),
        F.array_join(F.array_sort(F.collect_set("doc_type")), ",").alias("kinds"),
        F.count("*").alias("n_docs"),
        F.max("data").alias("last_date"),
    )
    return rows.where("archived = 0") if active_only else rows


def by_kind(kind: Column, first: list[str]) -> Column:
    """The place of a kind in a fixed order; kinds that it does not name come last."""
    out = F.lit(len(first))
    for i, k in reversed(list(enumerate(first))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def sections(rows: DataFrame, section: str, order: list[Column], caps: Column) -> DataFrame:
    """The first rows of each section up to its cap, with their rank, and how many more there are."""
    w = Window.partitionBy(section).orderBy(*order)
    sizes = rows.groupBy(section).agg(F.count("*").alias("in_section"))
    ranked = rows.withColumns({"rank": F.row_number().over(w), "cap": caps}).where("rank <= cap").join(sizes, section)
    return ranked.withColumn("more", F.greatest(F.lit(0), F.col("in_section") - F.col("cap")))


def percentile_by_index(values: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """For each group and point p, the value at position floor(p * (n - 1)) of the sorted values; nothing is interpolated.

    Values are counted first. Running counts go over distinct values, so no group is gathered in an array.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    counts = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(group))})
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1)) + 1
    return counts.groupBy(group).agg(*(F.min(F.when(F.col("upto") >= at(p), F.col(value))).alias(name) for name, p in points.items()))


def usage(calls: DataFrame) -> DataFrame:
    """For each tool: calls, empty answers, median and 90th percentile of time, mean size, share of word-only answers.

    The share leaves out calls whose ``semantic`` is null, and is null where all are. ``calls`` may lack that column.
    """
    if "semantic" not in calls.columns:
        calls = calls.withColumn("semantic", F.lit(None).cast("boolean"))
    part = calls.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if("empty").alias("empty"), F.round(F.avg("size"), 6).alias("mean_size"),
        F.round(F.count_if(~F.col("semantic")).cast("double") / F.nullif(F.count("semantic"), F.lit(0)), 6).alias("words_only"),
    )
    return part.join(percentile_by_index(calls, "tool", "ms", {"p50": 0.5, "p90": 0.9}), "tool", "left")


def per_day(calls: DataFrame, ts: str = "ts") -> DataFrame:
    return calls.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("calls"))


def latest(calls: DataFrame, n: int, ts: str, id_col: str) -> DataFrame:
    return calls.orderBy(F.col(ts).desc(), id_col).limit(n)


def with_successors(decisions: DataFrame) -> DataFrame:
    """Decisions (id, supersedes, ...) with ``superseded_by``, the latest that replaces each; null while one stands."""
    by = decisions.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("id")).agg(F.max("id").alias("superseded_by"))
    return decisions.join(by, "id", "left")


def beginnings(chunks: DataFrame, doc: str, place: str, text: str = "text", most: int = 40, width: int = 40_000) -> DataFrame:
    """Each document's first ``most`` chunks in order as one text of at most ``width`` characters. Null chunks are left out."""
    first = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(place))).where(F.col("_n") <= most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", text))), lambda x: x[text]), "\n")
    return first.groupBy(doc).agg(F.substring(joined, 1, width).alias(text))


def first_chunks(chunks: DataFrame, doc: str, place: str, text: str = "text") -> DataFrame:
    """The chunk that each document begins with; it is aggregated before it is shuffled."""
    return chunks.groupBy(doc).agg(F.min_by(text, place).alias(text))


def changes_by_repo(files: DataFrame, repo: str) -> DataFrame:
    """How many changed files each repository has, the most first; those of none are under ``?``."""
    return files.groupBy(F.coalesce(F.col(repo), F.lit("?")).alias(repo)).agg(F.count("*").alias("changes")).orderBy(F.col("changes").desc(), repo)


def reasons(rows: DataFrame, reason: str) -> DataFrame:
    """How often each reason was given, and its share of all rows."""
    counts = rows.groupBy(reason).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(reason, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def briefings(rows: DataFrame, section: str, date: str, as_of: str, caps: dict[str, int], days: int = 10, id_col: str = "path") -> DataFrame:
    """The latest rows of each section of ``caps``, up to its cap, none older than ``days``."""
    recent = rows.where(F.col(section).isin(*caps) & (F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days)))
    cap = F.element_at(F.create_map(*(F.lit(x) for pair in caps.items() for x in pair)), F.col(section))
    return sections(recent, section, [F.col(date).desc(), F.col(id_col)], cap)
