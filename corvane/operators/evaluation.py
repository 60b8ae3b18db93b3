"""Pairs of a search and the read that follows, cases harvested from them, and ranking measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import coherent
from ..functions.text import last_two, style
from ..session import staged
from .containment import contained


def _since_epoch(events: DataFrame, ts: str) -> Column:
    """``ts`` as a number: microseconds for points in time, whatever the session's time zone, numbers as they are."""
    kind = events.schema[ts].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"CAST(CAST(`{ts}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20,6)) * 1000000").cast("long")
    return F.unix_micros(ts) if kind == "timestamp" else F.col(ts)


def following(events: DataFrame, session: str, ts: str, order: str, is_search: Column, is_read: Column, within: Column) -> DataFrame:
    """Each search with the first later read of its session, if that is within the interval, ends included.

    ``read`` is null otherwise; rows of one time follow each other by ``order``. A session is cut into stretches as long as the
    interval: the read that counts is in the search's own stretch, where rows are walked backwards with the last read seen
    in hand, or it is the first of the next one. So a session of any length spreads over tasks, and each row is looked at
    once. ``within`` is a constant: days and times for points in time, a number for numbers. Null sessions are one session, a null time has no following read.
    """
    at, wide, cut, nxt = (f"_following_{n}" for n in ("at", "wide", "cut", "next"))
    rows = events.withColumns({at: _since_epoch(events, ts), nxt: F.col(ts) + within})
    rows = rows.withColumn(wide, F.greatest(_since_epoch(rows, nxt) - F.col(at), F.lit(1).cast("long")))
    rows = rows.withColumn(cut, F.call_function("div", F.col(at), F.col(wide)))
    read = F.struct(F.col(ts).alias("at"), F.col(order).alias("id"))
    back = Window.partitionBy(session, cut).orderBy(F.col(ts).desc(), F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.where(is_read).groupBy(F.col(session).alias("_session"), (F.col(cut) - 1).alias("_cut")).agg(F.min(read).alias("_first"))
    rows = rows.withColumn(nxt, F.last(F.when(is_read, read), ignorenulls=True).over(back)).where(is_search)
    rows = rows.join(firsts, F.col(session).eqNullSafe(F.col("_session")) & (F.col(cut) == F.col("_cut")), "left")
    found = F.coalesce(nxt, "_first")
    return rows.withColumn("read", F.when(found["at"] <= F.col(ts) + within, found)).select(*events.columns, "read")


def harvest(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Every pair with its fate: repeated, missing, incoherent or kept; ``pairs`` has query, ts, id, path and filters.

    The first pair of a query, case and outer spaces aside, claims it, even if it is dropped later. ``docs`` has path
    and the struct ``doc`` of what filters look at.
    """
    w = Window.partitionBy(F.lower(F.trim("query"))).orderBy("ts", "id")
    rows = pairs.withColumn("_n", F.row_number().over(w)).join(docs, "path", "left")
    fate = F.when(F.col("_n") > 1, "repeated").when(F.col("doc").isNull(), "missing").when(~coherent("doc", "filters"), "incoherent").otherwise("kept")
    return rows.withColumns({"fate": fate, "style": style(F.col("query")), "expected": last_two(F.col("path"))}).drop("_n")


def ndcg5(rank: Column) -> Column:
    """The gain of one relevant result at ``rank``: 0 beyond 5, and for null or 0."""
    return F.when(rank.between(1, 5), 1 / F.log2(rank + 1.0)).otherwise(0.0)


def verdict(cases: DataFrame) -> DataFrame:
    """One row over cases (kind, rank, found, invalid): measures over positives and negatives; void if any is invalid."""
    yes, no = F.col("kind") == "positivo", F.col("kind") == "negativo"
    score = F.when(no, F.when(F.col("found") == 0, 1.0).otherwise(0.0)).otherwise(ndcg5(F.col("rank")))
    void = F.count_if(F.col("invalid").isNotNull()) > 0
    mean = F.round(F.avg(F.when(F.col("invalid").isNull(), score)), 6)
    back = F.avg(F.when(yes, F.coalesce(1.0 / F.nullif(F.col("rank"), F.lit(0)), F.lit(0.0))))
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(yes).alias("positives"), F.count_if(no).alias("negatives"), void.alias("void"),
        mean.alias("ndcg5"), F.count_if(yes & (F.col("rank") == 1)).alias("hit1"), F.count_if(yes & F.col("rank").between(1, 5)).alias("hit5"),
        F.round(back, 6).alias("mrr"), F.count_if(no & (F.col("found") == 0)).alias("empty_negatives"),
    )


def validity(error: Column, diagnosed: Column, semantic: Column, resolvable: Column) -> Column:
    """Why a case does not count, the first reason that holds; null if it counts."""
    return (
        F.when(error.isNotNull(), "erro").when(~diagnosed, "sem-diagnostico").when(~F.coalesce(semantic, F.lit(False)), "so-lexico")
        .when(~resolvable, "apodreceu")
    )


def compare(base: DataFrame, head: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Both runs case by case with the difference in gain; ``worse`` marks a drop beyond ``epsilon``."""
    b = base.select("case_id", ndcg5(F.col("rank")).alias("base"))
    h = head.select("case_id", ndcg5(F.col("rank")).alias("head"))
    rows = b.join(h, "case_id").withColumn("delta", F.round(F.col("head") - F.col("base"), 6))
    return rows.withColumn("worse", F.col("delta") < -epsilon)


def merged(manual: DataFrame, harvested: DataFrame, key: Column) -> DataFrame:
    """Manual cases as they are, and harvested ones whose query no manual case has."""
    taken = manual.select(key.alias("_k")).distinct()
    fresh = harvested.withColumn("_k", key).join(taken, "_k", "left_anti").drop("_k")
    return manual.unionByName(fresh)


def coverage_faults(cases: DataFrame, least: int = 60) -> DataFrame:
    """One row with what a set of cases lacks, as an array: too few cases, no code target, too few negatives."""
    few = F.when(F.count("*") < least, f"fewer than {least} cases")
    code = F.when(F.count_if(F.col("source") == "code") == 0, "no code target")
    negative = F.when(F.count_if(F.col("kind") == "negativo") < 2, "fewer than two negatives")
    flavours = F.when(F.count_distinct(F.when(F.col("kind") == "negativo", F.col("style"))) < 2, "negatives of one style")
    return cases.agg(F.count("*").alias("cases"), F.array_compact(F.array(few, code, negative, flavours)).alias("faults"))


def by_drop(compared: DataFrame) -> DataFrame:
    """Cases of a comparison, the biggest drop first."""
    return compared.orderBy("delta", "case_id")


def write_cases(cases: DataFrame, path: str, least: int = 60) -> None:
    """Write a set of cases as JSON lines with the keys in order, unless it lacks something: then nothing is written."""
    faults = coverage_faults(cases, least).first()["faults"]
    if faults:
        raise ValueError("; ".join(faults))
    cases.select(*sorted(cases.columns)).write.json(path)


def read_cases(spark: SparkSession, path: str, schema: str, style: str | None = None) -> DataFrame:
    """The cases of a set, of one style if one is named."""
    rows = spark.read.schema(schema).json(path)
    return rows if style is None else rows.where(F.col("style") == style)


def harvest_counts(found: DataFrame, harvested: DataFrame) -> DataFrame:
    """One row with what became of all searches: raw, without a read, missing, incoherent, repeated, kept.

    ``found`` is what ``following`` gave, ``harvested`` what ``harvest`` made of those with a read.
    """
    raw = found.agg(F.count("*").alias("raw"), F.count_if(F.col("read").isNull()).alias("unread"))
    fates = harvested.agg(*(F.count_if(F.col("fate") == f).alias(f) for f in ("missing", "incoherent", "repeated", "kept")))
    return raw.crossJoin(fates)  # of one row each


def resolved(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, path, doc): the documents that each case (case_id, expected, filters) stands for: a path that holds a fragment
    of ``expected``, whichever slash and case, and a document that the case's own filters let through. ``docs`` has path and doc.
    """
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    asked = cases.select("case_id", F.explode("expected").alias("fragment")).select("case_id", plain(F.col("fragment")).alias("fragment"))
    found = contained(asked.select(F.col("case_id").alias("fragment_id"), "fragment"), docs.select(F.col("path").alias("id"), plain(F.col("path")).alias("text")))
    rows = found.select(F.col("fragment_id").alias("case_id"), F.col("id").alias("path")).distinct().join(docs, "path").join(cases.select("case_id", "filters"), "case_id")
    return rows.where(coherent("doc", "filters")).select("case_id", "path", "doc")


def target_faults(cases: DataFrame, docs: DataFrame, repo: str, least: int = 60) -> DataFrame:
    """(fault, case_id): what a set of cases (case_id, kind, volatile, expected, filters) lacks, without a case where it is the set.

    Too few cases; a positive one that no document satisfies; no target that is code, none in ``repo``; fewer than two
    negatives, or none that is bound to stay, or none that may go stale. No fault gives no rows.
    """
    positive = cases.where("kind <> 'negativo'")
    found = staged(resolved(positive, docs))
    alone = positive.join(found.select("case_id").distinct(), "case_id", "left_anti").select(F.lit("no target satisfies the case").alias("fault"), "case_id")
    kinds = found.agg((F.count_if(F.col("doc.source") == "code") == 0).alias("code"), (F.count_if(F.col("doc.repo") == repo) == 0).alias("repo"))
    no = F.col("kind") == "negativo"
    sets = cases.agg(F.count("*").alias("n"), F.count_if(no).alias("no"), F.count_if(no & ~F.col("volatile")).alias("firm"), F.count_if(no & F.col("volatile")).alias("loose")).crossJoin(kinds)
    tests = {
        f"fewer than {least} cases": F.col("n") < least, "no code target": F.col("code"), f"no target in {repo}": F.col("repo"), "fewer than two negatives": F.col("no") < 2,
        "no structural negative": (F.col("no") >= 2) & (F.col("firm") == 0), "no volatile negative": (F.col("no") >= 2) & (F.col("loose") == 0),
    }
    told = F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in tests.items())))).alias("fault")
    return sets.select(told).withColumn("case_id", F.lit(None).cast(cases.schema["case_id"].dataType)).unionByName(alone)
