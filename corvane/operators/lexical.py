"""Lexical search: postings, BM25 over weighted fields, two passes, mentions and snippets, for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, terms
from ..session import staged
from . import postings

K1, B, POOL, LEAST_IDF = 1.2, 0.75, 60, 1e-6
#: Tokens of a batch of queries that are looked for where texts are read; with more, they meet the postings in a join.
ASKED = 20_000


def queries_of(spark, texts: dict[int, list[str]]) -> DataFrame:
    """(query_id, term): one row for each token of each query."""
    rows = [(q, t) for q, ts in texts.items() for t in dict.fromkeys(ts)]
    return spark.createDataFrame(rows, "query_id int, term string")


def asked_tokens(queries: DataFrame) -> list[bytes] | None:
    """The different tokens of ``queries``, none if there are more than ``ASKED``."""
    tokens = [(r["term"] or "").encode() for r in queries.select("term").distinct().limit(ASKED + 1).collect()]
    return tokens if len(tokens) <= ASKED else None


@dataclass(frozen=True)
class Index:
    """What a search reads, written once: the tf of asked tokens, or with ``whole`` the postings of all terms."""

    rows: DataFrame
    whole: bool


def index(chunks: DataFrame, fields: dict[str, float], id_col: str = "doc_id", queries: DataFrame | None = None) -> Index:
    """The terms of ``chunks``, written once for all searches: all of them, or with ``queries`` what their tokens have, as
    long as these are at most ``ASKED``. A row's length is over all fields.
    """
    tokens = None if queries is None else asked_tokens(queries)
    if tokens is None:
        return Index(staged(postings.postings(chunks, list(fields), id_col)), True)
    return Index(staged(postings.weighted(chunks, fields, tokens, id_col)), False)


def weighed(hits: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(id, term, tf, length) of occurrences: one row for each token of each document, fields by their weights, written."""
    weight = F.element_at(F.create_map(*(F.lit(x) for f, w in fields.items() for x in (f, float(w)))), F.col("field"))
    return staged(hits.groupBy("id", F.col("token").alias("term")).agg(F.sum(F.col("tf") * weight).alias("tf"), F.max("length").alias("length")))


def scored(hits: DataFrame, queries: DataFrame, documents: int, length: int, few: bool, by_term: bool = False) -> DataFrame:
    """(query_id, id, score, matched) from hits (id, term, tf, length), how many documents there are and how long all together.

    ``few`` says that the queries have at most ``ASKED`` tokens: then so many counts go to the hits, which stay where
    they are and are added up there first, a document's being neighbours. Hits that lie ``by_term`` are dealt by document before
    they meet the queries, so that what is dealt is hits and not each query's sums.
    """
    n, mean = F.lit(float(documents)), F.lit(length / documents if documents else 0.0)
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    df = F.broadcast(df) if few else df
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    rows = (hits.repartition("id") if few and by_term else hits).join(df, "term").join(queries, "term")
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def bm25(chunks: DataFrame, queries: DataFrame, fields: dict[str, float], id_col: str = "doc_id", indexed: Index | None = None) -> DataFrame:
    """(query_id, id, score, matched): BM25 of every chunk that has a token of the query; matched counts its tokens.

    A token with underscores is the phrase of its parts (``snake_case``: snake, then case) and counts as one term. A
    token without letters and digits matches nothing. Statistics are over the whole table, before any filter. ``indexed`` is what
    ``index`` made of the chunks; without it, one is made for these queries. No side is hinted for broadcast.
    """
    own = index(chunks, fields, id_col, queries) if indexed is None else indexed
    # two numbers, whatever the corpus
    n, total = own.rows.where("term IS NULL").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    hits = own.rows.where("term IS NOT NULL")
    if own.whole:
        hits = weighed(postings.occurrences(hits, queries), fields)
    return scored(hits, queries, n, total, not own.whole)


def top(scored: DataFrame, k: int = POOL, order: tuple[Column, ...] | None = None) -> DataFrame:
    """The best ``k`` rows of each query with their rank; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(*(order or (F.col("score").desc(), F.col("id"))))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def two_pass(chunks: DataFrame, strict: DataFrame, wide: DataFrame, fields: dict[str, float], id_col: str = "doc_id", allowed: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """(query_id, id, score, pass, rank): rows with every term first; where they are fewer than ``pool``, rows with any.

    ``strict`` has the queries' own terms, ``wide`` these and synonyms. A query of one term has no second pass. The
    second pass brings ``pool`` rows of its own, less those already there, and ranks run on across the seam.
    ``allowed`` holds the ids that the filters let through.
    """
    keep = lambda df: df if allowed is None else df.join(allowed.select(F.col(id_col).alias("id")), "id", "left_semi")
    rows = index(chunks, fields, id_col, strict.unionByName(wide))
    sizes = strict.groupBy("query_id").agg(F.count("*").alias("n"))
    first = keep(bm25(chunks, strict, fields, id_col, rows)).join(sizes, "query_id").where("matched = n")
    first = staged(top(first, pool).select("query_id", "id", "score", F.lit(0).alias("pass")))
    short = sizes.join(first.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left")
    short = short.where((F.coalesce("c", F.lit(0)) < pool) & (F.col("n") > 1)).select("query_id")
    second = top(keep(bm25(chunks, wide.join(short, "query_id", "left_semi"), fields, id_col, rows)), pool)
    second = second.join(first, ["query_id", "id"], "left_anti").select("query_id", "id", "score", F.lit(1).alias("pass"))
    w = Window.partitionBy("query_id").orderBy("pass", F.col("score").desc(), "id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(w))


def mentions(docs: DataFrame, words: list[str], text_col: str = "text", date_col: str = "data", limit: int = 15) -> DataFrame:
    """Documents that hold all words, the latest first; if there are none, those that hold any."""
    found = F.size(F.array_intersect(terms(F.col(text_col)), F.array(*map(F.lit, words))))
    rows = docs.withColumn("found", found).where("found > 0").drop(text_col).distinct()
    best = rows.agg(F.max("found").alias("best"))
    floor = F.when(F.col("best") == len(set(words)), F.col("best")).otherwise(1)
    rows = rows.join(F.broadcast(best), how="cross").where(F.col("found") >= floor)
    return rows.orderBy(F.col(date_col).desc_nulls_last(), "doc_id").limit(limit).drop("found", "best")


def mention_terms(feature: str) -> list[str]:
    """The words of a feature's slug: three letters or more, no bare numbers, then the number that it begins with."""
    parts = feature.replace("_", "-").split("-")
    words = [p for p in parts if len(p) >= 3 and not p.isdigit()]
    return words + [parts[0]] if len(parts) > 1 and parts[0].isdigit() and 3 <= len(parts[0]) <= 5 else words


def snippet(text: Column, words: list[str], width: int = 40) -> Column:
    """The first window of ``width`` words that holds most of ``words``, these in «», cut ends shown as an ellipsis.

    Windows start at a found word, so a text has as many as it has hits.
    """
    each = F.split(F.trim(text), r"\s+")
    hit = lambda w: F.size(F.array_intersect(terms(w), F.array(*map(F.lit, words)))) > 0

    def cut(pairs: Column) -> Column:
        starts = F.filter(F.transform(pairs, lambda p, i: F.when(p["h"], i)), lambda i: i.isNotNull())
        tried = F.transform(starts, lambda s: F.struct(F.size(F.filter(F.slice(pairs, s + 1, width), lambda p: p["h"])).alias("n"), (-s).alias("s")))
        start = F.coalesce(-F.array_max(tried)["s"], F.lit(0))
        body = F.transform(F.slice(pairs, start + 1, width), lambda p: F.when(p["h"], F.concat(F.lit("«"), p["w"], F.lit("»"))).otherwise(p["w"]))
        return F.concat(F.when(start > 0, "… ").otherwise(""), F.array_join(body, " "), F.when(start + width < F.size(pairs), " …").otherwise(""))

    return F.transform(F.array(F.transform(each, lambda w: F.struct(w.alias("w"), hit(w).alias("h")))), cut)[0]


def folded_text(*parts: Column) -> Column:
    return fold(F.concat_ws(" ", *parts))
