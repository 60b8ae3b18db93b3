"""Fusion, reranking, collapse and the hybrid search that puts them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_key

RRF_K = 60
#: Authority by kind of document, others 1: fixed values.
AUTHORITY = {
    "decisao": 1.06, "spec": 1.05, "tech-spec": 1.05, "prd": 1.04, "mapa": 1.03, "memoria": 1.024, "task": 1.01, "handoff": 1.01,
    "card": 1.0, "pr": 1.0, "diario": 1.0, "code": 1.0, "commit": 1.0, "doc": 0.99, "readme": 0.99, "changelog": 0.99, "nota": 0.98,
}


def fuse(*ranked: DataFrame) -> DataFrame:
    """(query_id, id, rrf, rank_0, rank_1, ...): the sum of 1 / (60 + rank) over ranked lists (query_id, id, rank)."""
    lists = None
    for i, r in enumerate(ranked):
        part = r.select("query_id", "id", F.lit(i).alias("list"), "rank")
        lists = part if lists is None else lists.unionByName(part)
    ranks = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(ranked))]
    fused = lists.groupBy("query_id", "id").agg(*ranks)
    parts = [F.coalesce(1.0 / (RRF_K + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(ranked))]
    return fused.withColumn("rrf", sum(parts[1:], parts[0]))


def authority(doc_type: Column, status: Column, date: Column, as_of: str) -> Column:
    """What a hit's score is multiplied by: its kind, whether it is archived, how old it is. Future dates are recent."""
    table = F.create_map(*(x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))))
    age = F.datediff(F.lit(as_of).cast("date"), date)
    recent = F.when(age <= 30, 1.015).when(age > 365, 0.98).otherwise(1.0)
    return F.coalesce(F.try_element_at(table, doc_type), F.lit(1.0)) * F.when(status == "arquivado", 0.92).otherwise(1.0) * recent


def collapsed(hits: DataFrame, group: list[str], order: list[Column], label: str, text: str = "text", per_doc: int | None = None, doc: str = "doc") -> DataFrame:
    """The first hit of each content in each group, with how many fell together and under which other labels.

    With ``per_doc``, a document then keeps so many hits, and first hits of documents go before second ones. This form
    tests content first and documents after; it differs from the row-by-row one where a hit that its document crowds
    out has content that a later hit repeats.
    """
    keyed = hits.withColumn("_key", collapse_key(F.col(text)))
    key = [*group, "_key"]
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    counted = keyed.groupBy(*key, F.col(label).alias("_label")).agg(F.count("*").alias("_times"))
    counted = counted.groupBy(*key).agg(F.sum("_times").alias("_c"), F.collect_list(F.struct("_label", "_times")).alias("_labels"))
    counted = counted.select(*(F.col(c).alias(f"_of_{c}") for c in key), "_c", "_labels")
    alike = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key]
    first = first.join(counted, alike)
    # the first hit's own label counts where another hit has it too
    others = F.filter("_labels", lambda x: x["_label"].isNotNull() & ((x["_times"] > 1) | ~x["_label"].eqNullSafe(F.col(label))))
    first = first.withColumns({"also_in": F.array_sort(F.transform(others, lambda x: x["_label"])), "collapsed": F.col("_c") - 1})
    first = first.drop("_key", "_c", "_labels", *(f"_of_{c}" for c in key))
    if per_doc is None:
        return first
    own = Window.partitionBy(*group, doc).orderBy(*order)
    return first.withColumn("doc_rank", F.row_number().over(own)).where(F.col("doc_rank") <= per_doc)


def greedy_collapse(hits: DataFrame, limit: int, per_doc: int = 2) -> DataFrame:
    """The row-by-row form, exact in every corner: ``hits`` has query_id, id, doc, label, text and position.

    A query's hits are the pools of its branches, some 180 rows at most, so a query is one bounded group, folded in order of
    position. A hit whose content is there falls together with it; one whose document has ``per_doc`` hits goes and leaves its content
    free; the others stay. Null texts are one content.
    """
    key = F.coalesce(collapse_key(F.col("text")), F.lit("\0")).alias("key")
    rows = hits.select("query_id", "id", "doc", "label", "position", key)
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "doc", "label", "key"))).alias("hits"))
    kind = f"array<struct<id:{hits.schema['id'].dataType.simpleString()},doc:{hits.schema['doc'].dataType.simpleString()},key:string,nth:int,also_in:array<string>,collapsed:int>>"

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: k["key"]), x["key"])
        of_doc = F.size(F.filter(kept, lambda k: k["doc"].eqNullSafe(x["doc"])))
        also = lambda k: F.when((x["label"] != "") & ~F.array_contains(k["also_in"], x["label"]), F.array_append(k["also_in"], x["label"])).otherwise(k["also_in"])
        joined = lambda k: F.struct(k["id"].alias("id"), k["doc"].alias("doc"), k["key"].alias("key"), k["nth"].alias("nth"), also(k).alias("also_in"), (k["collapsed"] + 1).alias("collapsed"))
        new = F.struct(x["id"].alias("id"), x["doc"].alias("doc"), x["key"].alias("key"), (of_doc + 1).alias("nth"), F.array().cast("array<string>").alias("also_in"), F.lit(0).alias("collapsed"))
        more = F.when(of_doc < per_doc, F.array_append(kept, new)).otherwise(kept)
        return F.when(at > 0, F.transform(kept, lambda k, i: F.when(i == at - 1, joined(k)).otherwise(k))).otherwise(more).cast(kind)

    rows = rows.withColumn("kept", F.aggregate("hits", F.array().cast(kind), step))
    best = F.concat(F.filter("kept", lambda k: k["nth"] == 1), F.filter("kept", lambda k: k["nth"] > 1))
    rows = rows.select("query_id", F.posexplode(F.slice(best, 1, limit)).alias("at", "k"))
    return rows.select("query_id", "k.id", "k.doc", "k.also_in", "k.collapsed", (F.col("at") + 1).alias("place"))


def hybrid(
    lexical: DataFrame, semantic: DataFrame | None, docs: DataFrame, as_of: str, limit: int, id_col: str = "doc_id", per_doc: int | None = None, doc: str = "doc"
) -> DataFrame:
    """Ranked results for each query: both branches fused, weighed by authority, collapsed and cut to ``limit``.

    Without a semantic branch the search goes on with words alone and says so in ``semantic``. Only the fused ids meet
    their documents, after the cut of each branch. ``docs`` has id, doc_type, status, data, source and text. With
    ``per_doc``, a document ``doc`` has so many hits at most, and first hits of documents go before second ones.
    """
    fused = fuse(lexical, semantic) if semantic is not None else fuse(lexical).withColumn("rank_1", F.lit(None).cast("int"))
    rows = docs.withColumnRenamed(id_col, "id").join(fused, "id")
    rows = rows.withColumn("score", F.round(F.col("rrf") * authority(F.col("doc_type"), F.col("status"), F.col("data"), as_of), 8))
    order = [F.col("score").desc(), F.col("rank_0").asc_nulls_last(), F.col("rank_1").asc_nulls_last(), F.col("id")]
    kept = collapsed(rows, ["query_id"], order, "doc_type", per_doc=per_doc, doc=doc)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*([] if per_doc is None else ["doc_rank"]), *order))
    kept = kept.withColumn("place", place).where(F.col("place") <= limit).withColumn("semantic", F.lit(semantic is not None))
    return kept.select("query_id", "place", "id", "score", "collapsed", "rank_0", "rank_1", "semantic")


def diagnostics(lexical: DataFrame, semantic: DataFrame | None, docs: DataFrame) -> DataFrame:
    """query_id, lexical, vector, semantic, collapsed: how many hits each branch of a search had, whether there was a vector
    to search with, and how many hits fell together with one of the same content. ``docs`` has id and text.
    """
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    none = lexical.select("query_id", "id").limit(0)
    near = none if semantic is None else semantic
    hits = lexical.select("query_id", "id").unionByName(near.select("query_id", "id")).distinct()
    keys = docs.join(hits.select("id").distinct(), "id", "left_semi").select("id", collapse_key(F.col("text")).alias("key"))
    fell = hits.join(keys, "id").groupBy("query_id").agg((F.count("*") - F.count_distinct("key")).alias("collapsed"))
    rows = count(lexical, "lexical").join(count(near, "vector"), "query_id", "full").join(fell, "query_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lexical", "vector", "collapsed")})
    return rows.select("query_id", "lexical", "vector", (F.col("vector") > 0).alias("semantic"), "collapsed")
