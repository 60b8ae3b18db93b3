"""An inverted index that stays: segments of postings in buckets of terms, tombstones, and counts that updates carry on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical
from ..operators.postings import BLOCK, ENDS, blocks, bucket, occurrences, parts, phrases_in_blocks, put_together, split, unblocked, unpacked
from ..session import clear_shuffles, staged
from ..streaming.incremental import differences
from . import manifest

#: Folders that a segment's terms are dealt over; a search reads the folders of its own terms.
BUCKETS = 64
#: Terms that a search names to the reader of the files, which skips what can't hold them; with more, their buckets alone are named.
NAMED = 100
#: Documents, on average, of a block that is put together anew.
BLOCK_DOCS = 2048
_NEW = {"version": -1, "tables": {}, "facts": {"segments": 0, "documents": 0, "length": 0}}


def _blocks(spark: SparkSession, root: str, state: dict) -> DataFrame:
    """All blocks of a version, of documents that have gone since too; part and bucket are folders, segment is in the part's name."""
    schema = f"{BLOCK.format(id=state['facts']['id'])}, part string, bucket int"
    folders = state["tables"].get("postings", [])
    rows = spark.read.schema(schema).option("basePath", f"{root}/postings").parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows.withColumn("segment", F.substring_index("part", "-", 1).cast("int"))


def _dead(spark: SparkSession, state: dict) -> DataFrame:
    """id and the segment below which nothing of it counts."""
    return manifest.table(spark, state, "dead", f"id {state['facts']['id']}, below int").groupBy("id").agg(F.max("below").alias("below"))


def _live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows (id, segment, ...) of documents that no later segment has replaced or removed."""
    dead = dead.withColumnRenamed("id", "_id")
    return rows.join(dead, (rows["id"] == dead["_id"]) & (rows["segment"] < dead["below"]), "left_anti")


def lengths(spark: SparkSession, root: str, state: dict) -> DataFrame:
    """id, length, segment and block of every document that the version has."""
    rows = _blocks(spark, root, state).where(F.col("bucket") == ENDS)
    rows = rows.select("segment", "block", F.inline(F.arrays_zip("ids", "data"))).select(F.col("ids").alias("id"), F.col("data").cast("long").alias("length"), "segment", "block")
    return _live(rows, _dead(spark, state))


def _write(packed: DataFrame, root: str, segment: int, kind: str) -> str:
    """A folder of blocks, sorted by term in each bucket; lengths have a bucket of their own.

    What is packed by bucket is dealt as a rebalance: adaptive execution splits the bucket of a frequent term over writers and puts
    small ones together, so files have an even size whatever the terms are. Rows are unpacked where they are written.
    """
    at = f"{root}/postings/part={segment:09d}-{uuid.uuid4().hex}"
    rows = unpacked(packed.hint("rebalance", "bucket"), kind)
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(at)
    return at


def create(docs: DataFrame, root: str, fields: list[str], id_col: str = "doc_id", buckets: int = BUCKETS) -> dict:
    """A new index of ``docs``; returns its version, as everything that changes it does. Ids are unique and not null."""
    facts = _NEW["facts"] | {"id": docs.schema[id_col].dataType.simpleString(), "fields": fields, "buckets": buckets}
    return update(docs.sparkSession, root, docs, id_col=id_col, base=_NEW | {"facts": facts})


def update(
    spark: SparkSession, root: str, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "doc_id",
    base: dict | None = None, also: dict[str, list[str]] | None = None,
) -> dict:
    """Puts new and changed documents in and takes ``removed`` ids out: one new segment, and a tombstone for each document
    of an older segment that is replaced or removed. Nothing else is read but ids and lengths, nothing is rewritten.

    Counts are carried on: what has gone is subtracted, what has come is added. A removed id that the index doesn't have is
    passed over; one that is changed and removed is removed. ``also`` names folders of other tables that become current with it.
    Raises ``manifest.Stale`` where another writer has been faster. Ids are unique and not null in ``changed``.
    """
    state = manifest.read(spark, root) if base is None else base
    facts = state["facts"]
    segment = facts["segments"]
    if removed is not None:
        removed = removed.select(F.col(id_col).alias("id")).distinct()
        changed = changed.join(removed.withColumnRenamed("id", id_col), id_col, "left_anti")
    at = _write(blocks(changed, facts["fields"], facts["buckets"], id_col), root, segment, facts["id"])
    tables = {"postings": [*state["tables"].get("postings", []), at]}
    new = lengths(spark, root, state | {"tables": {"postings": [at]}})
    came = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    gone = (0, 0)
    if segment:
        ids = new.select("id") if removed is None else new.select("id").unionByName(removed)
        old = staged(lengths(spark, root, state).join(ids, "id", "left_semi"))
        gone = old.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        tables["dead"] = [*state["tables"].get("dead", []), manifest.write(old.select("id", F.lit(segment).alias("below")), root, "dead")]
    clear_shuffles(spark)
    counts = {"segments": segment + 1, "documents": facts["documents"] + came["n"] - gone[0], "length": facts["length"] + came["length"] - gone[1]}
    return manifest.commit(spark, root, state, tables | (also or {}), facts | counts)


def refresh(files: DataFrame, root: str, fields: list[str], key: str = "path") -> dict:
    """Brings an index to the state of a crawl ``files`` (path, modified, size and the fields): what is new or changed by
    (modified, size) goes in, what the crawl doesn't have goes out, the same is not looked at. The first crawl makes the index.

    What was seen is a table of the same manifest, so index and crawl state become current together. A crawl without
    differences commits nothing.
    """
    spark = files.sparkSession
    state = manifest.read(spark, root)
    if state["version"] < 0:
        facts = _NEW["facts"] | {"id": files.schema[key].dataType.simpleString(), "fields": fields, "buckets": BUCKETS}
        state = _NEW | {"facts": facts}
    seen = files.select(key, "modified", "size")
    before = manifest.table(spark, state, "crawl", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema))
    changes = staged(differences(before, seen, key).where("change <> 'same'"))
    if changes.isEmpty() and state["version"] >= 0:
        return state
    fresh = files.join(changes.where("change IN ('new', 'changed')").select(key), key, "left_semi")
    return update(spark, root, fresh, changes.where("change = 'removed'").select(key), key, state, {"crawl": [manifest.write(seen, root, "crawl")]})


def compact(spark: SparkSession, root: str) -> dict:
    """Rewrites what is live of all segments as one, without tombstones; the folders of older versions stay for their readers.

    Blocks are put together anew where they fall into one of so many shares that one has some ``BLOCK_DOCS`` documents. They move
    packed, first by share and then by bucket.
    """
    state = manifest.read(spark, root)
    facts = state["facts"]
    share = F.pmod(F.xxhash64("segment", "block"), F.lit(facts["documents"] // BLOCK_DOCS + 1)).alias("share")
    rows = _blocks(spark, root, state).where(F.col("bucket") != ENDS).select(share, "segment", "term", "field", "ids", "data")
    live = lengths(spark, root, state).select(share, "segment", "id", "length")
    at = _write(put_together(rows, live, facts["buckets"]), root, 0, facts["id"])
    clear_shuffles(spark)
    return manifest.commit(spark, root, state, {"postings": [at], "dead": []}, facts | {"segments": 1})


def asked_blocks(spark: SparkSession, root: str, state: dict, words: DataFrame) -> DataFrame:
    """The blocks of the terms ``words`` (term), from their buckets alone."""
    # at most as many numbers as there are buckets, and terms that files can be skipped by
    wanted = [r["b"] for r in words.select(bucket(F.col("term"), state["facts"]["buckets"]).alias("b")).distinct().collect()]
    named = [r["term"] for r in words.limit(NAMED + 1).collect()]
    rows = _blocks(spark, root, state).where(F.col("bucket").isin(wanted))
    return rows.where(F.col("term").isin(named)) if len(named) <= NAMED else rows.join(words, "term", "left_semi")


def search(spark: SparkSession, root: str, queries: DataFrame, weights: dict[str, float], version: int | None = None) -> DataFrame:
    """(query_id, id, score, matched): BM25 as ``lexical.bm25`` gives it over the documents of a version.

    Only the buckets of asked terms are read, and the document count and mean length come from the manifest, so the
    work follows the postings of the asked terms. Single terms are counts; up to ``lexical.ASKED`` different tokens, the phrases
    among them are told in blocks, more are told by joins. Older versions can be searched as long as their folders are kept.
    """
    state = manifest.read(spark, root, version)
    asked, fields = lexical.asked_tokens(queries), state["facts"]["fields"]
    tokens = staged(queries.select("term", F.size(parts(F.col("term"))).alias("n")).distinct())
    words = tokens.where("n = 1").select(F.col("term").alias("token"), F.get(parts(F.col("term")), F.lit(0)).alias("term"))
    within = tokens.where("n > 1").select(F.explode(parts(F.col("term"))).alias("term")).distinct()
    blocks_of = lambda some: asked_blocks(spark, root, state, some)
    columns = ("token", "segment", "field", "id", "length", "tf")
    hits = unblocked(blocks_of(words.select("term").distinct()), "segment", positions=False).join(words, "term").select(*columns)
    phrases = None if asked is None else [t for t in asked if len(split(t)) > 1]
    if phrases:
        hits = hits.unionByName(phrases_in_blocks(blocks_of(within), phrases))
    elif phrases is None:
        rows = unblocked(blocks_of(within), "segment").withColumn("id", F.struct("id", "segment"))
        more = occurrences(rows, tokens.where("n > 1"))
        hits = hits.unionByName(more.select("token", "id.segment", "field", "id.id", "length", "tf"))
    hits = _live(hits, _dead(spark, state)).withColumn("field", F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1))
    if len(fields) == 1:  # then a document has a token once
        hits = staged(hits.select("id", F.col("token").alias("term"), (F.col("tf") * float(weights[fields[0]])).alias("tf"), "length"))
    else:
        hits = lexical.weighed(hits, weights)
    return lexical.scored(hits, queries, state["facts"]["documents"], state["facts"]["length"], asked is not None, by_term=True)
