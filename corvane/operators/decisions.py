"""Decisions on record: the note, the row, the vector and the edges of each become current together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import headline, slug
from ..session import staged
from ..sources import manifest
from . import graph, reports, vector

SCHEMAS = {
    "documents": "path string, source string, title string, text string, data string",
    "decisions": "id long, ts timestamp, data string, kind string, scope string, repo string, fact string, why string, alternatives string, refs array<string>, supersedes long, title string, doc_path string",
    "vectors": "id long, embedding array<float>",
    "edges": "src string, dst string, rel string, origin string",
}


def note(title: Column) -> Column:
    """The text of a decision's note, front matter first; parts that it lacks are left out."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\n"))).otherwise("")
    said = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"\n**{name}:** "), c, F.lit("\n"))).otherwise("")
    scope = F.nullif(F.col("scope"), F.lit(""))
    return F.concat(
        F.lit("---\n"), line("data", F.col("data")), line("tipo", F.col("kind")), line("escopo", scope), line("substitui", F.col("supersedes")), F.lit("---\n\n# "), title, F.lit("\n\n"), F.col("fact"), F.lit("\n"),
        said("Por quê", F.col("why")), said("Descartado", F.col("alternatives")), said("Refs", F.array_join("refs", " · ")),
    )


def record(root: str, new: DataFrame, refs: DataFrame, features: DataFrame, files: DataFrame, encoder: Callable[[Column], Column] | None = vector.hashing_encoder) -> dict:
    """Puts decisions ``new`` (id, ts, kind, scope, repo, fact, why, alternatives, refs, supersedes) on record and returns the version.

    Each gets a note, whose path is its day, the slug of its fact and its id, a row, a vector of its fact, and edges to what its scope
    names among ``refs``, ``features`` and ``files``. All four tables become current with one commit; where another writer
    was faster, ``manifest.Stale`` is raised and none does. Without an encoder vectors wait for ``backfill``. Ids are new and not null; one that is on record is an error.
    """
    spark = new.sparkSession
    state = manifest.read(spark, root)
    title, day = headline(F.col("fact")), F.date_format("ts", "yyyy-MM-dd")
    rows = new.withColumns({"data": day, "title": title}).withColumn("doc_path", F.concat(F.lit("decisoes/"), "data", F.lit("-"), F.coalesce(F.nullif(slug(F.col("fact")), F.lit("")), F.lit("decisao")), F.lit("-"), F.col("id").cast("string"), F.lit(".md")))
    rows = staged(rows)
    if not rows.join(manifest.table(spark, state, "decisions", SCHEMAS["decisions"]), "id", "left_semi").isEmpty():
        raise ValueError("a decision of that id is on record")
    live = rows.select("id", "repo", "scope", F.lit(None).cast("long").alias("superseded"))
    tables = {
        "documents": rows.select(F.col("doc_path").alias("path"), F.lit("decisao").alias("source"), "title", note(F.col("title")).alias("text"), "data"),
        "decisions": rows,
        "vectors": rows.select("id", (encoder(F.col("fact")) if encoder else F.lit(None).cast("array<float>")).alias("embedding")),
        "edges": graph.decision_edges(live, refs, features, files),
    }
    return manifest.commit(spark, root, state, {name: [*state["tables"].get(name, []), manifest.write(_as(df, SCHEMAS[name]), root, name)] for name, df in tables.items()})


def _as(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]) for c in schema.split(", ")))


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The four tables of one version. Decisions have superseded_by, the latest that replaces each; of several vectors of a
    decision the one that is not null counts, and edges of decisions that are replaced are left out.
    """
    state = manifest.read(spark, root, version)
    out = {name: manifest.table(spark, state, name, schema) for name, schema in SCHEMAS.items()}
    out["decisions"] = reports.with_successors(out["decisions"])
    out["vectors"] = out["vectors"].groupBy("id").agg(F.first("embedding", ignorenulls=True).alias("embedding"))
    gone = out["decisions"].where("superseded_by IS NOT NULL").select(F.concat(F.lit("decisao:"), F.col("id").cast("string")).alias("src"))
    out["edges"] = out["edges"].join(gone, "src", "left_anti")
    return out


def backfill(spark: SparkSession, root: str, limit: int = 200, encoder: Callable[[Column], Column] = vector.hashing_encoder) -> dict:
    """Writes the vectors of up to ``limit`` decisions that have none, the lowest ids first, as one commit; a rerun does what is left."""
    state = manifest.read(spark, root)
    now = read(spark, root, state["version"])
    todo = now["decisions"].join(now["vectors"].where("embedding IS NOT NULL"), "id", "left_anti").orderBy("id").limit(limit)
    at = manifest.write(todo.select("id", encoder(F.col("fact")).alias("embedding")), root, "vectors")
    return manifest.commit(spark, root, state, {"vectors": [*state["tables"].get("vectors", []), at]})
