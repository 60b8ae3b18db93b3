"""The entity graph: merged nodes, distinct edges, citations resolved where they are unique, neighbours, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_files, cited_numbers, explicit_number
from ..session import spread, staged
from .containment import contained


def merged_entities(claims: DataFrame) -> DataFrame:
    """One row for each key from claims (key, seq, kind, repo, title, status): kind and repo of the first, the rest the last not null."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return claims.groupBy("key").agg(F.min_by("kind", "seq").alias("kind"), F.min_by("repo", "seq").alias("repo"), last("title"), last("status"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, rel, origin) without loops, each once with the origin of the lowest seq."""
    return edges.where("src != dst").groupBy("src", "dst", "rel").agg(F.min_by("origin", "seq").alias("origin"))


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def unique_suffixes(files: DataFrame, lengths: range = range(2, 6)) -> tuple[DataFrame, DataFrame]:
    """(suffix, path) for suffixes of two to five segments, and (name, path) for base names, that name one file alone."""
    parts = F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/")
    tails = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.size(parts), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))), lambda s: s.isNotNull())
    only = lambda df, c: df.groupBy(c).agg(F.count("*").alias("_n"), F.first("path").alias("path")).where("_n = 1").drop("_n")
    suffixes = only(files.select("path", F.explode(tails).alias("suffix")), "suffix")
    return suffixes, only(files.select("path", F.element_at(parts, -1).alias("name")), "name")


def resolve_files(citations: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, cited, target): by a suffix that one file has, else by a base name that one file has; others do not resolve."""
    suffixes, names = unique_suffixes(files)
    rows = citations.withColumns({"suffix": F.col("cited"), "name": F.element_at(F.split("cited", "/"), -1)})
    rows = rows.join(suffixes.withColumnRenamed("path", "_s"), "suffix", "left").join(names.withColumnRenamed("path", "_n"), "name", "left")
    return rows.withColumn("target", F.coalesce("_s", "_n")).where("target IS NOT NULL").select("doc", "cited", "target")


def resolve_numbers(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, number, target): the ref (repo, number, key) of the citing repository, else the one that alone has the number."""
    alone = refs.groupBy("number").agg(F.count("*").alias("_n"), F.first("key").alias("_alone")).where("_n = 1").drop("_n")
    own = refs.select("repo", "number", F.col("key").alias("_own"))
    rows = citations.join(own, ["repo", "number"], "left").join(alone, "number", "left")
    return rows.withColumn("target", F.coalesce("_own", "_alone")).where("target IS NOT NULL").select("doc", "number", "target")


def document_edges(docs: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """Every edge that documents give: docs (path, key, source, repo, feature, text, branch) to features, refs and files.

    Texts are looked at once: what they cite is written, and all rules read that.
    """
    col = F.col
    branch = F.coalesce("branch", F.lit(""))
    cites = staged(docs.select(
        "key", "source", "repo", "feature", explicit_number(col("text"), col("branch")).alias("said"), F.regexp_extract(branch, r"/\d{3,5}-(.+)$", 1).alias("slug"),
        cited_numbers(col("text")).alias("numbers"), cited_files(col("text")).alias("files"),
    ))
    edge = lambda rows, seq, src, dst, rel, origin: rows.select(F.lit(seq).alias("seq"), src.alias("src"), dst.alias("dst"), rel.alias("rel"), origin.alias("origin"))
    to_feature = lambda c: F.concat(F.lit("feature:"), c)
    # a document's source comes along with what it cites, so resolving needs no join back
    doc = F.struct("key", "source").alias("doc")
    feature = edge(cites.where("feature IS NOT NULL AND source NOT IN ('code', 'github', 'diario')"), 1, col("key"), to_feature("feature"), F.lit("pertence"), F.lit("planning"))
    said = resolve_numbers(cites.where("source IN ('github', 'diario', 'planning') AND said IS NOT NULL").select(doc, "repo", col("said").alias("number")), refs)
    said = edge(said, 2, col("doc.key"), col("target"), F.lit("implementa"), col("doc.source"))
    known = cites.where("feature IS NOT NULL").select(col("feature").alias("slug")).distinct()
    branched = edge(cites.where("slug <> ''").join(known, "slug"), 3, col("key"), to_feature("slug"), F.lit("pertence"), F.lit("rotulo"))
    last = refs.where("key LIKE 'card:%'").groupBy("number").agg(F.max("key").alias("card"))
    numbered = known.withColumn("number", F.nullif(F.regexp_extract("slug", r"^(\d{3,5})-", 1), F.lit("")).cast("int")).join(last, "number")
    numbered = edge(numbered, 4, to_feature("slug"), col("card"), F.lit("implementa"), F.lit("slug"))
    numbers = resolve_numbers(cites.select(doc, "repo", F.explode("numbers").alias("number")), refs)
    numbers = edge(numbers, 5, col("doc.key"), col("target"), F.when(col("doc.source") == "diario", "registra").otherwise("referencia"), F.lit("rotulo"))
    named = resolve_files(cites.select(col("key").alias("doc"), F.explode("files").alias("cited")), files)
    named = edge(named, 6, col("doc"), F.concat(F.lit("arquivo:"), "target"), F.lit("toca"), F.lit("rotulo"))
    out = feature
    for more in (said, branched, numbered, numbers, named):
        out = out.unionByName(more)
    return distinct_edges(out)


def decision_edges(decisions: DataFrame, refs: DataFrame, features: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of decisions (id, repo, scope, superseded) to the number, feature or file that their scope names."""
    live = decisions.where("superseded IS NULL AND scope IS NOT NULL").withColumn("doc", F.concat(F.lit("decisao:"), F.col("id").cast("string")))
    by_number = resolve_numbers(live.select("doc", "repo", F.regexp_extract("scope", r"^#?(\d{1,5})$", 1).try_cast("int").alias("number")).where("number IS NOT NULL"), refs)
    by_feature = live.join(features.select(F.col("feature").alias("scope")).distinct(), "scope").select("doc", F.concat(F.lit("feature:"), "scope").alias("target"))
    by_file = resolve_files(live.select("doc", F.col("scope").alias("cited")), files).select("doc", F.concat(F.lit("arquivo:"), "target").alias("target"))
    rows = by_number.select("doc", "target").unionByName(by_feature).unionByName(by_file)
    return distinct_edges(rows.select(F.lit(7).alias("seq"), F.col("doc").alias("src"), F.col("target").alias("dst"), F.lit("decide").alias("rel"), F.lit("lembrar").alias("origin")))


def commit_edges(commits: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of commits (key, repo, cards, files) that resolve to a ref at least: to refs, and to files."""
    at = resolve_numbers(commits.select(F.col("key").alias("doc"), "repo", F.explode("cards").alias("number")), refs)
    rel = F.when(F.col("target").startswith("card:"), "implementa").otherwise("pertence")
    to_refs = at.select(F.lit(8).alias("seq"), F.col("doc").alias("src"), F.col("target").alias("dst"), rel.alias("rel"), F.lit("git").alias("origin"))
    some = commits.join(at.select(F.col("doc").alias("key")).distinct(), "key", "left_semi")
    touched = resolve_files(some.select(F.col("key").alias("doc"), F.explode("files").alias("cited")), files)
    to_files = touched.select(F.lit(9).alias("seq"), F.col("doc").alias("src"), F.concat(F.lit("arquivo:"), "target").alias("dst"), F.lit("toca").alias("rel"), F.lit("git").alias("origin"))
    return distinct_edges(to_refs.unionByName(to_files))


def neighbours(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, neighbour, rel, direction): every edge at a target, both ways, as a bag; ``targets`` is a batch (target)."""
    wanted = targets
    out = edges.join(wanted, edges["src"] == wanted["target"]).select("target", F.col("dst").alias("neighbour"), "rel", F.lit("out").alias("direction"))
    back = edges.join(wanted, edges["dst"] == wanted["target"]).select("target", F.col("src").alias("neighbour"), "rel", F.lit("in").alias("direction"))
    return out.unionByName(back)


def round_robin(rows: DataFrame, group: str, kind: str, kinds: list[str], order: list[Column], limit: int) -> DataFrame:
    """Up to ``limit`` rows of each group, one of each kind in turn, kinds in their order, ``order`` inside a kind."""
    turn = F.row_number().over(Window.partitionBy(group, kind).orderBy(*order))
    rows = rows.withColumns({"turn": turn, "kind_order": F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))}).where((F.col("kind_order") > 0) & (F.col("turn") <= limit))
    place = F.row_number().over(Window.partitionBy(group).orderBy("turn", "kind_order"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def first_match(steps: DataFrame) -> DataFrame:
    """(request, key): of matches (request, step, key), the lowest step decides; more than one key there is no answer."""
    per = steps.select("request", "step", "key").distinct().groupBy("request", "step").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    first = per.groupBy("request").agg(F.min_by(F.struct("n", "key"), "step").alias("best"))
    return first.where("best.n = 1").select("request", "best.key")


def lookup(entities: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Entities that a text names: by number if it has one and some match, else by part of key or title, files first."""
    import re

    m = re.search(r"\d{3,5}", text)
    part = entities.where(F.lower("key").contains(text.strip().lower()) | F.lower("title").contains(text.strip().lower()))
    part = part.withColumn("by", F.lit(1))
    if m:
        number = entities.where(F.col("key").like(f"%#{m[0]}") | F.col("key").like(f"feature:{m[0]}-%")).withColumn("by", F.lit(0))
        part = number.unionByName(part.join(F.broadcast(number.agg(F.count("*").alias("_c"))), how="cross").where("_c = 0").drop("_c"))
    return part.orderBy("by", (F.col("kind") == "arquivo").desc(), "key").limit(limit).drop("by")


def lookups(entities: DataFrame, requests: DataFrame, limit: int = 10) -> DataFrame:
    """(request, key, place): what ``lookup`` finds for each of ``requests`` (request, text), ``limit`` at most, in its order.

    Numbers are keys of a join. Requests whose number names nothing, or that have none, go to keys and titles by trigrams, so no
    request looks at every entity. What a number or a text finds is ranked and cut once, before it meets those that ask for it. A
    blank request finds nothing. Entities of one key are one.
    """
    asked = staged(requests.select("request", F.lower(F.trim("text")).alias("text"), F.nullif(F.regexp_extract("text", r"[0-9]{3,5}", 0), F.lit("")).alias("number")))
    rows = staged(spread(entities.select("key", "kind", "title")))

    def best(found: DataFrame, of: str) -> DataFrame:
        order = Window.partitionBy(of).orderBy((F.col("kind") == "arquivo").desc(), "key")
        return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)

    named = F.array(F.regexp_extract("key", r"#([^#]*)$", 1), F.regexp_extract("key", r"^feature:([0-9]{3,5})-", 1))
    numbered = rows.select("key", "kind", F.explode(F.array_distinct(named)).alias("sought")).where("sought <> ''")
    numbers = asked.select(F.col("number").alias("sought")).distinct()
    by_number = best(numbered.join(numbers, "sought", "left_semi"), "sought").drop("place").withColumnRenamed("sought", "number")
    by_number = staged(asked.join(by_number, "number").select("request", "key", "kind"))
    left = asked.join(by_number.select("request").distinct(), "request", "left_anti").select("request", F.col("text").alias("sought"))
    words = left.select(F.col("sought").alias("fragment_id"), F.col("sought").alias("fragment")).distinct()
    found = None
    for c in ("key", "title"):
        part = contained(words, rows.select(F.col("key").alias("id"), F.lower(c).alias("text")))
        found = part if found is None else found.unionByName(part)
    found = found.distinct().select(F.col("fragment_id").alias("sought"), F.col("id").alias("key"))
    by_part = best(found.join(rows.select("key", "kind"), "key").select("sought", "key", "kind"), "sought")
    hits = by_number.unionByName(left.join(by_part, "sought").select("request", "key", "kind"))
    return best(hits, "request").select("request", "key", "place")


def described_neighbours(edges: DataFrame, targets: DataFrame, docs: DataFrame, limit: int, most: int = 4) -> DataFrame:
    """target, rel and the neighbours under it with their kinds, ``limit`` at most for a target, for the first ``most`` targets.

    Edges of both directions count once. ``docs`` has key and doc_type; a neighbour without a document has none.
    """
    few = targets.select("target").distinct().orderBy("target").limit(most)
    near = neighbours(edges, few).select("target", "neighbour", "rel").distinct().join(docs.withColumnRenamed("key", "neighbour"), "neighbour", "left")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("rel", "neighbour"))).where(F.col("_n") <= limit)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_n", "neighbour", "doc_type"))), lambda x: F.concat(x["neighbour"], F.lit(" "), F.coalesce(x["doc_type"], F.lit("-"))))
    return near.groupBy("target", "rel").agg(F.count("*").alias("n"), listed.alias("listed"))
