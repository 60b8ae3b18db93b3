"""Crawling document roots, front matter, metadata, commits and transcripts."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

try:
    import yaml
except ImportError:  # then front matter has flat keys and plain values alone
    yaml = None


@dataclass(frozen=True)
class Root:
    """A folder of documents: what it holds and what of it is read."""

    path: str
    source: str
    repo: str | None = None
    recursive: bool = True
    extensions: tuple[str, ...] = (".md",)
    skip_folders: tuple[str, ...] = ("node_modules", ".git")
    max_bytes: int = 200_000


def expand(value: str, variables: dict[str, str]) -> str:
    """``${NAME}`` replaced, twice, so that variables can name others; an unknown or broken one is an error."""
    for _ in range(2):
        value = re.sub(r"\$\{(\w+)\}", lambda m: variables[m[1]] if m[1] in variables else _unknown(m[1]), value)
    if "${" in value:
        raise ValueError(f"malformed variable in {value!r}")
    return value


def _unknown(name: str) -> str:
    raise ValueError(f"unknown variable {name}")


def crawl(spark: SparkSession, roots: list[Root]) -> DataFrame:
    """path, relative, source, repo, recursive, modified, size, content: every file once, for the first root that holds it."""
    out = None
    for i, root in enumerate(roots):
        top = root.path.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(root.recursive).lower()).load(top)
        path = F.regexp_replace("path", "^file:/+", "/")
        relative = F.substr(path, F.lit(len(os.path.abspath(top)) + 2))
        ends = F.lit(False)
        for e in root.extensions:
            ends |= F.lower("path").endswith(e)
        keep = ends & (F.col("length") <= root.max_bytes)
        for folder in root.skip_folders:
            keep &= ~F.concat(F.lit("/"), relative).contains(f"/{folder}/")
        part = files.where(keep).select(
            path.alias("path"), relative.alias("relative"), F.lit(root.source).alias("source"), F.lit(root.repo).cast("string").alias("repo"),
            F.lit(root.recursive).alias("recursive"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
            F.decode("content", "utf-8").alias("content"), F.lit(i).alias("_root"),
        )
        out = part if out is None else out.unionByName(part)
    first = F.row_number().over(Window.partitionBy("path").orderBy("_root"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n", "_root")


FRONT = r"(?s)\A---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*(?:\r?\n|\z)"


def front_matter(content: Column) -> Column:
    """The keys and plain values before a document's body as a map; empty if there is no such block."""
    block = F.regexp_extract(content, FRONT, 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^[\w-]+:"))
    entry = lambda line: F.struct(F.regexp_extract(line, r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(line, r"^[\w-]+:", "")), "^['\"]|['\"]$", "").alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONT, "")


def _as_json(block: str) -> str | None:
    """A block of YAML as JSON, null if it is broken; dates stay as they are written, other scalars have their types.

    A block that is no map has no keys. Aliases are not followed, as a few lines of them can stand for any size.
    """
    loader = getattr(yaml, "CBaseLoader", yaml.BaseLoader)
    try:
        if any(isinstance(t, yaml.AliasToken) for t in yaml.scan(block, Loader=loader)):
            return None
        node = yaml.compose(block, Loader=loader)
        return json.dumps(_plain(node) if isinstance(node, yaml.MappingNode) else {}, ensure_ascii=False)
    except (yaml.YAMLError, RecursionError, ValueError):
        return None


#: Plain scalars that are not texts: fixed values.
_TYPED = {"true": True, "false": False, "null": None, "~": None, "": None}


def _plain(node) -> object:
    if isinstance(node, yaml.MappingNode):
        return {str(_plain(k)) if not isinstance(k, yaml.ScalarNode) else k.value: _plain(v) for k, v in node.value}
    if isinstance(node, yaml.SequenceNode):
        return [_plain(v) for v in node.value]
    if not node.style:  # plain
        if node.value.lower() in _TYPED:
            return _TYPED[node.value.lower()]
        if re.fullmatch(r"[-+]?(0|[1-9][0-9]{0,17})", node.value):
            return int(node.value)
        if re.fullmatch(r"[-+]?[0-9]+\.[0-9]+([eE][-+]?[0-9]+)?", node.value):
            return float(node.value)
    return node.value


@pandas_udf(StringType())
def _yaml_json(block: pd.Series) -> pd.Series:
    return block.map(lambda b: _as_json(b) if b else "{}")


def with_front(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``front``, the YAML before a text as VARIANT, and ``text``, what follows it.

    Lists, maps in maps, quoted, literal and folded texts keep their structure. Where there is no block, front is an
    empty object; a broken one stays part of the text, which is then the raw content. Null content has an empty object and no text.
    Only the block goes to Python, not the text.
    """
    if yaml is None:
        return files.withColumns({"front": F.to_variant_object(front_matter(F.col(content))), "text": body(F.col(content))})
    block = F.coalesce(F.regexp_extract(content, FRONT, 1), F.lit(""))
    rows = files.withColumn("_json", _yaml_json(block))
    text = F.when(F.col("_json").isNull(), F.col(content)).otherwise(body(F.col(content)))
    return rows.withColumns({"front": F.coalesce(F.try_parse_json("_json"), F.parse_json(F.lit("{}"))), "text": text}).drop("_json")


def metadata(files: DataFrame) -> DataFrame:
    """``files`` with repo, feature, doc_type, status, title and data, as their path, front matter and text say."""
    rows = with_front(files)
    parts, source = F.split("relative", "/"), F.col("source")
    rows = rows.withColumns({"_parts": parts, "_name": F.element_at(parts, -1)})
    part, name, n = F.col("_parts"), F.lower("_name"), F.size("_parts")
    front = lambda k: F.try_variant_get("front", f"$.{k}", "string")
    deep = source.isin("planning", "docs") & F.col("recursive") & (n > 1)
    feature = F.when(deep, F.when(F.get(part, F.lit(0)) != "_arquivo", F.get(part, F.lit(0))).when(n > 2, F.get(part, F.lit(1))))
    fixed = {"diario": "diario", "memoria": "memoria", "mapa": "mapa", "decisao": "decisao", "git": "commit", "code": "code", "notas": "nota"}
    kind = F.when(F.lit(False), "")
    for s, k in fixed.items():
        kind = kind.when(source == s, k)
    kind = kind.when(source == "github", F.when(F.get(part, F.lit(1)) == "cards", "card").otherwise("pr"))
    kind = kind.when(name == "prd.md", "prd").when(name.startswith("tech-spec"), "tech-spec").when(name == "spec.md", "spec")
    for k in ("handoff", "changelog", "readme"):
        kind = kind.when(name.startswith(k), k)
    kind = kind.when(F.array_contains(part, "tasks"), "task").otherwise("doc")
    rows = rows.withColumn("doc_type", kind)
    head = F.filter(F.slice(F.split("text", "\n"), 1, 15), lambda line: line.rlike("(?i)status\\s*[:：]\\s*.+"))
    said = F.substring(F.trim(F.regexp_replace(F.regexp_extract(F.get(head, F.lit(0)), "(?i)status\\s*[:：]\\s*(.+)", 1), r"\*", "")), 1, 120)
    archived = F.col("relative").startswith("_arquivo/") | F.col("relative").contains("/_arquivo/")
    status = F.when(source == "github", front("estado")).when(archived, "arquivado").when(F.col("doc_type").isin("task", "spec", "tech-spec"), F.nullif(said, F.lit("")))
    heading = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    title = F.when(source == "code", F.col("relative")).when((source == "memoria") & front("name").isNotNull(), front("name"))
    title = title.otherwise(F.coalesce(heading, F.regexp_replace("_name", r"(?i)\.md$", "")))
    day = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    data = F.coalesce(day(front("data")), day(F.col("_name")), F.date_format("modified", "yyyy-MM-dd"))
    repo = F.when((source == "github") & (n > 2), F.get(part, F.lit(0))).otherwise(F.col("repo"))
    return rows.withColumns({"repo": repo, "feature": feature, "status": status, "title": title, "data": data}).drop("_parts", "_name")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """sha, data, author, subject, body, files, cards from an exported log: records end in \\x1e, fields in \\x1f."""
    rows = spark.read.option("lineSep", "\x1e").text(path).where(F.trim("value") != "")
    field = lambda i: F.trim(F.get(F.split("value", "\x1f"), F.lit(i)))
    rows = rows.select(*(field(i).alias(c) for i, c in enumerate(("sha", "data", "author", "subject", "body"))), F.filter(F.split(field(5), r"\r?\n"), lambda f: f != "").alias("files"))
    numbers = F.transform(F.regexp_extract_all(F.concat_ws("\n", "subject", "body"), F.lit(r"#(\d{3,5})\b"), F.lit(1)), lambda n: n.cast("int"))
    return rows.withColumn("cards", F.array_distinct(numbers))


COMMIT = "sha string, repo string, data string, assunto string, cards array<int>, arquivos array<string>"


def commit_lines(spark: SparkSession, path: str) -> DataFrame:
    """Commits from JSON lines; lines that are broken are left out."""
    return spark.read.schema(COMMIT).option("mode", "DROPMALFORMED").json(path)


def commit_months(rows: DataFrame, files: int = 25) -> DataFrame:
    """One row for each repository and month: commits, cards, and a text that lists them, at most ``files`` files each."""
    more = F.size("arquivos") - files
    listed = F.concat(F.array_join(F.slice("arquivos", 1, files), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))
    line = F.struct("data", "sha", F.concat_ws(" ", "data", "assunto", listed).alias("line"))
    grouped = rows.groupBy("repo", F.substring("data", 1, 7).alias("month"))
    return grouped.agg(
        F.count("*").alias("commits"), F.size(F.array_distinct(F.flatten(F.collect_list("cards")))).alias("cards"),
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"),
    )


def item_markdown(items: DataFrame) -> DataFrame:
    """number and text of items (number, title, state, body, comments array<struct<date, author, body>>), comments by date."""
    one = lambda c: F.concat(F.lit("### "), c["author"], F.lit(" — "), c["date"], F.lit("\n\n"), c["body"])
    talk = F.array_join(F.transform(F.array_sort(F.coalesce("comments", F.array().cast("array<struct<date:string,author:string,body:string>>"))), one), "\n\n")
    return items.select("number", F.concat(F.lit("# "), "title", F.lit("\n\nestado: "), "state", F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n\n"), talk).alias("text"))


def transcripts(lines: DataFrame) -> DataFrame:
    """session, ts, role, text of transcript lines (session, value) whose content is a string or a list of blocks.

    Meta and side lines and what is not JSON are left out.
    """
    v = F.try_parse_json("value")
    rows = lines.withColumn("v", v).where("v IS NOT NULL")
    get = lambda p, t: F.try_variant_get("v", p, t)
    text = F.coalesce(
        F.array_join(F.filter(F.transform(F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), "array<struct<type:string,text:string>>"), lambda b: b["text"]), lambda t: t.isNotNull()), "\n"),
        get("$.message.content", "string"),
    )
    content = F.when(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")) == "STRING", get("$.message.content", "string")).otherwise(text)
    rows = rows.where(~F.coalesce(get("$.isMeta", "boolean"), F.lit(False)) & ~F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)))
    return rows.select("session", get("$.timestamp", "string").alias("ts"), get("$.type", "string").alias("role"), content.alias("text"))


def session_notes(turns: DataFrame, noise: str = r"^\s*(<|/|Caveat:)", width: int = 220) -> DataFrame:
    """For sessions with one user and two assistant messages at least: counts, and the users' messages in order, cut."""
    heard = (F.col("role") == "user") & (F.trim("text") != "") & ~F.coalesce(F.col("text").rlike(noise), F.lit(True))
    rows = turns.groupBy("session").agg(
        F.count_if(heard).alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"),
        F.array_sort(F.collect_list(F.when(heard, F.struct("ts", F.substring("text", 1, width).alias("text"))))).alias("said"),
    )
    return rows.where("asked >= 1 AND answered >= 2").withColumn("said", F.transform("said", lambda x: x["text"]))


def under_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``paths`` (path) that lie under a root (root), case aside: by the prefixes that a path has, not pair by pair."""
    flat = F.split(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(flat)), lambda n: F.array_join(F.slice(flat, F.lit(1), n), "/"))).alias("_root"))
    known = roots.select(F.regexp_replace(F.lower(F.replace("root", F.lit("\\"), F.lit("/"))), "/+$", "").alias("_root")).distinct()
    return paths.join(prefixes.join(known, "_root", "left_semi").select("path").distinct(), "path", "left_semi")


def rewritten(text: Column, block: Column, begin: str = "<!-- auto:begin -->", end: str = "<!-- auto:end -->") -> Column:
    """``text`` with what stands between the two marks replaced by ``block``; without marks, the block follows at the end."""
    has = F.contains(text, F.lit(begin)) & F.contains(text, F.lit(end))
    before, after = F.substring_index(text, begin, 1), F.substring_index(text, end, -1)
    new = F.concat(F.lit(begin + "\n"), block, F.lit("\n" + end))
    return F.when(has, F.concat(before, new, after)).otherwise(F.concat(text, F.lit("\n"), new))


def described(source: Column, description: Column, text: Column) -> Column:
    """The text of a note of the kind ``memoria`` after its description, any other as it is."""
    return F.when((source == "memoria") & description.isNotNull(), F.concat_ws("\n\n", description, text)).otherwise(text)


def write_commit_months(rows: DataFrame, path: str, files: int = 25) -> None:
    """One text for each repository and month, in a folder of its own; months that are written again replace themselves."""
    months = commit_months(rows, files)
    months.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("repo", "month").parquet(path)


def citing_commits(rows: DataFrame, files: int = 40) -> DataFrame:
    """Commits that cite a card, with at most ``files`` files each, as they are written line by line."""
    return rows.where(F.size("cards") > 0).withColumn("arquivos", F.slice("arquivos", 1, files))
