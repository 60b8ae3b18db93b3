"""Documents cut into passages, and sections by heading: column expressions over the lines of a text, code in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Neighbours are joined up to this many characters; longer sections are cut; into pieces of this size.
JOINED, WHOLE, PIECE = 2200, 4800, 3200
#: Lines of code after which a blank one ends a passage; lines and characters that end it in any case.
SOFT_LINES, HARD_LINES, CODE_CHARS = 70, 130, 3500
#: Texts whose passages a task holds at once.
AT_ONCE = 256
#: White space that texts are stripped of.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_HEADING = r"^(#{1,3})\s+(.+)"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def packed(items: Column, size: Column | int, joint: int = 2) -> Column:
    """Where groups of neighbours of an array of texts begin (from 0): each takes texts up to ``size`` characters, ``joint`` between
    two; a longer text is a group of its own, as is one after an empty group.
    """
    state = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("room"), F.lit(0).alias("i"))

    def step(s: Column, text: Column) -> Column:
        grown = s["room"] + F.length(text) + joint
        fits = (F.size(s["begins"]) > 0) & (s["room"] > 0) & (grown <= size)
        begins = F.when(fits, s["begins"]).otherwise(F.array_append(s["begins"], s["i"]))
        return F.struct(begins.alias("begins"), F.when(fits, grown).otherwise(F.length(text)).alias("room"), (s["i"] + 1).alias("i"))

    return F.aggregate(items, state, step, lambda s: s["begins"])


def grouped(items: Column, begins: Column, joint: str) -> Column:
    """The texts of each group, joined."""
    ends = F.slice(F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(items))), 1, F.size(begins))  # none of none
    return F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.array_join(F.slice(items, x["a"] + 1, x["b"] - x["a"]), joint))


def _markdown(docs: DataFrame, id_col: str) -> DataFrame:
    """Sections under headings of three levels, long ones cut, short neighbours joined under the first one's breadcrumb."""
    rows = docs.select(id_col, F.coalesce("title", F.lit("")).alias("_title"), F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
    head = lambda line, i: F.struct(i.alias("at"), F.length(F.regexp_extract(line, _HEADING, 1)).alias("level"), stripped(F.regexp_extract(line, _HEADING, 2)).alias("name"))
    rows = rows.withColumn("_heads", F.filter(F.transform("_lines", head), lambda h: h["level"] > 0))
    none = F.lit(None).cast("string")
    path = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))

    def deeper(paths: Column, h: Column) -> Column:
        last = F.element_at(paths, -1)
        return F.array_append(paths, F.when(h["level"] == 1, path(h["name"], none, none)).when(h["level"] == 2, path(last["a"], h["name"], none)).otherwise(path(last["a"], last["b"], h["name"])))

    rows = rows.withColumn("_paths", F.aggregate("_heads", F.array(path(none, none, none)), deeper))
    begins = F.concat(F.array(F.lit(0)), F.transform("_heads", lambda h: h["at"]))
    ends = F.concat(F.transform("_heads", lambda h: h["at"]), F.array(F.size("_lines")))
    section = lambda x: F.struct(x["p"].alias("p"), stripped(F.array_join(F.slice("_lines", x["a"] + 1, x["b"] - x["a"]), "\n")).alias("text"))
    rows = rows.withColumn("_sections", F.filter(F.transform(F.arrays_zip(F.col("_paths").alias("p"), begins.alias("a"), ends.alias("b")), section), lambda s: s["text"] != ""))
    paragraphs = lambda s: F.when(F.length(s["text"]) <= WHOLE, F.array(s["text"])).otherwise(F.split(s["text"], r"\n{2,}"))
    rows = rows.withColumn("_sections", F.transform("_sections", lambda s: F.struct(s["p"].alias("p"), paragraphs(s).alias("paras"))))
    rows = rows.withColumn("_sections", F.transform("_sections", lambda s: F.struct(s["p"].alias("p"), s["paras"].alias("paras"), packed(s["paras"], PIECE).alias("begins"))))
    crumbs = lambda p: F.filter(F.array(p["a"], p["b"], p["c"]), lambda c: c.isNotNull() & (c != "") & (c != F.col("_title")))
    crumb = lambda s: F.array_join(F.concat(F.array(F.col("_title")), crumbs(s["p"])), " > ")
    more = lambda i: F.when(i > 0, F.concat(F.lit(" (cont. "), (i + 1).cast("string"), F.lit(")"))).otherwise("")
    cut = lambda s: F.transform(F.filter(grouped(s["paras"], s["begins"], "\n\n"), lambda t: stripped(t) != ""), lambda t, i: F.struct(F.concat(crumb(s), more(i)).alias("breadcrumb"), t.alias("text")))
    rows = rows.withColumn("_pieces", F.flatten(F.transform("_sections", cut)))
    rows = rows.withColumn("_texts", F.transform("_pieces", lambda p: p["text"])).withColumn("_begins", packed(F.col("_texts"), JOINED))
    names = F.transform("_begins", lambda i: F.get("_pieces", i)["breadcrumb"])
    return rows.select(id_col, F.arrays_zip(names.alias("breadcrumb"), grouped(F.col("_texts"), F.col("_begins"), "\n\n").alias("text")).alias("_passages"))


def _code(docs: DataFrame, id_col: str) -> DataFrame:
    """Runs of lines that end at a blank line after 70, or at 130 lines or 3,500 characters; blank runs are left out.

    Where runs end is told from the lengths of a text's lines in Python; a line is looked at by itself only where its run is long enough
    for a blank one to end it.
    """

    def ends(text: str) -> list[int]:
        lines, out, held, size = text.split("\n"), [], 0, 0
        for i, n in enumerate(map(len, lines), 1):
            held += 1
            size += n + 1
            if size >= CODE_CHARS or held >= HARD_LINES or (held >= SOFT_LINES and not lines[i - 1].strip(SPACE)):
                out.append(i)
                held = size = 0
        return out if out and out[-1] == len(lines) else [*out, len(lines)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                owner, ords, crumbs, texts = [], [], [], []
                for row, (title, raw) in enumerate(zip(part.column(1).to_pylist(), part.column(2), strict=True)):
                    text = (raw.as_py() or b"").decode(errors="surrogateescape")
                    lines, begin, ord_ = text.split("\n"), 0, 0
                    for end in ends(text):
                        if passage := "\n".join(lines[begin:end]).strip(SPACE):
                            owner.append(row)
                            ords.append(ord_)
                            crumbs.append(f"{title or ''}:{begin + 1}-{end}")
                            texts.append(passage.encode(errors="surrogateescape"))
                            ord_ += 1
                        begin = end
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(ords, pa.int32()), pa.array(crumbs, pa.string()), pa.array(texts, pa.binary())], names=names)

    rows = docs.select(id_col, "title", F.col("text").cast("binary"))
    names = [id_col, "ord", "breadcrumb", "text"]
    return rows.mapInArrow(cut, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ord int, breadcrumb string, text binary").withColumn("text", F.col("text").cast("string"))


def passages(docs: DataFrame, id_col: str = "doc_id", code: Column | None = None) -> DataFrame:
    """id, ord, breadcrumb, text, token_est of documents (id, title, text); ``code`` says which are cut as code.

    A text is folded line by line where it is read; lengths are added up and texts put together once, nothing is shuffled. Null
    and blank texts have no passages, a null title is empty.
    """
    rows = _markdown(docs if code is None else docs.where(~F.coalesce(code, F.lit(False))), id_col)
    rows = rows.select(id_col, F.posexplode("_passages").alias("ord", "p")).select(id_col, "ord", "p.breadcrumb", "p.text")
    rows = rows if code is None else rows.unionByName(_code(docs.where(code), id_col))
    return rows.withColumn("token_est", F.ceil(F.length("text") / 4))


def section(docs: DataFrame, heading: str, id_col: str = "doc_id", most: int = 60_000) -> DataFrame:
    """id and the section under the first heading that holds ``heading``, accents and case aside, to the next of its level or above.

    Each text is folded by itself where it is read: nothing is shuffled. Documents without such a heading, or without text, have no row.
    """
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)).alias("level"), line.alias("line")))
    rows = docs.select(id_col, lines.alias("_lines"), F.filter(marked, lambda m: m["level"] > 0).alias("_heads"))
    want = fold(F.lit(heading))
    rows = rows.withColumn("_start", F.get(F.filter("_heads", lambda m: F.contains(fold(m["line"]), want)), F.lit(0))).where("_start IS NOT NULL")
    after = F.filter("_heads", lambda m: (m["at"] > F.col("_start.at")) & (m["level"] <= F.col("_start.level")))
    rows = rows.withColumn("_end", F.coalesce(F.get(after, F.lit(0))["at"], F.size("_lines")))
    text = F.array_join(F.slice("_lines", F.col("_start.at") + 1, F.col("_end") - F.col("_start.at")), "\n")
    return rows.select(id_col, F.substring(text, 1, most).alias("section"))
