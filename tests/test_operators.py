"""Operators on small rows whose results are known."""

import datetime
import json
import math
import random
import re
import time
import tracemalloc
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import predicates
from corvane.functions import text as tx
from corvane.operators import containment, decisions, evaluation, graph, lexical, postings, ranking, reports, vector
from corvane.plans import queries
from corvane.sources import chunks, files, logs, manifest, segments, snapshots
from corvane.streaming import incremental, sync


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_query_tokens(spark):
    rows = spark.createDataFrame([("A Ação do móvel_x é b",), ("de do da",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.query_tokens(F.col("t"))).collect()] == [["acao", "movel_x"], ["de", "do", "da"], [], []]


def test_slug_headline_style(spark):
    text = "Primeira frase é longa! Segunda."
    row = spark.createDataFrame([(text, "word " * 40)], "a string, b string").select(
        tx.headline(F.col("a")), tx.slug(F.col("a")), tx.headline(F.col("b")), tx.style(F.lit("a b?")), tx.style(F.lit("a b c d e")), tx.last_two(F.lit("X\\Y/z.ts"))
    ).first()
    assert row[0] == "Primeira frase é longa!" and row[1] == "primeira-frase-e-longa-segunda" and row[2].endswith("word…") and len(row[2]) <= 111
    assert (row[3], row[4], row[5]) == ("natural", "keywords", "y/z.ts")


def test_candidates(spark):
    rows = spark.createDataFrame([("'a/b\\c.' rest",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.candidates(F.col("t"))).collect()] == [["a/b\\c", "c", "b", "a"], [], []]


def test_bm25_weighs_fields_and_keeps_statistics(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "x"), (2, "beta", "alpha"), (3, "gamma", "delta"), (4, "gamma gamma", "y")], "doc_id long, text string, title string")
    batch = lexical.queries_of(spark, {0: ["alpha"], 1: ["gamma", "none"]})
    got = {(r.query_id, r.id): r for r in lexical.bm25(docs, batch, {"text": 1.0, "title": 5.0}).collect()}
    assert got[0, 2].score > got[0, 1].score and set(got) == {(0, 1), (0, 2), (1, 3), (1, 4)}
    n, df, mean = 4, 2, (3 + 2 + 2 + 3) / 4
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    assert got[0, 1].score == pytest.approx(round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)), 6))


def test_two_pass_seam(spark):
    docs = spark.createDataFrame([(1, "a1 b1"), (2, "a1"), (3, "b1 c1"), (4, "zz"), (5, "c1")], "doc_id long, text string")
    run = lambda words, wide, pool: [(r.id, r["pass"]) for r in lexical.two_pass(docs, lexical.queries_of(spark, {0: words}), lexical.queries_of(spark, {0: wide}), {"text": 1.0}, pool=pool).orderBy("rank").collect()]
    assert run(["a1", "b1"], ["a1", "b1", "c1"], 1) == [(1, 0)]
    both = run(["a1", "b1"], ["a1", "b1", "c1"], 10)
    assert both[0] == (1, 0) and {i for i, p in both if p} == {2, 3, 5}
    assert {p for _, p in run(["a1"], ["a1", "c1"], 10)} == {0}


def test_snippet_marks_words(spark):
    text = " ".join(["x"] * 50 + ["Achado", "aqui"] + ["y"] * 50)
    out = spark.createDataFrame([(text,)], "t string").select(lexical.snippet(F.col("t"), ["achado"])).first()[0]
    assert out.startswith("… «Achado» aqui y") and out.endswith(" …")


def test_mention_terms():
    assert lexical.mention_terms("1072-nova_tela-de-xy") == ["1072", "nova", "tela"][1:] + ["1072"]


def test_authority_boundaries(spark):
    day = datetime.date(2024, 6, 30)
    rows = [(0, "spec", None, None), (1, "spec", None, day - datetime.timedelta(30)), (2, "spec", None, day - datetime.timedelta(31)), (3, "spec", None, day - datetime.timedelta(366)),
            (4, "odd", "arquivado", day + datetime.timedelta(9)), (5, "spec", None, day - datetime.timedelta(365))]
    df = spark.createDataFrame(rows, "i int, k string, s string, d date").withColumn("w", ranking.authority(F.col("k"), F.col("s"), F.col("d"), "2024-06-30"))
    got = {r.i: r.w for r in df.collect()}
    want = {0: 1.05, 1: 1.05 * 1.015, 2: 1.05, 3: 1.05 * 0.98, 4: 0.92 * 1.015, 5: 1.05}
    assert got == pytest.approx(want)


def test_greedy_collapse_leaves_keys_of_crowded_rows_free(spark):
    rows = [(0, 1, "d", "spec", "one", 1), (0, 2, "d", "spec", "two", 2), (0, 3, "d", "spec", "three", 3), (0, 4, "e", "card", "three", 4), (0, 5, "e", "nota", " ONE ", 5), (0, 6, "f", "nota", "six", 6)]
    out = ranking.greedy_collapse(spark.createDataFrame(rows, "query_id int, id long, doc string, label string, text string, position int"), 5)
    assert [(r.place, r.id, r.also_in, r.collapsed) for r in out.orderBy("place").collect()] == [(1, 1, ["nota"], 1), (2, 4, [], 0), (3, 6, [], 0), (4, 2, [], 0)]


def test_greedy_collapse_query_is_over_whole_tables(spark):
    """Each query of the benchmark has a group of its own, and late conversations are found."""
    sf = "/root/testdata/sf0.001"
    pool = queries.pools(spark, sf).cache()
    rows = pool.groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/benchmark.parquet").count() and all(r.n <= 3 * lexical.POOL for r in rows)
    last = spark.read.parquet(f"{sf}/conversations.parquet").agg(F.max("conv_id")).first()[0]
    found = {int(r[0].split(":")[1]) for r in pool.where("doc LIKE 'conversation:%'").select("doc").distinct().collect()}
    assert found and max(found) <= last and (last < 40 or max(found) >= 40)
    assert queries.q22_greedy_collapse(spark, sf).select("query_id").distinct().count() == len(rows)


def test_collapse_keeps_every_label(spark):
    """Late labels, a first hit without one, labels of the first hit that others share, and keys of null."""
    rows = [(0, i, "a", "copy") for i in range(1500)] + [(0, 1500, "late", "copy"), (0, 2000, None, "two"), (0, 2001, "b", " TWO"), (0, 3000, "c", "one"), (1, 4000, "d", None), (1, 4001, "e", None)]
    out = ranking.collapsed(spark.createDataFrame(rows, "query_id int, id int, label string, text string"), ["query_id"], [F.col("id")], "label")
    assert values(out, "id", "also_in", "collapsed") == [(0, ["a", "late"], 1500), (2000, ["b"], 1), (3000, [], 0), (4000, ["e"], 1)]


def test_relevance_floor(spark):
    rows = spark.createDataFrame([([], "a"), (["aa"], "xaax"), (["aa", "bb", "cc"], "aa"), (["aa", "bb", "cc", "dd"], "aa bb"), (["aa", "bb", "cc", "dd", "ee"], "aa bb")], "t array<string>, x string")
    assert [r[0] for r in rows.select(predicates.relevant(F.col("t"), F.col("x"))).collect()] == [False, True, False, True, False]


def test_archived_filter(spark):
    rows = spark.createDataFrame([("s", "r", "f", "d", None), ("s", "r", "f", "d", "arquivado"), ("s", "q", "g", "d", "open")], "source string, repo string, feature string, doc_type string, status string")
    count = lambda f, **k: rows.where(predicates.matches(f, **k)).count()
    assert (count({}), count({"feature": "f"}), count({}, with_archived=True), count({"repo": "q"})) == (2, 2, 3, 1)


def test_usage_report(spark):
    odd = list(zip([900, 40, 10, 70, 30, 80, 20, 60, 50], [None, False, True, True, False, True, None, True, False], strict=True))
    even = list(zip([30, 10, 40, 20], [False, True, True, True], strict=True))
    rows = [("impar", m, s) for m, s in odd] + [("par", m, s) for m, s in even] + [("nulo", m, None) for m in (25, 5, 15)]
    df = spark.createDataFrame(rows, "tool string, ms long, semantic boolean").withColumns({"empty": F.lit(False), "size": F.lit(1)})
    got = {r.tool: (r.calls, r.p50, r.p90, r.words_only) for r in reports.usage(df).collect()}
    assert got == {"impar": (9, 50, 80, round(3 / 7, 6)), "par": (4, 20, 30, 0.25), "nulo": (3, 15, 15, None)}


def test_harvest_fates(spark):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    calls = []
    for i, gap in enumerate((89, 90, 91)):
        calls += [(1, t(i * 1000), 10 * i, "search"), (1, t(i * 1000 + gap), 10 * i + 1, "read")]
    events = spark.createDataFrame(calls, "session int, ts timestamp, id long, tool string")
    found = evaluation.following(events, "session", "ts", "id", F.col("tool") == "search", F.col("tool") == "read", F.expr("INTERVAL 90 SECONDS"))
    assert [(r.id, r.read and r.read.id) for r in found.orderBy("id").collect()] == [(0, 1), (10, 11), (20, None)]
    none = (None, None, None, None)
    pairs = [(1, t(0), "Como x?", "a/b.md", none), (2, t(1), " como X? ", "a/b.md", none), (3, t(2), "gone", "zz", none), (4, t(3), "wrong", "a/b.md", ("docs", "r2", None, None)), (5, t(4), "fits", "a/b.md", ("docs", "", None, None))]
    schema = "id long, ts timestamp, query string, path string, filters struct<source:string,repo:string,feature:string,doc_type:string>"
    docs = spark.createDataFrame([("a/b.md", ("docs", "r1", None, "doc"))], "path string, doc struct<source:string,repo:string,feature:string,doc_type:string>")
    got = evaluation.harvest(spark.createDataFrame(pairs, schema), docs)
    assert values(got, "id", "fate") == [(1, "kept"), (2, "repeated"), (3, "missing"), (4, "incoherent"), (5, "kept")]


def test_measures(spark):
    gains = spark.createDataFrame([(r,) for r in (0, 1, 2, 3, 4, 5, 6, None)], "r int").select(F.round(evaluation.ndcg5(F.col("r")), 2))
    assert [r[0] for r in gains.collect()] == [0, 1, 0.63, 0.5, 0.43, 0.39, 0, 0]
    cases = [("positivo", 1, 1, None), ("positivo", 3, 1, None), ("positivo", None, 0, None), ("negativo", None, 0, None), ("negativo", None, 2, None)]
    schema = "kind string, rank int, found int, invalid string"
    row = evaluation.verdict(spark.createDataFrame(cases, schema)).first()
    assert (row.cases, row.positives, row.ndcg5, row.hit1, row.hit5, row.void) == (5, 3, 0.5, 1, 2, False) and row.mrr == round((1 + 1 / 3) / 3, 6)
    assert evaluation.verdict(spark.createDataFrame([*cases, ("positivo", 1, 1, "so-lexico")], schema)).first().void


def test_resolution_needs_one_answer(spark):
    refs = spark.createDataFrame([("a", 7, "card:a#7"), ("b", 7, "card:b#7"), ("a", 8, "card:a#8")], "repo string, number int, key string")
    asked = spark.createDataFrame([("x", "a", 7), ("y", "c", 7), ("z", "c", 8)], "doc string, repo string, number int")
    assert values(graph.resolve_numbers(asked, refs), "doc", "target") == [("x", "card:a#7"), ("z", "card:a#8")]


def test_edges_and_decisions(spark):
    edges = spark.createDataFrame([(2, "a", "b", "r", "late"), (1, "a", "b", "r", "early"), (1, "a", "a", "r", "loop")], "seq int, src string, dst string, rel string, origin string")
    assert values(graph.distinct_edges(edges), "src", "dst", "origin") == [("a", "b", "early")]
    refs = spark.createDataFrame([("r", 101, "card:r#101")], "repo string, number int, key string")
    code = spark.createDataFrame([("p/lib/x.ts",)], "path string")
    decisions = spark.createDataFrame([(1, "r", "#101", None), (2, "r", "feat", None), (3, "r", "lib/x.ts", None), (4, "r", "#101", 1)], "id int, repo string, scope string, superseded int")
    got = graph.decision_edges(decisions, refs, spark.createDataFrame([("feat",)], "feature string"), code)
    assert values(got, "src", "dst") == [("decisao:1", "card:r#101"), ("decisao:2", "feature:feat"), ("decisao:3", "arquivo:p/lib/x.ts")]
    commits = spark.createDataFrame([("commit:r@1", "r", [101], ["lib/x.ts"]), ("commit:r@2", "r", [999], ["lib/x.ts"])], "key string, repo string, cards array<int>, files array<string>")
    assert values(graph.commit_edges(commits, refs, code), "src", "dst", "rel") == [("commit:r@1", "arquivo:p/lib/x.ts", "toca"), ("commit:r@1", "card:r#101", "implementa")]


def test_first_match_stops_at_ambiguity(spark):
    steps = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d"), (2, 5, "e")], "request int, step int, key string")
    assert values(graph.first_match(steps), "request", "key") == [(2, "d")]


def cut(spark, texts, title="T", code=False):
    rows = spark.createDataFrame([(i, title, t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    out = {i: [] for i in range(len(texts))}
    for r in chunks.passages(rows, code=F.lit(True) if code else None).orderBy("doc_id", "ord").collect():
        out[r.doc_id].append((r.breadcrumb, r.text))
    return [out[i] for i in range(len(texts))]


def brute_pieces(text, size):
    out, room = [], 0
    for paragraph in re.split(r"\n{2,}", text):
        if out and "".join(out[-1]) and room + len(paragraph) + 2 <= size:
            out[-1].append(paragraph)
            room += len(paragraph) + 2
        else:
            out.append([paragraph])
            room = len(paragraph)
    return [x for x in map("\n\n".join, out) if x.strip()]


def brute_markdown(text, title):
    """Line by line and piece by piece, as a reader would."""
    sections, path = [([], [])], {}
    for line in text.split("\n"):
        if m := re.match(r"(#{1,3})\s+(.+)", line):
            path = {k: v for k, v in path.items() if k < len(m[1])} | {len(m[1]): m[2].strip()}
            sections.append(([path[k] for k in sorted(path)], [line]))
        else:
            sections[-1][1].append(line)
    out = []
    for crumbs, lines in sections:
        whole = "\n".join(lines).strip()
        crumb = " > ".join([title, *(c for c in crumbs if c and c != title)])
        for i, part in enumerate(([whole] if len(whole) <= 4800 else brute_pieces(whole, 3200)) if whole else []):
            if out and len(out[-1][1]) + len(part) + 2 <= 2200:
                out[-1] = (out[-1][0], out[-1][1] + "\n\n" + part)
            else:
                out.append((crumb if i == 0 else f"{crumb} (cont. {i + 1})", part))
    return out


def brute_code(text, path):
    out, start, held, size = [], 0, [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        held.append(line)
        size += len(line) + 1
        if (len(held) >= 70 and not line.strip()) or size >= 3500 or len(held) >= 130 or i == len(lines):
            if block := "\n".join(held).strip():
                out.append((f"{path}:{start + 1}-{i}", block))
            start, held, size = i, [], 0
    return out


def test_markdown_passages(spark):
    long = "\n\n".join(["p" * 1500] * 4)
    text = f"intro\n# One\nbody\n### Deep\n{long}\n## Two\n```\n# in code\n```"
    out = cut(spark, [text, "\n\n", "a" * 5000, None])
    assert out[0][0][0] == "T" and out[0][1][0].startswith("T > One > Deep") and "(cont. 2)" in out[0][2][0]
    assert all(len(t) <= 4800 for _, t in out[0]) and out[1] == out[3] == [] and out[2] == [("T", "a" * 5000)]
    r = random.Random(11)
    line = lambda: r.choice(["", "", "# H", "## Two words ", "### T", "#### no", "#no", "#  T", "x" * r.choice((10, 400, 1200, 2500)), "é " * 300, "  \t", "\x0b", "##\tTab"])
    texts = ["\n".join(line() for _ in range(r.randint(0, 40))) for _ in range(150)]
    assert cut(spark, texts) == [brute_markdown(t, "T") for t in texts]


def test_code_passages(spark):
    body = "\n".join(["x"] * 69 + [""] + ["y"] * 130 + ["z"])
    out = cut(spark, [body, "\n\n", "x" * 3500 + "\ny", None], "f", code=True)
    assert [[b for b, _ in x] for x in out] == [["f:1-70", "f:71-200", "f:201-201"], [], ["f:1-1", "f:2-2"], []]
    r = random.Random(12)
    texts = ["\n".join(r.choice(["", " ", "x", "y" * 60, "z" * 3000]) if r.random() < 0.1 else "a = 1" for _ in range(r.randint(0, 500))) for _ in range(60)]
    assert cut(spark, texts, "f", code=True) == [brute_code(t, "f") for t in texts]


def test_config_variables():
    assert files.expand("${A}/x", {"A": "${B}", "B": "b"}) == "b/x"
    for bad in ("${C}", "${A"):
        with pytest.raises(ValueError):
            files.expand(bad, {"A": "a"})


def test_commit_log(spark, tmp_path):
    record = "\x1f".join(["s1", "2024-01-01", "me", "fix #123", "body #4567 #12", "a.py\nb.py"])
    (tmp_path / "log.txt").write_text(record + "\x1e" + record.replace("s1", "s2"))
    rows = files.commits(spark, str(tmp_path / "log.txt")).orderBy("sha").collect()
    assert [(r.sha, r.cards, r.files) for r in rows] == [("s1", [123, 4567], ["a.py", "b.py"]), ("s2", [123, 4567], ["a.py", "b.py"])]


def test_snapshots(spark, tmp_path):
    one, root = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), str(tmp_path)
    snapshots.save(one, root, "docs", 1)
    changed = snapshots.replaced(snapshots.load(spark, root, "docs"), spark.createDataFrame([(2, "B"), (4, "d")], "k int, v string"), "k", one.where("k = 3"))
    snapshots.save(changed, root, "docs", 2)
    assert values(snapshots.load(spark, root, "docs"), "k", "v") == [(1, "a"), (2, "B"), (4, "d")] and snapshots.load(spark, root, "docs", 1).count() == 3


def test_newest_and_bursts(spark, tmp_path):
    old = spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 9, "late"), (2, 10, "B"), (3, 1, "c")], "id int, at int, v string")
    assert values(incremental.newest(old, new, "id", "at"), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]
    t = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    rows = spark.createDataFrame([(t(0),), (t(1000),), (t(5000),)], "ts timestamp")
    assert values(incremental.bursts(rows, "ts", "1500 milliseconds", "1 minute"), "changes") == [(1,), (2,)]


def test_encoder_is_unit_and_shares_words(spark):
    rows = spark.createDataFrame([("alpha beta",), ("alpha gamma",), ("",), (None,)], "t string").select(vector.hashing_encoder(F.col("t")).alias("v")).collect()
    v = [r.v for r in rows]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and sum(a * b for a, b in zip(v[0], v[1], strict=True)) > 0.4 and not any(v[2]) and not any(v[3])
    assert vector.fnv1a("a") == (0x811C9DC5 ^ 97) * 0x01000193 & 0xFFFFFFFF


def test_filters_reach_the_scan(spark):
    """The plan reads only the columns that a query needs and hands its filter to the scan."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.where("source = 'src1'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "text" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("held", [vector.HELD, 2])
def test_nearest_vectors_against_brute_force(spark, monkeypatch, held):
    """Ties, repeated rows, nulls, other lengths and odd components; queries at once, and in blocks."""
    monkeypatch.setattr(vector, "HELD", held)
    monkeypatch.setattr(vector, "MET", 70)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(300)]
    rows += [rows[7], (900, None), (901, []), (902, [1.0]), (903, [float("nan"), 1.0, 1.0, 1.0]), (904, [None, 1.0, 1.0, 1.0])]
    asked = [(0, [1.0, 0.5, 0.0, -1.0]), (1, [0.0] * 4), (2, [3.0]), (3, None)]
    schema = "vec_id long, embedding array<float>"
    got = vector.top_k(spark.createDataFrame(rows, schema).repartition(5), spark.createDataFrame(asked, "query_id int, query array<float>"), 6)
    want = []
    for q, v in asked:
        near = sorted((-round(sum(a * b for a, b in zip(x, v, strict=True)), 6), i) for i, x in rows if v is not None and x is not None and len(x) == len(v) and None not in x and not any(map(math.isnan, x)))
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(near[:6])]
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == sorted(want)
    assert vector.top_k(spark.createDataFrame([], schema), spark.createDataFrame(asked, "query_id int, query array<float>"), 6).count() == 0


def test_marks_move_only_past_success(spark):
    items = spark.createDataFrame([("a", 5, False), ("a", 9, False), ("b", 7, True), ("b", 8, False), ("c", 1, True)], "repo string, ts int, failed boolean")
    before = spark.createDataFrame([("a", 6), ("b", 2), ("d", 4)], "repo string, mark int")
    got = {tuple(r) for r in incremental.marks(items, before, "repo", "ts", "failed").collect()}
    assert got == {("a", 9, 0), ("b", 2, 1), ("c", None, 1), ("d", 4, 0)}


def test_case_sets_that_lack_something_are_not_written(spark, tmp_path):
    cases = spark.createDataFrame([(i, "code", "negativo" if i < 2 else "positivo", "keywords" if i % 2 else "natural") for i in range(8)], "id long, source string, kind string, style string")
    with pytest.raises(ValueError, match="fewer than 60"):
        evaluation.write_cases(cases, f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    evaluation.write_cases(cases, f"{tmp_path}/some", 5)
    assert evaluation.read_cases(spark, f"{tmp_path}/some", "id long, kind string, source string, style string", "keywords").count() == 4


def test_cleared_tables_keep_their_schema(spark, tmp_path):
    for name in ("one", "other"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    snapshots.clear(spark, [f"{tmp_path}/one"])
    assert spark.read.parquet(f"{tmp_path}/one").count() == 0 and spark.read.parquet(f"{tmp_path}/one").columns == ["id"]
    assert spark.read.parquet(f"{tmp_path}/other").count() == 3


def test_one_index_serves_several_searches(spark):
    docs = spark.createDataFrame([(1, "red fish", "a"), (2, "blue fish fish", "red"), (3, None, "b")], "doc_id long, text string, title string")
    fields = {"text": 1.0, "title": 5.0}
    built = lexical.index(docs, fields)
    for words in (["red"], ["fish", "blue"]):
        batch = lexical.queries_of(spark, {0: words})
        assert sorted(lexical.bm25(docs, batch, fields).collect()) == sorted(lexical.bm25(docs, batch, fields, indexed=built).collect())


def test_phrases_of_tokens_with_underscores(spark):
    docs = spark.createDataFrame(
        [(1, "Use snake_case, not snake-case twice", "x"), (2, "a snake in a case", "snake case"), (3, "case snake", None), (4, "Ação_Única ação ÚNICA", ""), (5, None, "a a a"), (6, "", None)],
        "doc_id long, text string, title string",
    )
    asked = lexical.queries_of(spark, {0: ["snake_case"], 1: ["acao_unica", "nowhere_else"], 2: ["a_a"], 3: ["__"], 4: ["snake_case", "twice"], 5: ["snake", "__"]})
    got = {(r.query_id, r.id): r.matched for r in lexical.bm25(docs, asked, {"text": 1.0, "title": 5.0}).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (1, 4): 1, (2, 5): 1, (4, 1): 2, (4, 2): 1, (5, 1): 1, (5, 2): 1, (5, 3): 1}
    rows = postings.postings(docs, ["text", "title"])
    counts = {(r.token, r.id, r.field): (r.tf, r.length) for r in postings.occurrences(rows.where("term IS NOT NULL"), asked).collect()}
    assert counts["snake_case", 1, "text"] == (2.0, 8) and counts["snake_case", 2, "title"] == (1.0, 7) and counts["a_a", 5, "title"] == (2.0, 3) and counts["acao_unica", 4, "text"] == (2.0, 4)
    assert ("snake_case", 2, "text") not in counts and ("snake_case", 3, "text") not in counts
    assert rows.where("term IS NULL").count() == 6
    assert lexical.bm25(docs.limit(0), asked, {"text": 1.0, "title": 5.0}).count() == 0


def test_many_tokens_meet_the_whole_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} and w{i % 3}_x w{i}") for i in range(60)], "doc_id long, text string")
    asked = lexical.queries_of(spark, {i: [f"w{i}", f"w{i % 3}_x", "and"] for i in range(10)})
    want = sorted(map(tuple, lexical.bm25(docs, asked, {"text": 1.0}).collect()))
    monkeypatch.setattr(lexical, "ASKED", 3)
    assert lexical.asked_tokens(asked) is None and lexical.index(docs, {"text": 1.0}, queries=asked).whole
    assert sorted(map(tuple, lexical.bm25(docs, asked, {"text": 1.0}).collect())) == want and len(want) == 600


def test_letters_lose_their_marks(spark):
    texts = ["Ἀθῆναι Ελλάδα ΐ ΰ", "Việt Nam ệ ữ Ấ", "Йод ёлка Ѓ ў", "Ångström Å naïve é ǘ", "한국어 ツバメ が", "ﬁ ½ ß İ ı"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    folded = [r[0] for r in rows.select(tx.fold(F.col("t"))).collect()]
    duck = duckdb.connect()
    for text, mine in zip(texts, folded, strict=True):
        assert mine == unicodedata.normalize("NFC", duck.execute("SELECT strip_accents(lower(?))", [text]).fetchone()[0])
    terms = [r[0] for r in rows.select(tx.terms(F.col("t"))).collect()]
    assert terms == [[t.decode() for t in postings.split(text.encode())] for text in texts]
    assert folded[0] == "αθηναι ελλαδα ι υ" and folded[1] == "viet nam e u a" and folded[2] == "иод елка г у"


def hits(df):
    return sorted(map(tuple, df.collect()))


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    say = lambda: " ".join(r.choices(["red", "blue", "snake_case", "ação", "x9", "rare"], k=r.randint(0, 12)))
    asked = lexical.queries_of(spark, {0: ["red", "snake_case"], 1: ["acao"], 2: ["blue_red", "none"], 3: ["rare"]})
    now = {i: (say(), say()) for i in range(40)}
    frame = lambda rows: spark.createDataFrame([(i, *t) for i, t in rows.items()], "doc_id long, text string, title string").repartition(3)
    root, weights = str(tmp_path / "index"), {"text": 1.0, "title": 5.0}
    whole = lambda: hits(lexical.bm25(frame(now), asked, weights))
    state = segments.create(frame(now), root, ["text", "title"], buckets=8)
    assert hits(segments.search(spark, root, asked, weights)) == whole()
    old = whole()
    for step in range(3):
        changed = {i: (say(), say()) for i in r.sample(range(60), 9)}
        gone = set(r.sample(range(70), 6))
        now = {i: t for i, t in (now | changed).items() if i not in gone}
        state = segments.update(spark, root, frame(changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        assert state["facts"]["documents"] == len(now) and state["facts"]["segments"] == step + 2
        assert state["facts"]["length"] == lexical.index(frame(now), weights).rows.where("term IS NULL").agg({"length": "sum"}).first()[0]
        assert hits(segments.search(spark, root, asked, weights)) == whole()
    assert hits(segments.search(spark, root, asked, weights, version=0)) == old
    with monkeypatch.context() as m:
        m.setattr(lexical, "ASKED", 2)
        assert hits(segments.search(spark, root, asked, weights)) == whole()
    segments.compact(spark, root)
    assert hits(segments.search(spark, root, asked, weights)) == whole()
    assert segments.lengths(spark, root, manifest.read(spark, root)).count() == len(now)
    with pytest.raises(manifest.Stale):
        manifest.commit(spark, root, state, {})
    rows = segments.asked_blocks(spark, root, manifest.read(spark, root), spark.createDataFrame([("red",)], "term string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_postings_move_packed(spark, tmp_path):
    root, schema = str(tmp_path / "index"), "doc_id string, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first = [(f"d{i}", f"straße w{i} red red") for i in range(60)]
    packed = postings.blocks(frame(first).coalesce(1), ["text"], 8)
    # a row for each bucket and one for the lengths, however many terms there are
    assert packed.columns == ["bucket", "packed"] and packed.count() <= 9
    segments.create(frame(first), root, ["text"], buckets=8)
    for step in range(3):
        segments.update(spark, root, frame([(f"d{step}", "red blue"), (f"e{step}", "straße")]), frame([(f"d{10 + step}", "")]))
    segments.compact(spark, root)
    state = manifest.read(spark, root)
    rows = segments._blocks(spark, root, state).where("term IN ('red', 'straße')").select("term", F.size("ids").alias("n")).collect()
    # blocks of small segments are one, without what has gone
    assert sorted((r.term, r.n) for r in rows) == [("red", 57), ("straße", 57)]
    lexical.queries_of(spark, {0: ["straße"], 1: ["blue_red", "red_blue"]}).write.parquet(str(tmp_path / "asked"))
    scored = segments.search(spark, root, spark.read.parquet(str(tmp_path / "asked")), {"text": 1.0})
    # hits are dealt by document, not each query's sums
    dealt = re.findall(r"hashpartitioning\(([^)]*)", scored._jdf.queryExecution().executedPlan().toString())
    assert any(d.startswith("id#") for d in dealt) and not any(d.startswith("query_id#") for d in dealt)
    found = scored.collect()
    assert len([r for r in found if r.query_id == 0]) == 57 and {r.id for r in found if r.query_id == 1} == {"d0", "d1", "d2"}


def test_refresh_follows_crawls(spark, tmp_path):
    schema, root = "path string, modified long, size long, text string", str(tmp_path / "index")
    asked = lexical.queries_of(spark, {0: ["one"]})
    first = [("a", 1, 3, "one two"), ("b", 1, 3, "one"), ("c", 1, 3, "three")]
    segments.refresh(spark.createDataFrame(first, schema), root, ["text"])
    same = segments.refresh(spark.createDataFrame(first, schema), root, ["text"])
    assert same["version"] == 0
    second = [("a", 1, 3, "not looked at"), ("c", 2, 3, "one three"), ("d", 1, 1, "one")]
    state = segments.refresh(spark.createDataFrame(second, schema), root, ["text"])
    assert state["version"] == 1 and state["facts"]["documents"] == 3 and state["facts"]["length"] == 5
    assert {x.id for x in segments.search(spark, root, asked, {"text": 1.0}).collect()} == {"a", "c", "d"}
    assert segments.refresh(spark.createDataFrame([], schema), root, ["text"])["facts"]["documents"] == 0
    assert segments.search(spark, root, asked, {"text": 1.0}).count() == 0


def test_a_version_is_seen_whole_or_not(spark, tmp_path):
    root = str(tmp_path / "tables")
    assert manifest.read(spark, root) == {"version": -1, "tables": {}, "facts": {}}
    put = lambda n, name: manifest.write(spark.range(n), root, name)
    a = manifest.commit(spark, root, manifest.read(spark, root), {"one": [put(1, "one")], "two": [put(2, "two")]}, {"n": 3})
    half = put(5, "one")  # written, but not committed
    assert manifest.table(spark, manifest.read(spark, root), "one", "id long").count() == 1
    b = manifest.commit(spark, root, a, {"one": [*a["tables"]["one"], half]})
    for late in (a, {"version": -1, "tables": {}, "facts": {}}):
        with pytest.raises(manifest.Stale):
            manifest.commit(spark, root, late, {"two": []})
    assert manifest.read(spark, root) == b and manifest.versions(spark, root) == [0, 1] and b["facts"] == {"n": 3}
    assert manifest.table(spark, b, "one", "id long").count() == 6 and manifest.table(spark, b, "two", "id long").count() == 2
    assert manifest.table(spark, manifest.read(spark, root, 0), "one", "id long").count() == 1 and manifest.table(spark, b, "none", "id long").count() == 0


def brute_following(rows, within):
    out = {}
    for s, t, i, kind in rows:
        if kind == "s":
            later = [(u, j) for v, u, j, k in rows if v == s and k == "r" and (u, j) > (t, i)]
            best = min(later, default=None)
            out[i] = best[1] if best and best[0] <= t + within else None
    return out


@pytest.mark.parametrize("kind", ["long", "timestamp", "timestamp_ntz"])
def test_following_reads(spark, kind):
    r = random.Random(7)
    rows = [(r.choice((1, 2, None)), r.randint(-50, 300), i, r.choice("srx")) for i in range(300)]
    events = spark.createDataFrame(rows, "s int, t long, i long, kind string")
    within = F.lit(7).cast("long")
    if kind != "long":
        events = events.withColumn("t", F.timestamp_seconds("t").cast(kind))
        within = F.expr("INTERVAL 7 SECONDS")
    got = evaluation.following(events.repartition(4), "s", "t", "i", F.col("kind") == "s", F.col("kind") == "r", within)
    assert got.columns == ["s", "t", "i", "kind", "read"]
    assert {x.i: x.read.id if x.read else None for x in got.collect()} == brute_following(rows, 7)


def test_a_session_of_a_million_events(spark):
    events = spark.range(1_000_000).select(F.lit(1).alias("s"), F.shiftright("id", 1).alias("t"), F.col("id").alias("i"), (F.col("id") % 10 == 0).alias("search"), (F.col("id") % 1000 == 999).alias("read_"))
    began = time.time()
    got = evaluation.following(events, "s", "t", "i", F.col("search"), F.col("read_"), F.lit(100).cast("long")).agg(F.count("*"), F.count("read"), F.sum("read.id")).first()
    searches = range(0, 1_000_000, 10)
    found = [n for n in ((i // 1000) * 1000 + 999 for i in searches)]
    near = [n for i, n in zip(searches, found, strict=True) if n // 2 <= i // 2 + 100]
    assert tuple(got) == (100_000, len(near), sum(near)) and time.time() - began < 20


def test_fragments_in_texts(spark, monkeypatch):
    r = random.Random(6)
    say = lambda n: "".join(r.choices("abcé😀 %_\\", k=n))
    texts = [(i, say(r.randint(0, 60))) for i in range(80)] + [(100, None), (101, ""), (102, "abc" * 5000)]
    fragments = [(i, say(r.choice((1, 2, 3, 4, 6)))) for i in range(120)] + [(500, ""), (501, None), (502, "abcabcabcabc"), (3, "ab"), (503, "zzz never")]
    a = spark.createDataFrame(fragments, "fragment_id long, fragment string").repartition(3)
    b = spark.createDataFrame(texts, "id long, text string").repartition(3)
    want = {(f, t) for f, x in fragments if x for t, y in texts if y is not None and x in y}
    for most in (containment.ASKED, 2):
        monkeypatch.setattr(containment, "ASKED", most)
        got = [tuple(x) for x in containment.contained(a, b).collect()]
        assert len(got) == len(want) and set(got) == want
    assert containment.contained(a.limit(0), b).count() == 0 and containment.contained(a, b.limit(0)).count() == 0


def pulled(r, n):
    """A pull of random items and comments; times decide the order within it."""
    out = []
    for i in range(n):
        kind = r.choice(["card", "pr", "comment", "comment", "comment", "review"])
        said = kind in ("comment", "review")
        out.append((r.choice(["a", "b"]), r.randint(1, 4), kind, (r.choice([None, *range(12)]) if said else None), f"t{r.randint(0, 3)}{i:03d}" if said else f"t{i % 3}", "x", None if said else f"title {i}", f"body {i}", None if said else "OPEN", "f.py" if said else None))
    return out


def kept_items(items, pulls):
    """``items`` by (repo, kind, number) after a pull, row by row, and which of them changed."""
    changed = set()
    for x in sorted((p for p in pulls if p[2] in ("card", "pr")), key=lambda p: p[4]):
        key = (x[0], x[2], x[1])
        had = items.get(key)
        if had is None or had["fields"][0] != x[4]:
            changed.add(key)
        items[key] = {"fields": (x[4], *x[5:9]), "comments": had["comments"] if had else {}}
    for x in sorted((p for p in pulls if p[2] in ("comment", "review") and p[3] is not None), key=lambda p: (p[4], p[7])):
        kind = "pr" if x[2] == "review" or (x[0], "card", x[1]) not in items else "card"
        item = items.get((x[0], kind, x[1]))
        if item and x[3] not in item["comments"]:
            item["comments"][x[3]] = (x[3], x[4], x[5], x[7], x[9] if x[2] == "review" else None)
            changed.add((x[0], kind, x[1]))
    return changed


def shown(x):
    return (x["repo"], x["kind"], x["number"]), ((x["updated"], x["author"], x["title"], x["body"], x["state"]), [tuple(c) for c in x["comments"]])


def test_items_keep_their_comments(spark, tmp_path):
    r, items, state = random.Random(9), {}, spark.createDataFrame([], sync.ITEM)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sync.ROCKS)
    stands = {}
    for n in range(3):
        # one row an item and pull, so that both forms see the same last one
        pull = list({(x[0], x[2], x[1], x[3], x[4] if x[3] is not None else None): x for x in pulled(r, 40)}.values())
        rows = spark.createDataFrame(pull, sync.RECORD)
        changed = kept_items(items, pull)
        want = {k: (v["fields"], sorted(v["comments"].values(), key=lambda c: (c[1], c[0]))) for k, v in items.items()}
        sync.synced(state, rows).write.parquet(str(tmp_path / f"batch{n}"))
        state = spark.read.parquet(str(tmp_path / f"batch{n}"))
        found = state.collect()
        assert dict(map(shown, found)) == want and len(found) == len(want)
        assert {(x.repo, x.kind, x.number) for x in found if x.changed} == changed
        state = state.drop("changed")
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = sync.synced_stream(spark.readStream.schema(sync.RECORD).parquet(str(tmp_path / "in")))
        incremental.run_available(stream, lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}")), str(tmp_path / "state"))
        sent = [shown(x) for x in spark.read.parquet(str(tmp_path / f"out/batch={n}")).collect()]
        assert {k for k, _ in sent} == changed
        stands |= dict(sent)
        assert {k: v[1] for k, v in stands.items()} == {k: v[1] for k, v in want.items()}
    assert sync.synced(state, spark.createDataFrame([], sync.RECORD)).where("changed").count() == 0


def log_record(i, parents="p", date=None, body="said #123\nand #7", files="a.py\nb.py\n"):
    return f"\x1e{i:040d}\x1f{i:07d}\x1f{date or f'2024-01-{i % 28 + 1:02d}'}\x1fme\x1f{parents}\x1ftitle {i} é #4567\x1f{body}\x1f{files}"


def test_exported_logs(spark, tmp_path):
    logs.register(spark)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "one.log").write_text("junk before" + "".join(log_record(i, "p q" if i % 10 == 0 else "p") for i in range(100)) + "\x1ebroken\x1frecord")
    (tmp_path / "logs" / "two.log").write_text("".join(log_record(i, body="x" * 5000) for i in range(9)))
    (tmp_path / "logs" / "empty.log").write_text("")
    read = lambda **o: spark.read.format("commitlog").options(**o).load(str(tmp_path / "logs"))
    whole = sorted(map(tuple, read().select("repo", "sha", "data", "subject", "body", "files", "cards").collect()))
    assert len(whole) == 90 + 9
    assert whole[0] == ("one", f"{1:040d}", "2024-01-02", "title 1 é #4567", "said #123\nand #7", ["a.py", "b.py"], [4567, 123])
    for split in (997, 2999, 10**6):  # records are cut anywhere
        rows = read(split=str(split))
        assert sorted(map(tuple, rows.select("repo", "sha", "data", "subject", "body", "files", "cards").collect())) == whole
    assert read(merges="true").count() == 109
    assert read(since="2024-01-20").count() == sum(x[2] >= "2024-01-20" for x in whole)
    assert {x.repo: x.n for x in read(maxcount="7").groupBy("repo").agg(F.count("*").alias("n")).collect()} == {"one": 7, "two": 7}
    assert read(maxcount="30", since="2024-01-20").where("data >= '2024-01-25'").count() == sum(x.data >= "2024-01-25" for x in read(maxcount="30", since="2024-01-20").collect())
    late = read().where("data >= '2024-01-20' AND repo = 'two' AND size(cards) > 0")
    ranges = [x for at in range(0, 300, 11) for x in logs.records(str(tmp_path), logs.Range(str(tmp_path / "logs" / "one.log"), at, at + 11))]
    assert len(ranges) == len({*ranges}) == (tmp_path / "logs" / "one.log").read_bytes()[:308].count(b"\x1e") and all(logs.parsed("one", x) for x in ranges)
    assert late.count() == sum(x[2] >= "2024-01-20" and x[0] == "two" for x in whole)
    plan = late._jdf.queryExecution().executedPlan().toString()
    left = re.search(r"Filter \((.*)\)", plan)[1]
    assert "size(cards" in left and "data" not in left and "repo" not in left


def test_a_large_log_has_a_bounded_number_of_tasks(spark, tmp_path):
    logs.register(spark)
    (tmp_path / "one.log").write_text("".join(log_record(i) for i in range(2000)))
    rows = spark.read.format("commitlog").option("split", 100).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() <= logs.TASKS
    assert sorted(int(r.sha) for r in rows.collect()) == list(range(2000))
    # ranges of whole splits, no larger than a task reads by itself
    parts = logs.ranges({"a": 10**12, "b": 5}, 1 << 16, {"a": 7})
    assert parts[0].begin == 7 and parts[-1].end == 5 and max(p.end - p.begin for p in parts) == logs.SPLIT
    assert [(p.begin, p.end) for p in logs.ranges({"a": 250}, 100)] == [(0, 100), (100, 200), (200, 250)]


def test_encoder_counts_words_of_many_texts(spark):
    r = random.Random(12)
    texts = [None, "", "...", "Ação ação x"] + [" ".join(r.choices(["um", "dois", "três", "x9", "y", "😀z"], k=r.randint(0, 30))) for _ in range(vector.ENCODED + 50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    rows = frame.select("id", "text", tx.terms(F.col("text")).alias("words"), vector.hashing_encoder(F.col("text")).alias("v"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for row in rows.collect():
        want = np.zeros(384)
        for w in row.words:
            want[vector.fnv1a(w) % 384] += 1
        norm = np.linalg.norm(want)
        assert row.v == (want / norm if norm else want).astype(np.float32).tolist()
    # texts are counted together, in Arrow
    assert re.search(r"ArrowEvalPython.*\], 25[0-9]", plan) and vector.hashing_encoder(F.col("text")) is not None


def test_a_log_that_grows(spark, tmp_path):
    logs.register(spark)
    log = tmp_path / "grow.log"
    log.write_text("".join(log_record(i) for i in range(5)))
    for n in range(3):
        stream = spark.readStream.format("commitlog").load(str(log))
        incremental.run_available(stream, lambda batch, i: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}")), str(tmp_path / "state"))
        with log.open("a") as f:
            f.write("".join(log_record(i) for i in range(5 * n + 5, 5 * n + 10)))
    assert sorted(int(x.sha) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(15))


def test_yaml_front_matter(spark):
    texts = [
        "---\na: 1\nb: [x, 'y z', 2.5]\nc:\n  - one\n  - {k: v, n: null}\nd: >-\n  folded\n  line\ne: \"q: \\\"w\\\"\"\nf: 2024-01-02\ng: yes\nh: true\n---\nbody\n---\nmore",
        "---\nbroken: [1, 2\n---\nbody", "no block", "---\n---\nempty block", "---\njust words\n---\nbody", "---\na: &x [1]\nb: *x\n---\naliases", None, "", "---\r\na: b\r\n---\r\nwindows", "--- \na: b\n---  \nspaces",
    ]
    rows = files.with_front(spark.createDataFrame(list(enumerate(texts)), "i int, content string")).select("i", "text", F.to_json("front").alias("front")).orderBy("i").collect()
    front = lambda i: json.loads(rows[i].front)
    assert front(0) == {"a": 1, "b": ["x", "y z", 2.5], "c": ["one", {"k": "v", "n": None}], "d": "folded line", "e": 'q: "w"', "f": "2024-01-02", "g": "yes", "h": True}
    assert [x.text for x in rows] == ["body\n---\nmore", texts[1], "no block", "empty block", "body", texts[5], None, "", "windows", "spaces"]
    assert all(front(i) == {} for i in (1, 2, 3, 4, 5, 6, 7)) and front(8) == front(9) == {"a": "b"}


def test_citations_and_refs(spark):
    docs = spark.createDataFrame([("a", "see `src/lib/x.ts:3-9` and `y.py`"), ("b", "`./lib/x.ts` `index.ts` `no such.ts` `readme.md`"), ("c", "`other/deep/x.ts`, `/lib/x.ts`")], "doc string, text string")
    code = spark.createDataFrame([("p/src/lib/x.ts",), ("p/other/deep/x.ts",), ("p/y.py",), ("p/a/index.ts",), ("p/b/index.ts",)], "path string")
    got = values(graph.resolve_files(docs.select("doc", F.explode(tx.cited_files(F.col("text"))).alias("cited")), code), "doc", "cited", "target")
    assert got == [("a", "src/lib/x.ts", "p/src/lib/x.ts"), ("a", "y.py", "p/y.py"), ("b", "lib/x.ts", "p/src/lib/x.ts"), ("c", "lib/x.ts", "p/src/lib/x.ts"), ("c", "other/deep/x.ts", "p/other/deep/x.ts")]
    said = [("a", "r1", "**Card:** #101", None), ("b", "r2", "text\nCloses #102", None), ("c", "r2", "none", "feat/103-new-thing"), ("d", "r1", "fixes #104", None), ("e", "r1", "plain", None)]
    refs = [("r1", 101, "card:r1#101"), ("r2", 101, "card:r2#101"), ("r2", 102, "pr:r2#102"), ("r3", 103, "card:r3#103"), ("r2", 104, "card:r2#104"), ("r3", 104, "card:r3#104")]
    refs = spark.createDataFrame(refs, "repo string, number int, key string")
    numbers = spark.createDataFrame(said, "doc string, repo string, text string, branch string").select("doc", "repo", tx.explicit_number(F.col("text"), F.col("branch")).alias("number"))
    assert values(graph.resolve_numbers(numbers, refs), "doc", "number", "target") == [("a", 101, "card:r1#101"), ("b", 102, "pr:r2#102"), ("c", 103, "card:r3#103")]


def test_edges_of_documents(spark):
    docs = spark.createDataFrame(
        [("doc:p1", "planning", "r1", "101-new", "**Card:** #101 and `lib/x.ts`", None), ("sessao:d1", "diario", "r1", None, "worked on #101 #999", None), ("pr:r1#7", "github", "r1", None, "see #101", "feat/101-plain"), ("doc:p2", "planning", "r1", "plain", "none", None)],
        "key string, source string, repo string, feature string, text string, branch string",
    )
    refs, code = spark.createDataFrame([("r1", 101, "card:r1#101")], "repo string, number int, key string"), spark.createDataFrame([("a/lib/x.ts",)], "path string")
    assert values(graph.document_edges(docs, code, refs), "src", "dst", "rel", "origin") == [
        ("doc:p1", "arquivo:a/lib/x.ts", "toca", "rotulo"), ("doc:p1", "card:r1#101", "implementa", "planning"), ("doc:p1", "card:r1#101", "referencia", "rotulo"), ("doc:p1", "feature:101-new", "pertence", "planning"),
        ("doc:p2", "feature:plain", "pertence", "planning"), ("feature:101-new", "card:r1#101", "implementa", "slug"), ("pr:r1#7", "card:r1#101", "implementa", "github"), ("pr:r1#7", "card:r1#101", "referencia", "rotulo"),
        ("pr:r1#7", "feature:plain", "pertence", "rotulo"), ("sessao:d1", "card:r1#101", "registra", "rotulo"),
    ]


def test_code_is_cut_in_one_look(spark):
    r = random.Random(8)
    texts = [None, "", " \n\u3000", "é" * 3499 + "\nb"] + ["\n".join(r.choices(["", " ", "\u2003\t", "x = 1", "ação " * 9, "y" * 300], [9, 2, 2, 60, 8, r.random()], k=r.randint(1, 900))) for _ in range(40)]

    def brute(text):
        lines, out, begin, size = (text or "").split("\n"), [], 0, 0
        for i, line in enumerate(lines, 1):
            size += len(line) + 1
            if (i - begin >= 70 and not line.strip()) or size >= 3500 or i - begin >= 130 or i == len(lines):
                if "\n".join(lines[begin:i]).strip():
                    out.append((f"T:{begin + 1}-{i}", "\n".join(lines[begin:i]).strip()))
                begin, size = i, 0
        return out

    assert cut(spark, texts, code=True) == [brute(t) for t in texts]
    rows = chunks.passages(spark.createDataFrame([(1, "T", "x")], "doc_id long, title string, text string"), code=F.lit(True))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # no line is an element that an expression is evaluated for
    assert "aggregate(" not in plan and rows.schema.simpleString() == "struct<doc_id:bigint,ord:int,breadcrumb:string,text:string,token_est:bigint>"


def test_sections_code_and_roots(spark):
    rows = spark.createDataFrame([(1, "# A\nx\n## Decisão final\ny\n### z\nw\n## Next\nq"), (2, "# Decisao\nall\n# B\nno"), (3, "nothing"), (4, None), (5, "#decisao\n####### decisao\n###### a decisão")], "doc_id long, text string")
    assert values(chunks.section(rows, "decisao"), "doc_id", "section") == [(1, "## Decisão final\ny\n### z\nw"), (2, "# Decisao\nall"), (5, "###### a decisão")]
    body = "\n".join(f"line {i}" if i % 75 else "" for i in range(1, 400))
    code = spark.createDataFrame([(1, "a.py", body), (2, "b.py", "\n\n"), (3, "c.py", "x" * 4000 + "\ny")], "doc_id long, title string, text string")
    got = values(chunks.passages(code, code=F.lit(True)), "doc_id", "ord", "breadcrumb")
    assert got == [(1, 0, "a.py:1-75"), (1, 1, "a.py:76-150"), (1, 2, "a.py:151-225"), (1, 3, "a.py:226-300"), (1, 4, "a.py:301-375"), (1, 5, "a.py:376-399"), (3, 0, "c.py:1-1"), (3, 1, "c.py:2-2")]
    paths = spark.createDataFrame([("C:\\Docs\\a.md",), ("/srv/docs/x/b.md",), ("/srv/docs2/c.md",), ("/tmp/d.md",)], "path string")
    assert values(files.under_roots(paths, spark.createDataFrame([("c:/docs/",), ("/SRV/docs",)], "root string")), "path") == [("/srv/docs/x/b.md",), ("C:\\Docs\\a.md",)]


def test_validity_and_successors(spark):
    runs = spark.createDataFrame([(1, "boom", True, True, True), (2, None, False, None, True), (3, None, True, False, True), (4, None, True, True, False), (5, None, True, True, True), (6, None, True, None, True)], "i int, error string, diagnosed boolean, semantic boolean, resolvable boolean")
    reason = evaluation.validity(F.col("error"), F.col("diagnosed"), F.col("semantic"), F.col("resolvable"))
    assert values(runs.select("i", reason.alias("r")), "i", "r") == [(1, "erro"), (2, "sem-diagnostico"), (3, "so-lexico"), (4, "apodreceu"), (5, None), (6, "so-lexico")]
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3)], "id int, supersedes int")
    assert values(reports.with_successors(rows), "id", "superseded_by") == [(1, 3), (2, None), (3, 4), (4, None)]


def test_decisions_are_recorded_whole(spark, tmp_path):
    root = str(tmp_path / "record")
    schema = "id long, ts timestamp, kind string, scope string, repo string, fact string, why string, alternatives string, refs array<string>, supersedes long"
    when = datetime.datetime(2024, 5, 6, 7, 8)
    first = [(1, when, "regra", "#101", "r1", "Use um só escritor. Sempre.", "travas", None, ["#101", "x.ts"], None), (2, when, "fato", None, None, "¿?", "", "", [], None)]
    refs, features, code = spark.createDataFrame([("r1", 101, "card:r1#101")], "repo string, number int, key string"), spark.createDataFrame([("plain",)], "feature string"), spark.createDataFrame([("a/x.ts",)], "path string")
    decisions.record(root, spark.createDataFrame(first, schema), refs, features, code)
    stale = manifest.read(spark, root)
    decisions.record(root, spark.createDataFrame([(3, when, "regra", "plain", "r1", "Outra", None, None, None, 1)], schema), refs, features, code, encoder=None)
    with pytest.raises(ValueError):
        decisions.record(root, spark.createDataFrame(first[:1], schema), refs, features, code)
    with pytest.raises(manifest.Stale):
        manifest.commit(spark, root, stale, {})
    now = decisions.read(spark, root)
    assert values(now["decisions"], "id", "superseded_by", "doc_path") == [(1, 3, "decisoes/2024-05-06-use-um-so-escritor-sempre-1.md"), (2, None, "decisoes/2024-05-06-decisao-2.md"), (3, None, "decisoes/2024-05-06-outra-3.md")]
    texts = {r.path: r.text for r in now["documents"].collect()}
    assert texts["decisoes/2024-05-06-use-um-so-escritor-sempre-1.md"] == "---\ndata: 2024-05-06\ntipo: regra\nescopo: #101\n---\n\n# Use um só escritor.\n\nUse um só escritor. Sempre.\n\n**Por quê:** travas\n\n**Refs:** #101 · x.ts\n"
    assert texts["decisoes/2024-05-06-outra-3.md"] == "---\ndata: 2024-05-06\ntipo: regra\nescopo: plain\nsubstitui: 1\n---\n\n# Outra\n\nOutra\n"
    assert values(now["edges"], "src", "dst") == [("decisao:3", "feature:plain")]  # the first is replaced
    assert values(now["vectors"].where("embedding IS NULL"), "id") == [(3,)]
    decisions.backfill(spark, root)
    assert decisions.read(spark, root)["vectors"].where("embedding IS NULL").count() == 0
    before = decisions.read(spark, root, 0)
    assert before["decisions"].count() == before["vectors"].count() == before["documents"].count() == 2 and values(before["edges"], "src") == [("decisao:1",)]


def test_targets_of_cases(spark):
    filters = "struct<source:string,repo:string,feature:string,doc_type:string>"
    docs = spark.createDataFrame([("A/b/One.md", ("docs", "r", None, "doc")), ("a/c/two.ts", ("code", "s", None, "code"))], f"path string, doc {filters}")
    none = (None, None, None, None)
    rows = [(1, "positivo", None, ["b\\one"], none), (2, "positivo", None, ["two.ts"], ("code", "", None, None)), (3, "positivo", None, ["two.ts"], ("docs", None, None, None)), (4, "positivo", None, [], none), (5, "negativo", True, [], none), (6, "negativo", False, [], none)]
    cases = spark.createDataFrame(rows, f"case_id long, kind string, volatile boolean, expected array<string>, filters {filters}")
    assert values(evaluation.resolved(cases, docs), "case_id", "path") == [(1, "A/b/One.md"), (2, "a/c/two.ts")]
    assert values(evaluation.target_faults(cases, docs, "s", 6), "fault", "case_id") == [("no target satisfies the case", 3), ("no target satisfies the case", 4)]
    assert {f for f, _ in values(evaluation.target_faults(cases.where("case_id IN (1, 5)"), docs, "s", 6), "fault", "case_id")} == {"fewer than 6 cases", "no code target", "no target in s", "fewer than two negatives"}
    assert ("no volatile negative", None) in values(evaluation.target_faults(cases.where("case_id = 6").unionByName(cases.where("case_id = 6")), docs, "s", 1), "fault", "case_id")


def test_lookups_of_one_text_are_ranked_once(spark, monkeypatch):
    """What many requests share is cut to the limit before it meets them: rows follow requests and entities, not their product."""
    entities = spark.createDataFrame([(f"card:r#{i}", "arquivo" if i % 2 == 0 else "card", f"Name {i}") for i in range(300)], "key string, kind string, title string")
    requests = spark.createDataFrame([(i, " R#1") for i in range(200)] + [(900, "name 29"), (901, "card 123"), (902, None), (903, "123 or r#2"), (903, "r#29")], "request int, text string")
    held = []
    whole = graph.Window.partitionBy
    monkeypatch.setattr(graph.Window, "partitionBy", staticmethod(lambda *c: held.append(c) or whole(*c)))
    found = graph.lookups(entities, requests)
    rows = {r: [(x.key, x.place) for x in found.collect() if x.request == r] for r in (0, 199, 900, 901, 902, 903)}
    kind = lambda k: int(k.split("#")[1]) % 2
    of = lambda part: sorted((f"card:r#{i}" for i in range(300) if part in f"card:r#{i}"), key=lambda k: (kind(k), k))[:10]
    assert rows[0] == rows[199] == [(k, i + 1) for i, k in enumerate(of("r#1"))]
    assert [k for k, _ in rows[900]] == sorted([f"card:r#{i}" for i in (29, *range(290, 300))], key=lambda k: (kind(k), k))[:10]
    assert rows[901] == [("card:r#123", 1)] and rows[902] == [] and rows[903] == [("card:r#123", 1)]
    assert ("sought",) in held and ("request",) in held


def test_what_a_task_holds_of_a_batch_is_bounded(spark, monkeypatch):
    class Texts:
        columns, schema = ["id", "text"], {"id": T.StructField("id", T.LongType())}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(containment, "COUNTED", 1 << 14)
    rng = random.Random(4)
    pool = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(800)]
    lines = [" ".join(rng.choices(pool, k=120)) for _ in range(6000)]

    def peak(run, n, kind):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(lines[:n]).cast(kind)], names=["id", "text"])
        tracemalloc.start()
        rows = sum(out.num_rows for out in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most

    wanted = [w.encode() for w in pool]
    for run, kind in ((postings.weighted(Texts(), {"text": 1.0}, wanted), pa.binary()), (containment._gram_rows(Texts(), [3], None, True), pa.string()), (containment._gram_rows(Texts(), [3], None, False), pa.string())):
        (few, less), (many, more) = peak(run, 600, kind), peak(run, 6000, kind)
        assert more < 1.6 * less and many >= few


def test_grams_are_counted_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abcabc", "bcab", "", "abcd"] * 40)], "id int, text string").repartition(2)
    counts = lambda: values(containment._gram_rows(docs, [3], None, True).groupBy("gram").agg(F.sum("n").alias("n")), "gram", "n")
    whole = counts()
    assert sorted(n for _, n in whole) == [40, 80, 80, 80]
    monkeypatch.setattr(containment, "COUNTED", 3)
    monkeypatch.setattr(containment, "AT_ONCE", 2)
    assert counts() == whole


def test_one_search_has_the_ranks_of_both_depths(spark, monkeypatch):
    sf_dir, searched = "/root/testdata/sf0.001", []
    whole = lexical.bm25
    monkeypatch.setattr(lexical, "bm25", lambda *args: searched.append(1) or whole(*args))
    base, head = (values(rows, "case_id", "rank") for rows in queries.two_depths(spark, sf_dir))
    assert len(searched) == 1
    assert base == values(queries.expected_ranks(spark, sf_dir, 10), "case_id", "rank")
    assert head == values(queries.expected_ranks(spark, sf_dir, 2), "case_id", "rank")
