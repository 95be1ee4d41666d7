import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, decide, signals, structure, toc
from quire.operators.candidates import merge_runs
from quire.plans.oracle import ORACLE
from quire.plans.queries import QUERIES
from quire.plans.segment import segment
from quire.sources.blocks import blocks_from_text, completed, isolation

SF = "/root/testdata/sf0.001"
TABLES = "documents events pages part lineitem conversations".split()


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert ordered(tuple(map(plain, r)) for r in found.select(*want.columns).collect()) == ordered(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", ["seg_scores", "seg_triage", "seg_plans", "seg_chapters"])
def test_books_of_one_page_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    page = lambda k, head, more: (k, f"<html><body><nav></nav><article>{head}<p><b>Bold line</b></p><p>{'word ' * 20}</p>{more}</article></body></html>")
    made = [page(k, f"<h1>Title {k}</h1>", "") for k in range(10)] + [page(10, "<h1>It ends here.</h1>", ""), page(20, "", "<p><b>Two words</b></p>"), page(30, "<h1>No end</h1>", "".join(f"<p><b>Line {'x' * k}</b></p>" + f"<p>{'word ' * 20}</p>" * 4 for k in range(5)))]
    spark.createDataFrame(made, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(ORACLE[name])
    found = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert ordered(tuple(map(plain, r)) for r in found) == ordered(tuple(map(plain, r)) for r in want.fetchall())


def blocks(spark, lines, doc=1):
    """lines: (text, features)."""
    rows = [{"doc_id": doc, "index": k, "tag": "p", "is_paragraph": True, "text": t, "is_empty": not t, "word_count": len(t.split()), **f} for k, (t, f) in enumerate(lines)]
    names = sorted({n for r in rows for n in r})
    kinds = {"doc_id": "long", "index": "int", "tag": "string", "is_paragraph": "boolean", "text": "string", "is_empty": "boolean", "word_count": "int", "style_level": "int", "style_id": "string", "bold": "boolean", "alignment": "string", "max_size": "int", "page_break_before": "boolean", "num": "struct<num_id:int,ilvl:int>"}
    made = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return completed(isolation(made.fillna({n: False for n in names if kinds[n] == "boolean"})))


BODY = ("words of body text that run on for a while and then some more of them until the end " * 2, {})


def chapters(plan):
    return [(r.title, r.start, r.end, r.role) for r in plan.chapters.orderBy("doc_id", "ordinal").collect()]


def test_scores(spark):
    lines = [("Alpha", {"style_level": 0}), ("Alpha", {"style_level": 1}), ("one two three four five six seven eight nine.", {"bold": True}), (" ".join(["word"] * 17) + ".", {"bold": True}), ("Chapter 4", {}), ("CHAPTER IV", {})]
    rows = blocks(spark, lines).withColumns({"band_low": F.lit(None).cast("int"), "band_high": F.lit(None).cast("int"), "body_size": F.lit(11)})
    apart = merge_runs(rows.withColumn("index", F.col("index") * 10)).withColumn("in_toc", F.lit(False))
    found = [(r.confidence, r.level, r.band) for r in signals.score(apart).orderBy("index").collect()]
    assert found == [(0.91, "chapter", "very_high"), (0.546, "section", "low"), (0.112, "section", "low"), (0.034, "section", "low"), (0.955, "chapter", "very_high"), (0.96, "chapter", "very_high")]


def test_keyword_book(spark):
    lines = [("The Book", {})] + [x for n in ("I", "II", "III", "IV") for x in ((f"Chapter {n}", {}), BODY, BODY, BODY)]
    plan = segment(blocks(spark, lines), titles=spark.createDataFrame([(1, "The Book")], "doc_id long, title string"))
    assert chapters(plan) == [("Front Matter", 0, 1, "front_matter"), ("Chapter I", 1, 5, "body"), ("Chapter II", 5, 9, "body"), ("Chapter III", 9, 13, "body"), ("Chapter IV", 13, 17, "body")]
    row = plan.plans.first()
    assert (row.abstained, row.split_level, row.method) == (False, "chapter", "iqr_fallback+uniform_cluster") or not row.abstained


def test_abstains_without_structure(spark):
    plan = segment(blocks(spark, [BODY] * 8))
    assert chapters(plan) == [("(whole document)", 0, 8, "body")]
    assert plan.plans.first().abstained


def test_list_numbered_book(spark):
    lines = [x for k in range(4) for x in ((f"Part of it {k}", {"num": (1, 0)}), BODY, BODY, BODY, BODY, BODY, BODY)]
    plan = segment(blocks(spark, lines))
    assert [c[1:3] for c in chapters(plan)] == [(0, 7), (7, 14), (14, 21), (21, 28)]
    assert plan.plans.first().method == "list_numbering"


def test_given_contents(spark):
    lines = [x for k in range(3) for x in ((f"Heading {k}", {}), BODY, BODY, BODY)]
    entries = spark.createDataFrame([(1, 4 * k, f"Entry {k}", 1) for k in range(3)], "doc_id long, index int, title string, level int")
    plan = segment(blocks(spark, lines), entries)
    assert [c[0] for c in chapters(plan)] == ["Entry 0", "Entry 1", "Entry 2"]
    assert plan.plans.first().method == "toc_authority"


def test_typed_contents(spark):
    names = ["The Old Mill", "The River", "Night Falls", "A Journey", "Home Again"]
    lines = [("Contents", {})] + [(f"{n} .... {10 * k + 3}", {}) for k, n in enumerate(names)] + [("", {}), BODY] + [x for n in names for x in ((n, {"bold": True}), BODY, BODY, BODY)]
    plan = segment(blocks(spark, lines))
    assert [c[0] for c in chapters(plan)] == ["Front Matter", *names]


def test_align():
    pool = [{"index": 5, "norm": "interlude", "level": 0}, {"index": 9, "norm": "the end", "level": 0}]
    wanted = [{"title": "Interlude: x", "norm": "interlude x", "level": 1}, {"title": "The End", "norm": "the end", "level": 1}]
    assert [(m["index"], m["ratio"]) for m in toc.align(wanted, pool)] == [(5, 0.92), (9, 1.0)]
    assert toc.align(wanted[::-1], pool) == [{"index": 9, "title": "The End", "level": 1, "ratio": 1.0}]


def test_increasing():
    assert decide.increasing([1, 2, 1, 3]) == [0, 1, 3]
    assert decide.increasing([]) == [] and decide.increasing([5, 4, 3]) == [0]


def test_roles(spark):
    rows = [(1, k, t, k, k + 1, lv, d) for k, (t, lv, d) in enumerate([("Front Matter", "front", None), ("My Book", "chapter", "chapter"), ("Contents", "chapter", "contents"), ("One", "chapter", "chapter"), ("My Book", "chapter", "chapter"), ("Appendix", "chapter", "appendix"), ("Licence", "chapter", "chapter")])]
    made = spark.createDataFrame(rows, "doc_id long, ordinal int, title string, start int, end int, level string, div_type string")
    found = assemble.roles(made, spark.createDataFrame([(1, "My  book")], "doc_id long, title string")).orderBy("ordinal")
    assert [r.role for r in found.collect()] == ["front_matter", "front_matter", "front_matter", "body", "body", "back_matter", "back_matter"]


def test_levels_and_split(spark):
    rows = [(1, k * 10, f"Chapter {n}", 0, False, False) for k, n in enumerate([1, 2, 3, 4])] + [(1, 5, "Part 1", 0, False, False), (1, 25, "Part 2", 0, False, False)]
    made = spark.createDataFrame(rows, "doc_id long, index int, title string, style_level int, in_toc boolean, toc_authoritative boolean")
    levels = structure.levels(structure.classify(made))
    assert {r.div_type: (r["count"], r.progression) for r in levels.collect()} == {"chapter": (4, 1.0), "part": (2, 1.0)}
    split = structure.split_levels(levels).first()
    assert (split.split_level, split.hierarchy) == ("chapter", "Part > Chapter")


def test_titles_are_looked_at_once(spark):
    rows = spark.createDataFrame([(1, "Chapter IV"), (2, None), (3, "Chapter IV"), (4, ""), (5, "3. x")], "k int, title string")
    once, each = structure.divided(rows), structure.divided(rows, most=2)
    assert sorted(once.collect(), key=lambda r: r.k) == sorted(each.select(*once.columns).collect(), key=lambda r: r.k)
    assert "regexp" in each._jdf.queryExecution().toString().lower() and "regexp" not in once._jdf.queryExecution().toString().lower()


def test_filtered_levels_buffer_no_document(spark):
    rows = spark.createDataFrame([(1, 0, "part"), (1, 1, "chapter"), (2, 0, "section")], "doc_id long, index int, level string")
    found = decide.filter_level(rows, "part")
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r["index"]) for r in found.collect()) == [(1, 0), (2, 0)]


def test_text_blocks_with_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb")], "doc_id long, text string")
    assert [(r.doc_id, r["index"], r.text) for r in blocks_from_text(docs).orderBy("doc_id", "index").collect()] == [(2, 0, ""), (3, 0, "a"), (3, 1, ""), (3, 2, "b")]
    empty = segment(blocks_from_text(docs.limit(0)))
    assert empty.chapters.count() == 0 and empty.plans.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from quire.streaming.documents import stream_segments

    text = "\n".join(x for n in ("I", "II", "III") for x in (f"Chapter {n}", BODY[0], BODY[0], BODY[0]))
    spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    sink = lambda plan, n: plan.chapters.select("doc_id", "title", "start").write.mode("overwrite").parquet(str(tmp_path / f"out/{n}"))
    stream_segments(stream, blocks_from_text, sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/*")).collect()))
    want = segment(blocks_from_text(spark.read.parquet(str(tmp_path / "in")))).chapters.select("doc_id", "title", "start")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 6


def test_no_llm_in_the_library():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "quire")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read())
