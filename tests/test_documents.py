import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.operators.chunking import chunk, linear_tables, split_table, split_text, tail, tokens
from lodestone.plans.config import EngineConfig
from lodestone.sources import elements, files, layout

SMALL = EngineConfig(child_tokens=64, child_overlap=12, parent_tokens=400)


def p(text, kind="paragraph", level=None, page=None):
    return {"kind": kind, "text": text, "level": level, "page": page}


def h(text, level):
    return p(text, "heading", level)


def prose(n, word="word"):
    return " ".join(f"Sentence {i} holds some {word} content here." for i in range(n))


def table(rows, cols=3):
    line = lambda r: "| " + " | ".join(f"r{r}c{c} value" for c in range(cols)) + " |"
    return "\n".join([line(0), "|" + "---|" * cols, *(line(i) for i in range(1, rows + 1))])


def test_budgets_hold():
    for text in (prose(60), "x" * 3000, "\n\n".join([prose(3)] * 20)):
        got = chunk([p(text)], "t", SMALL)
        assert all(tokens(c["text"]) <= SMALL.child_tokens for c in got) and all(tokens(c["parent_text"]) <= SMALL.parent_tokens for c in got)
        assert max(c["parent"] for c in got) == len({c["parent"] for c in got}) - 1


def test_split_text_loses_no_word():
    text = prose(40) + "\n\n" + prose(5, "other")
    parts = split_text(text, 50)
    assert " ".join(parts).split() == text.split() and all(tokens(x) <= 50 for x in parts)
    assert split_text("  ", 5) == [] and split_text("ab" * 50, 5) == ["ab" * 10] * 5


def test_children_overlap_by_whole_sentences():
    got = [c["text"] for c in chunk([p(prose(36))], "t", SMALL)]
    assert len(got) > 5
    for a, b in zip(got, got[1:]):
        shared = tail(a, SMALL.child_overlap)
        assert shared and b.startswith(shared)


def test_tables_stay_whole_or_repeat_their_header():
    t = table(60)
    parts = split_table(t, 200)
    assert len(parts) > 1 and all(x.split("\n")[:2] == t.split("\n")[:2] for x in parts)
    assert [r for x in parts for r in x.split("\n")[2:]] == t.split("\n")[2:]
    got = chunk([p(prose(4)), p(table(12), "table"), p(prose(4))], "t", SMALL)
    assert sum(table(12) in c["text"] for c in got) == 1


def test_paths_and_titles():
    doc = [h("Manual", 1), p("Intro."), h("Battery", 2), h("Charging", 3), p("Slow. " * 80), h("Storage", 2), p("Cool. " * 80)]
    paths = [c["path"] for c in chunk(doc, "Manual", SMALL)]
    assert paths[0] == "" and "Battery > Charging" in paths and paths[-1] == "Storage"
    two = [h("One", 1), p("a " * 200), h("Two", 1), p("b " * 200)]
    assert {c["path"] for c in chunk(two, "Other", SMALL)} == {"One", "Two"}


def test_small_neighbours_share_a_parent():
    doc = [h("T", 1), h("A", 2), p("short a"), h("B", 2), p("short b")]
    assert {c["parent"] for c in chunk(doc, "T", SMALL)} == {0, 1}  # different top headings
    doc = [h("T", 1), h("Top", 2), h("A", 3), p("short a"), h("B", 3), p("short b")]
    got = chunk(doc, "T", SMALL)
    assert {c["parent"] for c in got} == {0} and got[0]["parent_path"] == "Top"


def test_pages():
    got = chunk([p("a", page=3), p("b", page=5), p("c")], "t", SMALL)
    assert (got[0]["page_start"], got[0]["page_end"], got[0]["parent_start"], got[0]["parent_end"]) == (3, 5, 3, 5)


def test_chunk_documents_drops_repeats_and_numbers_the_rest(spark):
    doc = [h("T", 1), h("A", 2), p("x " * 150), h("B", 2), p("y " * 150), h("C", 2), p("x " * 150)]
    df = spark.createDataFrame([("d1", "T", doc), ("d2", "U", [p("only")])], f"doc_id string, title string, elements {chunking.ELEMENTS.simpleString()}")
    got = chunking.chunk_documents(df, SMALL).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got if r.doc_id == "d1"] == [f"d1-c{i:05d}" for i in range(sum(r.doc_id == "d1" for r in got))]
    assert len({(r.doc_id, r.content_hash) for r in got}) == len(got)
    parents = chunking.parents_of(chunking.chunk_rows(df, SMALL)).collect()
    assert {r.parent_id for r in parents} == {"d1-p0000", "d1-p0001", "d1-p0002", "d2-p0000"}
    again = chunking.chunk_documents(df.repartition(3), SMALL).orderBy("chunk_id").collect()
    assert again == got


def test_linear_tables():
    assert linear_tables("a\n| K | V |\n|---|---|\n| range | 5 km |\nb") == "a\nrange: 5 km\nb"
    assert linear_tables("| A | B | C |\n|---|:---:|---:|\n| 1 |  | x\\|y |") == "A: 1; C: x|y"


MARKDOWN = """---
title: "Field guide"
---
# Guide

Intro line one
line two
> quoted

Setext
------
- item one
  more
1. two

```py
# not a heading
```

| A | B |
|---|---|
| 1 | 2 |
***
Under
=====
tail ## x ##"""


def test_markdown():
    got, title = elements.markdown(MARKDOWN)
    assert title == "Field guide"
    assert [(e["kind"], e["text"], e["level"]) for e in got] == [
        ("heading", "Guide", 1), ("paragraph", "Intro line one line two quoted", None), ("heading", "Setext", 2), ("list", "- item one\n  more\n1. two", None),
        ("code", "```py\n# not a heading\n```", None), ("table", "| A | B |\n|---|---|\n| 1 | 2 |", None), ("heading", "Under", 1), ("paragraph", "tail ## x ##", None),
    ]


def test_plain_text(spark):
    text = "OVERVIEW\n\n1.2 Battery care\n\nA wrapped\nparagraph.\n\n- one\n- two\n\nNot a heading."
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(elements.plain_elements("t")).alias("e")).select("e.*").collect()
    assert [(r.kind, r.text, r.level) for r in df] == [("heading", "OVERVIEW", 1), ("heading", "1.2 Battery care", 2), ("paragraph", "A wrapped paragraph.", None), ("list", "- one\n- two", None), ("paragraph", "Not a heading.", None)]


def test_page_and_titles(spark):
    got, title = elements.page("<title>T &amp; x</title><nav>no</nav><article><h1>H</h1><p>a<br>b<ul><li>i</ul></article><footer>no</footer>")
    assert title == "T & x" and [(e["kind"], e["text"]) for e in got] == [("heading", "H"), ("paragraph", "ab"), ("list", "i")]
    names = spark.createDataFrame([("q2-2026_report.pdf",), ("Already Named.md",)], "n string").select(elements.file_title("n")).collect()
    assert [r[0] for r in names] == ["Q2 2026 Report", "Already Named"]


def test_references_end_in_a_semicolon():
    got, title = elements.page("<title>a&amp</title><article><h1>R&amp;D &amp</h1><p>x &lt y&#39;s &#39 &copy;1 &copy2 &amp;amp; &amp;lt; a&b; & &notin; &notit; &#x41; &#x4</p></article>")
    assert title == "a&amp" and [e["text"] for e in got] == ["R&D &amp", "x &lt y's &#39 ©1 &copy2 &amp; &lt; a&b; & ∉ &notit; A &#x4"]


def test_table_to_markdown(spark):
    df = spark.createDataFrame([([["a", "b|c"], [None, ""], ["x\ny"]],), ([["one"]],)], "r array<array<string>>").select(elements.table_to_markdown("r")).collect()
    assert df[0][0] == "| a | b\\|c |\n|---|---|\n| x y |  |" and df[1][0] == ""


def test_addresses(spark):
    df = spark.createDataFrame([(x,) for x in ("8.8.8.8", "127.0.0.1", "10.1.2.3", "172.20.0.1", "169.254.1.1", "example.org")], "h string").select(elements.literal_address_is_public("h")).collect()
    assert [r[0] for r in df] == [True, False, False, False, False, None]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, data in {"a.md": "﻿hi", "sub/b.txt": "café", "c.png": "x", ".hidden/d.md": "x", ".e.md": "x"}.items():
        (tmp_path / name).write_bytes(data.encode("cp1252") if name.endswith("b.txt") else data.encode())
    got = sorted((r.path.rsplit("/", 1)[-1], r.source_type, r.t) for r in files.scan(spark, str(tmp_path)).withColumn("t", files.decoded("content")).collect())
    assert got == [("a.md", "markdown", "hi"), ("b.txt", "text", "café")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "ok.jsonl"), "id string, n int", "id").count() == 2
    (tmp_path / "twice.jsonl").write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(Exception, match="key stands twice"):
        files.json_lines(spark, str(tmp_path / "twice.jsonl"), "id string, n int", "id").collect()


def test_layout(spark):
    rows = [("d", pg, n, t, s, False, y, 0.0, y, 100.0, y + 1) for pg in (1, 2, 3) for n, (t, s, y) in enumerate([("ACME report 2026", 8.0, 0.05), (f"{pg}", 8.0, 0.95), (f"Body text of page {pg} that is long", 10.0, 0.5), ("Heading", 14.0, 0.3)])]
    lines = spark.createDataFrame(rows, "doc_id string, page int, n int, text string, size double, bold boolean, rel_top double, x0 double, y0 double, x1 double, y1 double")
    kept = layout.without_furniture(lines)
    assert {r.text.split(" ")[0] for r in kept.collect()} == {"Body", "Heading"}
    assert layout.body_size(lines).first().body == 10.0
    outline = spark.createDataFrame([("d", 1, 3, "heading")], "doc_id string, page int, level int, title string")
    assert {(r.page, r.level) for r in layout.heading_levels(kept, outline).where("text = 'Heading'").collect()} == {(1, 3), (2, 3), (3, 1)}
    boxes = spark.createDataFrame([("d", 1, 0.0, 0.0, 100.0, 1.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert layout.outside_tables(lines, boxes).where("page = 1").count() == 1
    joined = spark.createDataFrame([(["self-", "contained", "Text"],)], "t array<string>").select(layout.joined_lines("t")).first()[0]
    assert joined == "self-contained Text"
    merged = layout.merge_continuations([p("starts here", page=1), p("and ends.", page=2), p(table(1), "table", page=2), p(table(2), "table", page=3)])
    assert merged[0]["text"] == "starts here and ends." and merged[1]["text"].count("\n") == 4 and len(merged) == 2


def test_lines_become_elements(spark):
    rows = [
        (1, 0, 0, 10.0, "Kiln", 1), (1, 1, 1, 20.0, "care", 1), (1, 2, 2, 30.0, "Burn it in", None), (1, 3, 2, 40.0, "slow-", None), (1, 4, 2, 50.0, "ly at first.", None), (1, 5, 3, 60.0, "• one", None),
        (1, 6, 3, 70.0, "wrapped", None), (1, 7, 4, 80.0, "• two", None), (1, 8, 5, 120.0, "The end goes", None), (2, 0, 0, 10.0, "over the page.", None), (2, 1, 1, 20.0, "   ", None), (2, 2, 2, 30.0, "Next.", None),
    ]
    lines = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, page int, n int, block int, y0 double, text string, level int")
    tables = spark.createDataFrame([("d", 1, 90.0, "| a | b |\n|---|---|\n| 1 | 2 |"), ("d", 2, 99.0, "| c | d |\n|---|---|\n| 3 | 4 |"), ("e", 1, 1.0, "| x | y |\n|---|---|\n| 5 | 6 |")], "doc_id string, page int, y0 double, text string")
    got = {r.doc_id: [(e["kind"], e["text"], e["level"]) for e in r.elements] for r in layout.assembled(lines, tables).collect()}
    assert got["d"] == [
        ("heading", "Kiln care", 1), ("paragraph", "Burn it in slow-ly at first.", None), ("list", "• one wrapped\n• two", None), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", None),
        ("paragraph", "The end goes over the page.", None), ("paragraph", "Next.", None), ("table", "| c | d |\n|---|---|\n| 3 | 4 |", None),
    ]
    assert [e[0] for e in got["e"]] == ["table"]
