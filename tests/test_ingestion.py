"""Loads into a store, Word files, and what an engine over a store answers."""

import io
import json
import zipfile

import pytest

from lodestone.operators import registry
from lodestone.plans import ingestion
from lodestone.plans.config import EngineConfig
from lodestone.plans.providers import HashedWords
from lodestone.sources.word import word

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
CONFIG = EngineConfig(embedding_dim=128)


def paragraph(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def docx(body, title=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Aufz"><w:name w:val="List Bullet"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
    return out.getvalue()


def test_word_files():
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = paragraph("The Kiln Book", "Title") + paragraph("Firing", "Heading1") + paragraph("Slow  at first.") + paragraph("one", "Aufz") + paragraph("") + paragraph("two", "Aufz")
    body += paragraph("Glazes", "berschrift2") + "<w:tbl>" + row("name", "cone") + row("", "") + row("a|b", "6") + "</w:tbl>" + paragraph("last", "Aufz")
    got, title = word(docx(body))
    assert title == "The Kiln Book"
    assert [(e["kind"], e["text"], e["level"]) for e in got] == [
        ("heading", "Firing", 1), ("paragraph", "Slow at first.", None), ("list", "- one\n- two", None), ("heading", "Glazes", 2), ("table", "| name | cone |\n|---|---|\n| a\\|b | 6 |", None), ("list", "- last", None),
    ]
    assert word(docx(paragraph("x", "Title"), "Named"))[1] == "Named"
    assert word(b"no zip") is None


def test_directories_load_once(spark, tmp_path):
    src, store = tmp_path / "src", registry.Store(spark, str(tmp_path / "kb"), "Kilns")
    (src / "sub").mkdir(parents=True)
    (src / "a.md").write_text("# Alpha kilns\n\nAlpha kilns reach 1200 degrees in nine hours.")
    (src / "sub" / "b.txt").write_text("Beta kilns burn beech wood.\n\nThey cool for two days.")
    (src / "c.docx").write_bytes(docx(paragraph("Gamma kilns", "Title") + paragraph("Gamma kilns are electric and small.")))
    (src / "bad.docx").write_bytes(b"nothing")
    (src / "empty.md").write_text("# only a heading")
    load = lambda **more: {r.source: r.status for r in ingestion.ingest_directory(store, str(src), CONFIG, **more).collect()}
    assert load() == {"a.md": "indexed", "sub/b.txt": "indexed", "c.docx": "indexed", "bad.docx": "failed", "empty.md": "failed"}
    assert ingestion.stats(store) == {"version": 1, "space": ["hashed-words", 128], "documents": 3, "parents": 3, "chunks": 3, "answer_cache": 0}
    assert load() == {"a.md": "skipped", "sub/b.txt": "skipped", "c.docx": "skipped", "bad.docx": "failed", "empty.md": "failed"}
    assert store.manifest()["version"] == 1
    (src / "a.md").write_text("# Alpha kilns\n\nAlpha kilns reach 1300 degrees in ten hours.")
    (src / "sub" / "b.txt").unlink()
    (src / "bad.docx").unlink()
    pages = spark.createDataFrame([("https://k.example/d#x", "<title>Delta kilns</title><article><h1>Delta</h1><p>Delta kilns are solar.</p></article>")], "url string, html string")
    assert [(r.source, r.status) for r in ingestion.ingest_pages(store, pages, CONFIG).collect()] == [("https://k.example/d", "indexed")]
    assert load(prune=True) == {"a.md": "updated", "sub/b.txt": "deleted", "c.docx": "skipped", "empty.md": "failed"}
    assert sorted(r.source for r in store.read("documents").collect()) == ["a.md", "c.docx", "https://k.example/d"]
    assert any("1300" in r.text for r in store.read("chunks").collect()) and not any("1200" in r.text or "Beta" in r.text for r in store.read("chunks").collect())
    one = store.read("documents").where("source = 'a.md'")
    assert {r.doc_id for r in store.vectors("doc_id", one).collect()} == {one.first().doc_id}
    with pytest.raises(ValueError):
        ingestion.ingest_directory(store, str(src), EngineConfig(embedding_dim=256), HashedWords(256), force=True)
    engine = ingestion.opened(store, CONFIG)
    q = spark.createDataFrame([("1", "How hot do Alpha kilns get?"), ("2", "Compare Gamma kilns and Delta kilns: electric or solar?"), ("3", "Summarize Gamma kilns")], "request_id string, text string")
    got = {r.request_id: r for r in engine.ask(q).collect()}
    assert "1300" in got["1"].answer and got["1"].grounded
    assert got["2"].route == "compare_documents" and {"electric", "solar"} <= set(got["2"].answer.replace(".", " ").replace("[", " ").split()) and len(got["2"].citations) == 2
    assert got["3"].answer == "Gamma kilns are electric and small. [1]" and got["3"].grounded and len(got["3"].citations) == 1
    store.delete_collection()
    assert ingestion.stats(store)["documents"] == 0


def test_uploads(spark):
    rows = [("r", "a.md", 10), ("r", "b.exe", 10), ("r", "c.txt", 0), ("r", "d.pdf", 10**9)] + [("s", f"{i}.md", 5) for i in range(3)]
    got = ingestion.valid_uploads(spark.createDataFrame(rows, "request_id string, path string, length long"), most_files=4).collect()
    assert {r.path: r.reason for r in got if r.request_id == "r"} == {"a.md": None, "b.exe": "unsupported type", "c.txt": "empty", "d.pdf": "too large"}
    assert {r.reason for r in ingestion.valid_uploads(spark.createDataFrame(rows, "request_id string, path string, length long"), most_files=2).collect()} == {"too many files"}


def test_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from lodestone.__main__ import main

    monkeypatch.setattr("lodestone.plans.shipping.ship", lambda spark: None)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# Alpha\n\nAlpha kilns reach 1200 degrees.")
    kb = str(tmp_path / "kb")
    assert main(["ingest", str(tmp_path / "src"), "--store", kb]) == 0
    assert capsys.readouterr().out == "indexed\ta.md\t1\n"
    main(["ask", "How hot are Alpha kilns?", "--store", kb])
    assert "1200" in json.loads(capsys.readouterr().out)["answer"]
    main(["stats", "--store", kb])
    assert json.loads(capsys.readouterr().out)["documents"] == 1
    with pytest.raises(SystemExit):
        main(["stats", "x", "--store", kb])


def test_collections_and_inputs(spark):
    c = spark.createDataFrame([("a", 3)], "name string, version long")
    got = registry.ensure_collection(c, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"))
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("b", 0)]
    q, known = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "text string"), spark.createDataFrame([("y", 1)], "text string, embedding int")
    assert [r.text for r in registry.embedding_inputs(q, known).collect()] == ["x"]


def test_engine_needs_something(spark, tmp_path):
    with pytest.raises(ValueError):
        ingestion.opened(registry.Store(spark, str(tmp_path), "none"))
    assert ingestion.clear_cache(registry.Store(spark, str(tmp_path), "none")) == 0


def test_an_engine_follows_versions(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# Alpha\n\nAlpha kilns reach 1200 degrees.")
    store = registry.Store(spark, str(tmp_path / "kb"), "c")
    ingestion.ingest_directory(store, str(tmp_path / "src"), CONFIG)
    now = ingestion.Current(store, CONFIG)
    first = now.get()
    assert now.get() is first
    (tmp_path / "src" / "b.md").write_text("# Beta\n\nBeta kilns are wide.")
    ingestion.ingest_directory(store, str(tmp_path / "src"), CONFIG)
    assert now.get() is not first and now.get().chunks.count() == 2
