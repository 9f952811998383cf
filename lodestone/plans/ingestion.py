"""Folders and pages into a knowledge base: what is new or changed is parsed, cut and embedded, and one version takes it all in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.tables import Scratch
from lodestone.operators import chunking, registry
from lodestone.plans.config import EngineConfig
from lodestone.plans.providers import Embedder, HashedWords
from lodestone.plans.service import Engine
from lodestone.sources import elements, files, word

#: Largest upload, and how many at a time.
MOST_BYTES, MOST_FILES = 25 << 20, 20


def valid_uploads(uploads: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """uploads (request_id, path, length) with a reason for each that isn't taken: its type, its size, or too many at once."""
    counts = uploads.groupBy("request_id").agg(F.count("*").alias("_n"))
    known = files.suffix(F.col("path")).isin(list(files.TYPES))
    reason = F.when(F.col("_n") > most_files, "too many files").when(~known, "unsupported type").when(F.col("length") > most_bytes, "too large").when(F.col("length") == 0, "empty")
    return uploads.join(counts, "request_id").withColumn("reason", reason).drop("_n")


def parsed(found: DataFrame) -> DataFrame:
    """source, source_type, content_hash, title, elements of files (source, source_type, content, content_hash).

    elements are null where a file can't be read: no Word file inside, PDF (decoding is not done here), no body.
    """
    text = files.decoded("content")
    d = found.withColumn("_text", F.when(F.col("source_type").isin("markdown", "text"), text))
    d = d.withColumn("_md", F.when(F.col("source_type") == "markdown", elements.markdown_elements(F.col("_text")))).withColumn("_doc", F.when(F.col("source_type") == "docx", word.word_elements(F.col("content"))))
    d = d.withColumn("_e", F.when(F.col("source_type") == "markdown", F.col("_md.elements")).when(F.col("source_type") == "docx", F.col("_doc.elements")).when(F.col("source_type") == "text", elements.plain_elements("_text")))
    d = d.withColumn("_e", F.when(F.coalesce(elements.has_body(F.col("_e")), F.lit(False)), F.col("_e")))
    own = F.coalesce("_md.title", "_doc.title")
    return d.select("source", "source_type", "content_hash", F.coalesce(own, elements.inferred_title(F.col("_e"), elements.file_title("source"))).alias("title"), F.col("_e").alias("elements"))


def pages_parsed(pages: DataFrame) -> DataFrame:
    """The same of web pages (url, html) that were fetched elsewhere."""
    p = pages.select(T.source_key("url").alias("source"), F.lit("url").alias("source_type"), F.sha2("html", 256).alias("content_hash"), elements.page_elements("html").alias("_p"))
    found = F.when(elements.has_body(F.col("_p.elements")), F.col("_p.elements"))
    return p.select("source", "source_type", "content_hash", F.coalesce("_p.title", elements.inferred_title(F.col("_p.elements"), elements.display_name("source"))).alias("title"), found.alias("elements"))


def ingest(store: registry.Store, documents: DataFrame, scanned: DataFrame, config: EngineConfig | None = None, embedder: Embedder | None = None, force: bool = False, prune: bool = False) -> DataFrame:
    """source, doc_id, status (indexed, updated, skipped, failed, deleted), num_chunks of one load, published as one version.

    documents: what parsed() gives for the scan (source, content_hash). Documents with the registered content are
    skipped unless `force`; what can't be read fails and leaves its registered state; with `prune`, registered files
    that the scan lacks go (pages never do). Chunks whose embedding key is known keep their vector. Cached answers go
    with any change, for they may cite what changed; a load that changes nothing publishes nothing.
    """
    config = config or EngineConfig()
    embedder = embedder or HashedWords(config.embedding_dim)
    scratch = Scratch(documents.sparkSession)
    held = {t: store.read(t) for t in registry.Store.TABLES}
    known = held["documents"]
    scan = scratch.write(scanned.select("source", T.document_id("source").alias("doc_id"), "content_hash"), "scan")
    if known is None:
        state = scan.select("source", "doc_id", F.lit("new").alias("state"))
        gone = None
    else:
        state = scan.join(registry.difference(known, scan), "doc_id").select("source", "doc_id", F.col("status").alias("state"))
        gone = scratch.write(registry.missing(known, scan, ["doc_id"]).select("source", "doc_id"), "gone") if prune else None
    state = scratch.write(state, "state")
    todo = state if force else state.where("state <> 'unchanged'")
    read = scratch.write(documents.join(todo, "source").where("elements IS NOT NULL"), "read")
    rows = scratch.write(chunking.chunk_rows(read.select("doc_id", "title", "elements"), config), "children")
    chunks = chunking.chunks_of(rows).withColumn("embed_hash", T.embedding_key(embedder.model, embedder.dim, "title", "text"))
    counts = scratch.write(chunks.groupBy("doc_id").agg(F.count("*").alias("num_chunks")), "counts")
    done = read.select("source", "doc_id", F.when(F.col("state") == "new", "indexed").otherwise("updated").alias("status")).join(counts, "doc_id").select("source", "doc_id", "status", "num_chunks")
    failed = todo.join(read.select("doc_id"), "doc_id", "left_anti").select("source", "doc_id", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("num_chunks"))
    out = done.unionByName(failed)
    if not force:
        same = state.where("state = 'unchanged'").select("source", "doc_id")
        out = out.unionByName((same.join(known.select("doc_id", "num_chunks"), "doc_id") if known is not None else same.withColumn("num_chunks", F.lit(0).cast("long"))).select("source", "doc_id", F.lit("skipped").alias("status"), "num_chunks"))
    if gone is not None:
        out = out.unionByName(gone.select("source", "doc_id", F.lit("deleted").alias("status"), F.lit(0).cast("long").alias("num_chunks")))
    out = scratch.write(out, "loaded")
    if not out.where("status IN ('indexed', 'updated', 'deleted')").limit(1).count():
        return out
    if held["chunks"] is not None:
        had, new = registry.reuse_vectors(chunks, held["chunks"])
    else:
        had, new = None, chunks
    embedded = new.withColumn("embedding", embedder.documents(F.col("title"), chunking.contextual("section_path", "text")))
    embedded = embedded if had is None else embedded.unionByName(had.select(*embedded.columns))
    records = read.select("doc_id", "source", "source_type", "title", "content_hash").join(counts, "doc_id")
    stale = out.where("status IN ('indexed', 'updated', 'deleted')").select("doc_id")
    fresh = {"documents": records, "parents": chunking.parents_of(rows), "chunks": registry.validate(embedded, embedder.dim)}
    tables = {t: df if held[t] is None else held[t].join(stale, "doc_id", "left_anti").unionByName(df) for t, df in fresh.items()}
    if held["answer_cache"] is not None:
        tables["answer_cache"] = held["answer_cache"].limit(0)
    store.commit(tables, (embedder.model, embedder.dim))
    return out


def ingest_directory(store: registry.Store, folder: str, config: EngineConfig | None = None, embedder: Embedder | None = None, force: bool = False, prune: bool = False) -> DataFrame:
    """ingest() of every supported file below a folder, keyed by its path in it."""
    found = files.scan(store.spark, folder).withColumn("source", files.below(F.col("path"), folder))
    return ingest(store, parsed(found), found, config, embedder, force, prune)


def ingest_pages(store: registry.Store, pages: DataFrame, config: EngineConfig | None = None, embedder: Embedder | None = None, force: bool = False) -> DataFrame:
    """ingest() of fetched pages (url, html)."""
    d = pages_parsed(pages)
    return ingest(store, d, d.select("source", "content_hash"), config, embedder, force)


def opened(store: registry.Store, config: EngineConfig | None = None, embedder: Embedder | None = None, **more) -> Engine:
    """The engine over a store's newest version."""
    config = config or EngineConfig()
    embedder = embedder or HashedWords(config.embedding_dim)
    chunks, parents = store.read("chunks"), store.read("parents")
    if chunks is None:
        raise ValueError("nothing was ingested yet")
    return Engine(chunks, parents, config, embedder, **more)


class Current:
    """The engine over a store's newest version, made anew once a version was published."""

    def __init__(self, store: registry.Store, config: EngineConfig | None = None, embedder: Embedder | None = None):
        self.store, self.args, self.version, self.engine = store, (config, embedder), None, None

    def get(self) -> Engine:
        version = self.store.manifest()["version"]
        if version != self.version:
            self.engine, self.version = opened(self.store, *self.args), version
        return self.engine


def stats(store: registry.Store) -> dict:
    """Version, space and counts of a store: documents, parents, chunks, cached answers."""
    now = store.manifest()
    counts = {t: store.read(t).count() if t in now["tables"] else 0 for t in registry.Store.TABLES}
    return {"version": now["version"], "space": now["space"], **counts}


def clear_cache(store: registry.Store) -> int:
    """Drops all cached answers; how many there were."""
    held = store.read("answer_cache")
    n = held.count() if held is not None else 0
    if n:
        store.commit({"answer_cache": held.limit(0)})
    return n
