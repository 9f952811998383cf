import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answer_cache, evaluation, registry, usage
from lodestone.plans.config import EngineConfig
from lodestone.plans.service import UNSUPPORTED, Engine, Options, follow_ups
from lodestone.sources import elements
from lodestone.streaming import events


def test_collection_names():
    assert registry.collection_name(" My Base ") == "my-base"
    for bad in ("", "-a", "a/b", "x" * 51, "ä"):
        with pytest.raises(ValueError):
            registry.collection_name(bad)


def test_config_bounds():
    assert EngineConfig().small_section == 150
    for bad in ({"child_overlap": 300}, {"parent_tokens": 10}, {"rerank_threshold": 2.0}, {"embedding_dim": 64}, {"top_k": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_store_versions(spark, tmp_path):
    s = registry.Store(spark, str(tmp_path), "Base")
    docs = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, text string")
    assert s.manifest()["version"] == 0 and s.read("documents") is None
    assert s.commit({"documents": docs, "chunks": docs}, ("m", 4)) == 1
    old = s.read("documents")
    new = registry.upsert(old, spark.createDataFrame([("d2", "B"), ("d3", "c")], "doc_id string, text string"), ["doc_id"])
    assert s.commit({"documents": new}) == 2
    assert sorted(map(tuple, s.read("documents").collect())) == [("d1", "a"), ("d2", "B"), ("d3", "c")]
    assert sorted(map(tuple, old.collect())) == [("d1", "a"), ("d2", "b")]  # readers of a version keep it
    with pytest.raises(ValueError):
        s.commit({"chunks": docs}, ("m", 8))
    s.delete_document("d2")
    assert {r.doc_id for r in s.read("documents").collect()} == {"d1", "d3"} and {r.doc_id for r in s.read("chunks").collect()} == {"d1"}
    assert registry.Store(spark, str(tmp_path), "other").manifest()["version"] == 0


def test_registry_relations(spark):
    old = spark.createDataFrame([("a", "1", "text"), ("b", "2", "text"), ("u", "3", "url")], "doc_id string, content_hash string, source_type string")
    scan = spark.createDataFrame([("a", "1"), ("c", "9")], "doc_id string, content_hash string")
    assert {r.doc_id for r in registry.missing(old, scan, ["doc_id"]).collect()} == {"b"}
    assert {(r.doc_id, r.status) for r in registry.difference(old, scan).collect()} == {("a", "unchanged"), ("b", "deleted"), ("c", "new"), ("u", "deleted")}
    ids = spark.createDataFrame([(0, "u"), (1, "zz"), (2, "a")], "pos int, doc_id string")
    assert [r.doc_id for r in registry.in_order(ids, old, "doc_id").collect()] == ["u", "a"]
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    assert registry.validate(vectors.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        registry.validate(vectors, 2).collect()


def entry(i, question, vector, version=1, day=1):
    return (i, "kb", version, "f", question, vector, dt.datetime(2026, 1, day), None, 0)


CACHE = "id long, collection string, kb_version long, fingerprint string, question string, embedding array<double>, created_at timestamp, last_hit_at timestamp, hits long"


def test_cache(spark):
    cache = spark.createDataFrame([entry(1, "revenue in Q1?", [1.0, 0.0]), entry(2, "revenue?", [0.8, 0.6]), entry(3, "revenue in Q1?", [1.0, 0.0, 0.0]), entry(4, "old", [1.0, 0.0], version=0)], CACHE)

    def look(question, vector, version=1):
        q = spark.createDataFrame([("r", "kb", version, "f", question, vector)], "request_id string, collection string, kb_version long, fingerprint string, question string, embedding array<double>")
        return tuple(answer_cache.lookup(q, cache).first())

    assert look("Revenue of Q1", [1.0, 0.0]) == ("r", 1, 1.0, 3, False)
    assert look("Revenue of Q2", [1.0, 0.0]) == ("r", None, 1.0, 3, True)
    assert look("Revenue of Q1", [0.6, 0.8]) == ("r", None, 0.96, 3, True)  # near the second entry, whose terms differ
    assert look("Revenue of Q1", [1.0, 0.0], version=7) == ("r", None, 0.0, 0, False)


def test_cache_eviction(spark):
    cache = spark.createDataFrame([entry(i, "q", [1.0], day=i) for i in (1, 2, 3)], CACHE)
    hit = spark.createDataFrame([("r", 1)], "request_id string, hit_id long")
    touched = answer_cache.touch(cache, hit, F.lit(dt.datetime(2026, 2, 1)))
    after = answer_cache.put(touched, spark.createDataFrame([entry(4, "q", [1.0], day=4)], CACHE), 3)
    assert {r.id for r in after.collect()} == {1, 3, 4}
    fresh = answer_cache.put(after, spark.createDataFrame([entry(5, "q", [1.0], version=2)], CACHE))
    assert {r.id for r in fresh.collect()} == {5}
    d = spark.createDataFrame([("doc_qa", False, 1, None), ("doc_qa", False, 1, False), ("chitchat", False, 1, True), ("doc_qa", True, 1, True), ("doc_qa", False, 0, True)], "r string, x boolean, c int, g boolean")
    assert [r[0] for r in d.select(answer_cache.cacheable("r", "x", "c", "g")).collect()] == [True, False, False, False, False]


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abc")] + [("r", "x", 1)], "query_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "c"), ("r", "y"), ("s", "z")], "query_id string, chunk_id string")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.rank_metrics(ranked, gold, 5).collect()}
    assert got["q"] == (1.0, 1.0, pytest.approx((1 + 2 / 3) / 2)) and got["r"] == got["s"] == (0.0, 0.0, 0.0)


def test_percentile_and_throttling(spark):
    df = spark.createDataFrame([(float(x),) for x in (100, 200, 300, 400)], "latency_ms double")
    assert df.agg(evaluation.quantile("latency_ms", 95)).first()[0] == pytest.approx(385)
    schema = "config string, answerable boolean, refused boolean, hit double, reciprocal_rank double, context_precision double, context_recall double, faithfulness double, answer_relevance double, latency_ms double, cost_usd double, retries int, fallbacks int, error string"
    row = lambda ms, retries: ("c", True, False, 1.0, 1.0, None, None, None, None, ms, 0.0, retries, 0, None)
    got = evaluation.summarize(spark.createDataFrame([row(1000.0, 0), row(2000.0, 0), row(60000.0, 3)], schema)).first()
    assert (got.clean_p50, got.p95, got.throttled, got.faithfulness) == (1500.0, 54200.0, 1, None)


def test_resume(spark):
    items, configs = spark.createDataFrame([("i1",), ("i2",)], "item_id string"), spark.createDataFrame([("a",), ("b",)], "config string")
    done = spark.createDataFrame([("a", "i1", 1, None, None), ("a", "i2", 2, None, None), ("a", "i2", 3, "quota", None), ("b", "i1", 4, None, "judge")], "config string, item_id string, line_no int, error string, judge_error string")
    assert {tuple(r) for r in evaluation.unfinished(items, configs, done).select("config", "item_id").collect()} == {("a", "i2"), ("b", "i1"), ("b", "i2")}


def test_cost(spark):
    u = spark.createDataFrame([("m", 1_000_000, 100_000, 100_000), ("unknown", 5, 5, None)], "model string, prompt_tokens long, output_tokens long, thoughts_tokens long")
    prices = spark.createDataFrame([("m", 0.3, 2.5)], "model string, input_per_m double, output_per_m double")
    assert {r.model: r.cost_usd for r in usage.with_cost(u, prices).collect()} == {"m": pytest.approx(0.8), "unknown": 0.0}


def test_limits(spark):
    rng = random.Random(2)
    rows = [(u, i, rng.uniform(0, 300), rng.choice([1, 1, 2])) for i, u in enumerate(rng.choices([1, 2, 3], k=200))]
    requests = spark.createDataFrame(rows, "user_id long, event_id long, at double, cost int")
    live, want = {}, {}
    for u, i, at, cost in sorted(rows, key=lambda r: r[2]):
        now = [t for t in live.get(u, []) if t > at - 60]
        want[i] = len(now) + cost <= 5
        live[u] = now + [at] * cost * want[i]
    assert {r.event_id: r.allowed for r in usage.decide(requests, 5, 60.0).collect()} == want
    w = usage.Window(2, 60)
    assert [w.ask(0), w.ask(10), w.ask(20), w.ask(60)] == [(True, 0.0), (True, 50.0), (False, 40.0), (True, 10.0)]


def test_stateful_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted([(rng.choice([1, 2]), i, float(i * 7 % 400), 1) for i in range(120)], key=lambda r: r[2])
    for n, part in enumerate((rows[:60], rows[60:])):
        spark.createDataFrame(part, "user_id long, event_id long, at double, cost int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, at double, cost int").parquet(str(tmp_path / "in"))
    got = events.drained(events.limited(stream, 4, 60.0), "limited_test", "append")
    batch = usage.decide(spark.createDataFrame(rows, "user_id long, event_id long, at double, cost int"), 4, 60.0)
    assert {(r.event_id, r.allowed) for r in got.collect()} == {(r.event_id, r.allowed) for r in batch.collect()}


def test_streams_into_written_tables(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    got = QUERIES["stream_session"](spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and got.count() > 900 and not spark.catalog.tableExists("lodestone_sessions")  # no table in the driver's memory
    rows = [(u, u // 3, 100.0 * (u % 3), 1) for u in range(12)]
    for half in (rows[:7], rows[7:]):
        spark.createDataFrame(half, "event_id long, user_id long, at double, cost int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda path: spark.readStream.schema("event_id long, user_id long, at double, cost int").option("maxFilesPerTrigger", 1).parquet(str(path))
    counts = events.stored(read(tmp_path / "in").groupBy("user_id").agg(F.count("*").alias("n"))).collect()
    assert sorted((r.user_id, r.n) for r in counts) == [(0, 3), (1, 3), (2, 3), (3, 3)]
    assert sorted(r.event_id for r in events.stored(read(tmp_path / "in").select("event_id"), "append").collect()) == list(range(12))
    (tmp_path / "none").mkdir()
    none = events.stored(read(tmp_path / "none").groupBy("user_id").agg(F.count("*").alias("n")))
    assert none.columns == ["user_id", "n"] and none.count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None


def test_stream_upserts_a_store(spark, tmp_path):
    s = registry.Store(spark, str(tmp_path / "kb"), "base")
    put = events.upserting(s, "documents", ["doc_id"])
    put(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), 0)
    put(spark.createDataFrame([("b", 2)], "doc_id string, v int"), 1)
    assert sorted(map(tuple, s.read("documents").collect())) == [("a", 1), ("b", 2)] and s.manifest()["version"] == 2


DOCS = [("guide", "# Drone guide\n\n## Battery\n\nThe X1 battery takes 90 minutes to charge fully.\n\n## Propellers\n\nPropellers are made of carbon fibre."), ("policy", "# Leave policy\n\n## Sick leave\n\nSick leave lasts up to twelve days a year.")]


@pytest.fixture(scope="module")
def engine(spark):
    d = spark.createDataFrame(DOCS, "doc_id string, md string").withColumn("p", elements.markdown_elements("md"))
    return Engine.build(d.select("doc_id", F.lit("t").alias("title"), F.col("p.elements").alias("elements")))


def test_ask(spark, engine):
    q = spark.createDataFrame([("1", "How long does the X1 battery take to charge?"), ("2", "hello!"), ("3", "zebra quantum volcano"), ("4", "How many days of sick leave?")], "request_id string, text string")
    got = {r.request_id: r for r in engine.ask(q).collect()}
    assert "90 minutes" in got["1"].answer and got["1"].grounded and [c["index"] for c in got["1"].citations] and not got["1"].refused
    assert got["2"].route == "chitchat" and got["2"].citations == []
    assert got["3"].refused and got["3"].citations == []
    assert "twelve days" in got["4"].answer
    assert engine.ask(q.limit(0)).collect() == []


def test_routes_without_documents(spark, engine):
    q = spark.createDataFrame([("1", "what is it about?"), ("2", "summarize everything please"), ("3", "thanks!")], "request_id string, text string")
    got = {r.request_id: r for r in engine.ask(q).collect()}
    assert got["1"].route == "out_of_scope" and got["1"].refused and "2 documents" in got["1"].answer
    assert got["2"].answer == "Which document should I summarize?" and not got["2"].refused
    assert got["3"].route == "chitchat"


def test_two_documents_are_compared_unnamed(spark, engine):
    got = engine.ask(spark.createDataFrame([("1", "Compare the sick leave and the battery")], "request_id string, text string")).first()
    assert got.route == "compare_documents" and "twelve days" in got.answer and "90 minutes" in got.answer and len({c["parent_id"] for c in got.citations}) == 2


def test_long_documents_are_summarized_in_batches(spark):
    d = spark.createDataFrame([("long", "\n\n".join(f"## Part {i}\n\nFact number {i} stands here. " + "More words follow it. " * 30 for i in range(12)))], "doc_id string, md string").withColumn("p", elements.markdown_elements("md"))
    small = EngineConfig(embedding_dim=128, parent_tokens=256, summary_tokens=400, summary_batch_tokens=400)
    e = Engine.build(d.select("doc_id", F.lit("Long book").alias("title"), F.col("p.elements").alias("elements")), small)
    got = e.ask(spark.createDataFrame([("1", "Give me a summary of the long book"), ("2", "fact number 7")], "request_id string, text string"), Options(mode="summarize_document")).collect()
    for r in got:
        assert r.route == "summarize_document" and r.grounded is None and all(f"Fact number {i} " in r.answer or f"Part {i}" in r.answer for i in (0, 11)) and "\n" in r.answer


def test_cached_answers_come_back(spark, engine):
    scope = "'kb' AS collection, 1L AS kb_version, 'f' AS fingerprint"
    q = spark.createDataFrame([("1", "How long does the X1 battery take to charge?"), ("2", "How many days of sick leave?")], "request_id string, text string").selectExpr("*", *scope.split(", "))
    cache = spark.createDataFrame([(7, "How long does the X1 battery take to charge?")], "id long, question string").selectExpr("*", *scope.split(", "))
    cache = cache.withColumn("embedding", engine.embedder.queries(F.col("question"))).selectExpr("*", "'from before [1]' AS answer", "true AS grounded", "array(named_struct('index', 1, 'parent_id', 'p')) AS citations")
    got = {r.request_id: r for r in engine.ask(q, cache=cache).collect()}
    assert got["1"].cached and got["1"].answer == "from before [1]" and got["1"].citations[0]["parent_id"] == "p"
    assert not got["2"].cached and "twelve days" in got["2"].answer


def test_query_plans(spark, engine):
    q = spark.createDataFrame([("1", "and how?", "User: How long does charging take\nAssistant: Ninety."), ("2", "How long does charging take?", None)], "request_id string, text string, history string")
    got = sorted(map(tuple, engine.query_plan(q, variants=True, hyde=True).collect()))
    assert got[0] == ("1", 0, "standalone", "How long does charging take and how?")
    assert ("2", 0, "original", "How long does charging take?") in got
    assert [r[2] for r in got if r[0] == "2"] == ["original", "variant", "variant"] and "hyde" not in {r[2] for r in got}


class Doubtful:
    """Writes what no passage says, and the second time what one does (or not)."""

    def __init__(self, second):
        from lodestone.plans.providers import Extracts

        self.inner, self.second = Extracts(), second

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def answer(self, question, passages):
        return F.lit("The moon is made of tin [1].")

    def again(self, question, passages, answer):
        return F.lit(self.second)


def test_unsupported_answers_are_written_again_then_refused(spark, engine):
    from dataclasses import replace

    q = spark.createDataFrame([("1", "How long does the X1 battery take to charge?")], "request_id string, text string")
    good = replace(engine, writer=Doubtful("The X1 battery takes 90 minutes to charge fully. [1]")).ask(q).first()
    assert good.answer.startswith("The X1 battery") and good.grounded and not good.refused
    bad = replace(engine, writer=Doubtful("The sun is made of tin [1].")).ask(q).first()
    assert bad.refused and bad.grounded is False and bad.citations == [] and bad.answer == UNSUPPORTED
    assert replace(engine, writer=Doubtful("x")).ask(q, Options(self_correct=False)).first().answer == "The moon is made of tin [1]."


def test_scope(spark, engine):
    q = spark.createDataFrame([("1", "sick leave days")], "request_id string, text string")
    only = {r.request_id: r for r in engine.ask(q, Options(doc_ids=("guide",), self_correct=False)).collect()}
    assert "twelve" not in only["1"].answer
    assert engine.ask(q, Options(doc_ids=(), self_correct=False)).first().refused


def test_follow_ups(spark):
    s = spark.createDataFrame([("r", 1, " What  now? "), ("r", 2, "what now"), ("r", 3, "x" * 130), ("r", 4, "And then"), ("r", 5, "Third?"), ("r", 6, "Fourth?")], "request_id string, pos int, text string")
    assert follow_ups(s).first().questions == ["What now?", "And then?", "Third?"]


def test_the_first_ready_reranker_scores(spark, engine):
    from dataclasses import replace

    from lodestone.plans.providers import FirstReady, TermCoverage

    class Broken(TermCoverage):
        tried = 0

        def warm_up(self):
            Broken.tried += 1
            raise OSError("no model")

    q = engine.query_plan(spark.createDataFrame([("1", "How long does the X1 battery take to charge?")], "request_id string, text string"))
    second = replace(engine, reranker=FirstReady(Broken(), TermCoverage()))
    assert second.retrieve(q).orderBy("rank").first().rerank_score > 0 and second.retrieve(q).count() and Broken.tried == 1
    none = replace(engine, reranker=FirstReady(Broken()))
    kept = [r.chunk_id for r in none.retrieve(q).orderBy("rank").collect()]
    assert kept == [r.chunk_id for r in engine.retrieve(q, Options(rerank=False)).orderBy("rank").collect()] and kept
    with pytest.raises(RuntimeError):
        FirstReady().score(F.lit("a"), F.lit("b"))


def test_usage_as_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, h, m), f"m{h % 2}", 10 * m, m, 0.5) for h in range(4) for m in (0, 10, 50)]
    spark.createDataFrame(rows, "ts timestamp, model string, prompt_tokens long, output_tokens long, cost_usd double").write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "calls")).schema).parquet(str(tmp_path / "calls"))
    got = events.drained(events.usage(stream), "usage_stream").collect()
    assert sorted((r.start.hour, r.model, r.calls, r.prompt_tokens, r.output_tokens, r.cost_usd) for r in got) == [(h, f"m{h % 2}", 3, 600, 60, 1.5) for h in range(4)]
