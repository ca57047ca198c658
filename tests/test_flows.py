from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusward import hooks
from corpusward.operators import cache, search, weights
from corpusward.plans import answer, ingest
from corpusward.session import cut
from corpusward.sources import readers, sinks
from corpusward.streaming import jobs


@pytest.fixture()
def corpus(tmp_path):
    """Files in the folder layout the engine reads, with leftovers to skip."""
    files = {
        "confluence/deep/policy.md": "# Leave\n\n## Restricted\n> **Allowed Groups:** HR\nMail a@b.org\n",
        "confluence/temp_policy.md": "# skipped\n",
        "slack/export.json": json.dumps([
            {"user": "U2", "text": "tracking 4.8M", "ts": "1690890060.000200"},
            {"user": "U1", "text": "Q3 target?", "ts": "1690890000.000100"},
            {"text": "late", "ts": None}, {"user": "U3", "ts": "1690899999"}, {"user": "bad", "ts": "soon"},
        ]),
        "slack/object.json": json.dumps({"no": "list"}),
        "excel/salary_bands.csv": "Role,Band\nEngineer,L1\nManager,M1\n",
        "other/notes.md": "ignored",
    }
    for name, body in files.items():
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return tmp_path / "data"


def test_folder_scan(spark, corpus):
    got = readers.corpus_files(spark, str(corpus)).select("filename", "source_type").collect()
    assert sorted(map(tuple, got)) == [
        ("export.json", "slack"), ("object.json", "slack"), ("policy.md", "confluence"), ("salary_bands.csv", "excel")]


def test_ingest_chain(spark, corpus):
    docs = readers.read_markdown(spark, str(corpus / "confluence/deep"))
    good, bad = readers.read_messages(spark, [str(corpus / "slack/export.json"), str(corpus / "slack/object.json")])
    chat = good.select("filename", "user", "text", "ts", "pos")
    table = readers.read_table_rows(spark, str(corpus / "excel"), "Role STRING, Band STRING")
    pages = spark.createDataFrame([("a.pdf", 0, " "), ("a.pdf", 1, "page")], "filename string, chunk_index int, text string")
    chunks = ingest.union_sources(
        ingest.from_markdown(docs), ingest.from_messages(chat), ingest.from_tables(table, F.col("split")), ingest.from_pages(pages))
    got = {(r["source_type"], r["chunk_index"]): (r["text"], r["allowed_groups"]) for r in chunks.collect()}
    assert got == {
        ("confluence", 0): ("# Leave", ["Public"]),
        ("confluence", 1): ("## Restricted\n> **Allowed Groups:** HR\nMail <EMAIL_ADDRESS>", ["HR"]),
        ("slack", 0): ("[Slack Conversation 0]\nUser U1: Q3 target?\nUser U2: tracking 4.8M", ["Public"]),
        ("slack", 1): ("[Slack Conversation 1]\nUser U3: ", ["Public"]),
        ("excel", 0): ("Table: salary_bands.csv - Chunk 0\n\nRole Band\nEngineer L1\nManager M1", ["HR", "Management", "Finance"]),
        ("pdf", 1): ("Document: a.pdf - Part 2\n\npage", ["Public"]),
    }
    assert sorted(str(r["ts"]) for r in bad.collect()) == ["None", "soon"]


def test_broken_and_nested_files(spark, tmp_path):
    """A root name that comes back below the root, and message files that are no JSON."""
    root = tmp_path / "corpus (a+b)"
    for name, body in {
        "confluence/corpus (a+b)/x.md": "x", "misc/slack/y.json": "[]", "slack/bad.json": '[{"user": ',
        "slack/one.json": '{"user": "U"}', "slack/fine.json": '[{"user": "U", "text": "t", "ts": 5}]',
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    found = readers.corpus_files(spark, str(root)).collect()
    assert sorted((r.filename, r.source_type) for r in found) == [
        ("bad.json", "slack"), ("fine.json", "slack"), ("one.json", "slack"), ("x.md", "confluence")]
    lines = readers.corpus_lines(spark, str(root)).collect()
    assert {r.filename for r in lines} == {"bad.json", "fine.json", "one.json", "x.md"}
    good, bad = readers.read_messages(spark, str(root / "slack"))
    assert [(r.filename, r.pos, r.user, r.text) for r in good.collect()] == [("fine.json", 0, "U", "t")]
    assert [(r.filename, r.text) for r in bad.collect()] == [("bad.json", '[{"user": ')]


def test_moved_and_repeated_keys(spark, tmp_path):
    schema = "chunk_key long, source_type string, body string"
    path = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "md", "a"), (2, "md", "b"), (3, "pdf", "c")], schema)
    sinks.write_chunk_index(spark, first, path, ["chunk_key"], exists=False)
    moved = spark.createDataFrame([(1, "pdf", "a2"), (4, "chat", "d"), (4, "chat", "d")], schema)
    sinks.write_chunk_index(spark, moved, path, ["chunk_key"])
    sinks.write_chunk_index(spark, spark.createDataFrame([(2, "pdf", "b2")], schema), path, ["chunk_key"])
    got = spark.read.parquet(path).select("chunk_key", "source_type", "body").collect()
    assert sorted(map(tuple, got)) == [(1, "pdf", "a2"), (2, "pdf", "b2"), (3, "pdf", "c"), (4, "chat", "d")]


def test_names_of_several_words(spark):
    docs = spark.createDataFrame([(1, "John Smith met José, Johnson and John."), (2, None)], "id long, text string")
    names = spark.createDataFrame([("John Smith",), ("José",), ("John",)], "name string")
    got = {r.id: r.text for r in ingest.redacted_names(docs, names, "id").collect()}
    assert got == {1: "<PERSON> met <PERSON>, Johnson and <PERSON>.", 2: None}


def test_long_threads_stay_whole(spark):
    from corpusward.operators import chunking

    rows = spark.range(10_001).selectExpr("'c' AS channel", "timestamp_seconds(id) AS ts", "id AS pos", "'u' AS user", "'x' AS text")
    chunks = chunking.thread_chunks(chunking.sessionize(rows)).collect()
    assert [(r.chunk_index, r.part, r.n_messages) for r in chunks] == [(0, 0, 10_001)]


def test_unchanged_text_of_a_new_version_stays(spark):
    words = " ".join(f"w{i}" for i in range(20))
    schema = "chunk_key long, source_type string, filename string, text string"
    active = spark.createDataFrame([(1, "md", "a", words), (2, "md", "b", words + " b")], schema)
    arrived = spark.createDataFrame([(10, "md", "a", words), (11, "md", "c", "else")], schema)
    # against b.md the text is a duplicate, against its own old version it is not
    kept = ingest.new_chunks(arrived, active.filter("filename = 'a'"))
    assert sorted(r[0] for r in kept.select("chunk_key").collect()) == [10, 11]
    assert [r[0] for r in ingest.new_chunks(arrived, active).select("chunk_key").collect()] == [11]


def test_name_list(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob"), (2, "nobody")], "id long, text string")
    names = spark.createDataFrame([("Ann",), ("Bob",)], "name string")
    got = ingest.redacted_names(docs, names, "id").orderBy("id").collect()
    assert [r["text"] for r in got] == ["<PERSON> met <PERSON>", "nobody"]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, "md", "x"), (2, "md", "y"), (3, "pdf", "z")], "chunk_key long, source_type string, text string")
    sinks.write_chunk_index(spark, rows, path, ["chunk_key"], exists=False)
    before = {f.name for f in (tmp_path / "index/source_type=pdf").iterdir()}
    update = spark.createDataFrame([(2, "md", "new"), (4, "md", "w")], rows.schema)
    sinks.write_chunk_index(spark, update, path, ["chunk_key"])
    assert {f.name for f in (tmp_path / "index/source_type=pdf").iterdir()} == before
    got = spark.read.parquet(path).select("chunk_key", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, "new"), (3, "z"), (4, "w")]


def test_upsert_rewrites_one_shard(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(400).selectExpr("id AS chunk_key", "'md' AS source_type", "'old' AS text", "0 AS version")
    sinks.write_chunk_index(spark, rows, path, ["chunk_key"], exists=False, shards=8)
    files = lambda: {f.relative_to(tmp_path) for f in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    update = spark.createDataFrame(
        [(7, "md", "a", 1), (7, "md", "c", 2), (7, "md", "b", 2)], "chunk_key long, source_type string, text string, version int")
    sinks.write_chunk_index(spark, update, path, ["chunk_key"], order=("version",))
    changed = {f.parent for f in before ^ files()}
    assert len(changed) == 1 and len({f.parent for f in before}) == 8
    table = sinks.read_chunk_index(spark, path)
    assert table.columns == ["chunk_key", "text", "version", "source_type"]
    assert table.count() == table.select("chunk_key").distinct().count() == 400
    # the last by version, of equal versions the one with the greater contents
    assert [tuple(r) for r in table.filter("text <> 'old'").collect()] == [(7, "c", 2, "md")]


def test_rows_of_a_file_in_many_splits(spark, tmp_path):
    lines = [f"{i},{'x' * (i * 37 % 90)}" for i in range(3000)]
    (tmp_path / "big.csv").write_text("id,word\n" + "\n".join(lines[:1500]) + "\n\n" + "\n".join(lines[1500:]) + "\n")
    (tmp_path / "small.csv").write_text("id,word\n1,a\n2,b\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = cut(readers.read_table_rows(spark, str(tmp_path), "id STRING, word STRING"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = rows.filter("filename = 'big.csv'")
    assert big.select("split").distinct().count() > 10
    assert [r.row_text for r in big.orderBy("row_no").collect()] == [line.replace(",", " ") for line in lines]
    chunks = ingest.from_tables(rows, F.col("split"), budget=5000).filter("filename = 'big.csv'").orderBy("chunk_index").collect()
    told = [line for c in chunks for line in c.text.split("\n")[2:] if line != "id word"]
    assert len(chunks) > 10 and [line.split(" ")[0] for line in told] == [str(i) for i in range(3000)]


def test_question_flow(spark, tmp_path):
    chunks = spark.createDataFrame([
        (1, "policy.md", "confluence", ["Public"], "annual leave is twenty days"),
        (2, "bands.csv", "excel", ["HR"], "salary bands L3 L4"),
        (3, "misc.md", "confluence", ["Public"], "salary is paid monthly"),
    ], "chunk_key long, filename string, source_type string, allowed_groups array<string>, text string")
    people = spark.createDataFrame([(7, "ann", ["Eng"]), (8, "hr", ["HR"])], "user_id long, username string, groups array<string>")
    now = datetime(2024, 1, 1)
    questions = spark.createDataFrame(
        [(1, "ann", "salary bands", now), (2, "hr", "salary bands", now), (3, "ghost", "annual leave", now), (4, "ann", "", now), (5, "ann", "zzz", now)],
        "query_id long, username string, query string, ts timestamp")
    vocab = cut(weights.vocabulary(chunks))
    index = weights.encode(chunks, vocab, 16).join(chunks.select("chunk_key", "allowed_groups"), "chunk_key")
    encoded = weights.encode(questions, vocab, 16, "query_id", "query")
    entry = encoded.filter("query_id = 3").select(
        F.lit(1).cast("long").alias("entry_id"), F.lit("cached text").alias("response_text"),
        F.array(F.lit("Public")).alias("allowed_groups"), F.array(F.array(F.lit("Public"))).alias("chunk_groups"), "dense")
    generated = spark.createDataFrame(
        [(1, "Paid monthly [Source: misc.md] [Source: bands.csv]"), (2, "L3 [Source: bands.csv]")], "query_id long, answer string")
    out = answer.answer(questions, people, entry, index, chunks, encoded, generated)
    seen = {(r["query_id"], r["chunk_key"]) for r in out["retrieved"].collect()}
    assert (1, 2) not in seen and (2, 2) in seen
    answers = {r["query_id"]: (r["response"], r["citations"]) for r in out["answers"].collect()}
    assert answers[1] == ("Paid monthly [Source: misc.md]", ["misc.md"])
    assert answers[2] == ("L3 [Source: bands.csv]", ["bands.csv"])
    assert answers[5][0].startswith("I could not find") and 4 not in answers and 3 not in answers
    audit = {(r["query"], r["user_id"]): r for r in out["audit"].collect()}
    assert audit[("annual leave", None)]["served_from"] == "cache"
    assert audit[("annual leave", None)]["retrieved_chunks"] is None
    assert audit[("salary bands", 8)]["retrieved_chunks"][0]["chunk_id"] == 2
    # what was answered is found in the cache by whoever may see all of it, until it is too old
    path = str(tmp_path / "cache")
    cache.write_entries(out["entries"], path, 0)
    cache.write_entries(out["entries"].limit(0), path, 1)
    entries = cache.read_entries(spark, path, now + timedelta(seconds=3599))
    assert entries.count() == 2 and cache.read_entries(spark, path, now + timedelta(seconds=3600)).isEmpty()
    again = answer.answer(questions, people, entries, index, chunks, encoded, generated)
    found = {r["query_id"]: r["response_text"] for r in again["hits"].collect()}
    assert found[2] == "L3 [Source: bands.csv]" and "L3" not in found.get(1, "")
    changed = spark.createDataFrame([("bands.csv",)], "filename string")
    assert [r.files for r in cache.invalidate(entries, changed).collect()] == [["misc.md", "policy.md"]]


def test_hooks_run_models(spark):
    def load_encoder():
        return lambda texts: pd.DataFrame({"dense": [[float(len(x))] for x in texts], "tokens": [[1]] * len(texts), "weights": [[2.0]] * len(texts)})

    got = spark.createDataFrame([("abc",)], "t string").select(hooks.embed(load_encoder)("t").alias("e")).first()["e"]
    assert (got["dense"], got["tokens"], got["weights"]) == ([3.0], [1], [2.0])
    pool = spark.createDataFrame([(1, 5, "q", "aa", 1), (1, 6, "q", "aaa", 2)], "query_id long, chunk_key long, query string, text string, fused_rank int")
    scorer = hooks.reranker(lambda: lambda q, x: x.str.len().astype(float))
    assert [r["chunk_key"] for r in search.rerank(pool, 2, scorer).orderBy("rank").collect()] == [6, 5]


def test_stream_dedup_remembers_and_repeats(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(30))
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    batch = lambda rows: spark.createDataFrame(rows, "chunk_key long, text string")
    jobs.dedup_batch(spark, batch([(1, base), (2, base + " x"), (3, "other")]), 0, state, out)
    second = batch([(4, base + " y"), (5, "fresh"), (6, "other")])
    for _ in range(2):  # a replayed batch gives the same result
        jobs.dedup_batch(spark, second, 1, state, out)
        assert sorted(r[0] for r in spark.read.parquet(out).select("chunk_key").collect()) == [1, 3, 5]


def test_stream_rate_report(spark, tmp_path):
    start = datetime(2024, 1, 1)
    calls = [("ann", start + timedelta(seconds=s)) for s in range(31)] + [("bob", start)] + [("bob", start + timedelta(minutes=9))]
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    df = spark.createDataFrame(calls, "caller string, ts timestamp")
    df.write.parquet(inbox)
    jobs.run_to_table(jobs.rate_report(jobs.table_stream(spark, inbox, df.schema), 30), out, offsets).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(start, "ann", 31)]


def test_stream_dedup_reads_only_the_shards_it_hits(spark, tmp_path):
    from corpusward.operators import dedup, fingerprints

    state = str(tmp_path / "state")
    texts = [(i, " ".join(f"w{i}_{j}" for j in range(30))) for i in range(300)]
    sets = lambda rows: dedup.word_sets(spark.createDataFrame(rows, "chunk_key long, text string"))
    fingerprints.remember(spark, sets(texts), state, 0)
    fresh = sets([(1000, texts[7][1] + " more"), (1001, texts[9][1]), (1002, "quite new"), (1003, texts[9][1])])
    earlier = F.col("batch_id") < 1
    got = fingerprints.matches(spark, fresh, state, earlier).collect()
    assert sorted((r.key, r.kept_key) for r in got) == [(1000, 7), (1001, 9), (1003, 9)]
    living = lambda known: known.filter("key <> 9")
    assert [r.key for r in fingerprints.matches(spark, fresh, state, earlier, alive=living).collect()] == [1000]
    order = fingerprints.word_order(spark, state, fresh)
    hit = fingerprints._shards_of(fingerprints.blocks(fresh, 0.9, order), "block")
    assert len(hit) < fingerprints.SHARDS // 2
    read = fingerprints._stored(spark, f"{state}/blocks", fingerprints.BLOCKS, earlier, hit)
    shards = {f.split("shard=")[1].split("/")[0] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert shards <= set(map(str, hit))
    assert "PartitionFilters" in read._jdf.queryExecution().toString() and "shard" in read._jdf.queryExecution().toString()
