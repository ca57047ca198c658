"""Folder to index in one job: commits, replays, versions, rejects."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from corpusward.functions import text
from corpusward.operators import dedup, fingerprints
from corpusward.plans import corpus
from corpusward.sources import readers

LONG = " ".join(f"word{i}" for i in range(40))


def put(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


FIRST = {
    "d1/confluence/deep/policy.md": f"# Leave\n{LONG}\n\n## Restricted\n> **Allowed Groups:** HR\nMail a@b.org\n",
    "d1/confluence/other.md": "# Other\nsomething else entirely\n",
    "d1/confluence/temp_x.md": "# skipped",
    "d1/slack/export.json": json.dumps([
        {"user": "U1", "text": "Q3 target?", "ts": "1690890000.0001"}, {"user": "U2", "text": "4.8M", "ts": "1690890060"},
        {"user": "bad", "text": "x", "ts": "soon"}]),
    "d1/slack/broken.json": '[{"user": ',
    "d1/excel/salary_bands.csv": 'Role,Band\nEngineer,"L1, L2"\n\nManager,M1\n',
    "d1/excel/raw.xlsx": "PK",
    "d1/pdfs/a.pdf.txt": "page one\f \fpage three",
    "d1/misc/ignored.md": "no",
}
SECOND = {
    # unchanged text in a new version stays; the same text in another document goes
    "d2/confluence/deep/policy.md": f"# Leave\n{LONG}\n\n## New\nfresh words\n",
    "d2/confluence/copy.md": f"# Leave\n{LONG} more\n",
    "d2/confluence/unlike.md": "# Other\nsomething else entirely\n",
}


def texts(store):
    return sorted((r.filename, r.version, r.chunk_index, r.text.split("\n")[0]) for r in store.active().collect())


def tables(store):
    out = {}
    for name in corpus.TABLES:
        rows = store.table(name)
        out[name] = sorted(map(str, rows.drop("ts", "created_at").collect()))
    return out


EXPECTED = [
    ("a.pdf.txt", 1, 0, "Document: a.pdf.txt - Part 1"), ("a.pdf.txt", 1, 2, "Document: a.pdf.txt - Part 3"),
    ("deep/policy.md", 2, 0, "# Leave"), ("deep/policy.md", 2, 1, "## New"),
    ("export.json", 1, 0, "[Slack Conversation 0]"), ("other.md", 1, 0, "# Other"),
    ("salary_bands.csv", 1, 0, "Table: salary_bands.csv - Chunk 0"),
]


def test_two_deliveries(spark, tmp_path):
    root = tmp_path / "in"
    put(root, FIRST)
    store = corpus.ingest_corpus(spark, str(root / "d1"), str(tmp_path / "store"), 0)
    assert {r.text.split("\n")[-1] for r in store.active().filter("source_type = 'excel'").collect()} == {"Manager M1"}
    table = store.active().filter("source_type = 'excel'").first()
    assert table.text.endswith("Role Band\nEngineer L1, L2\nManager M1") and "Finance" in table.allowed_groups
    assert sorted((r.filepath.rsplit("/", 1)[1], r.error_message) for r in store.table("rejects").collect()) == [
        ("broken.json", "not a JSON file"), ("export.json", "message without a time: 2"),
        ("raw.xlsx", "must be converted to text first")]
    put(root, SECOND)
    corpus.ingest_corpus(spark, str(root / "d2"), str(tmp_path / "store"), 1)
    # copy.md repeats what policy.md says; but policy.md is replaced in this batch, so of the two the
    # one with the smaller key stays
    left = [row for row in texts(store) if row[3] == "# Leave"]
    assert len(left) == 1 and left[0][0] in ("deep/policy.md", "copy.md")
    assert [r for r in texts(store) if r[3] != "# Leave"] == [e for e in EXPECTED if e[3] != "# Leave"]
    counts = {r.source_type: (r.files, r.extracted, r.stored, r.duplicates) for r in store.table("commits").filter("files = 3").collect()}
    assert counts == {"confluence": (3, 4, 2, 2)}
    versions = sorted((r.filename, r.version) for r in store.current().collect())
    assert ("deep/policy.md", 2) in versions and ("unlike.md", 1) in versions
    index = {r.chunk_key for r in store.active("index").collect()}
    assert index == {r.chunk_key for r in store.active().collect()}


@pytest.mark.parametrize("dies", ["before commit", "never"])
def test_a_killed_batch_is_replayed(spark, tmp_path, dies):
    root, store_root, offsets = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "offsets")
    put(root, FIRST)
    corpus.ingest_stream(readers.read_files(spark, str(root), streaming=True), store_root, offsets).awaitTermination()
    store = corpus.Store(spark, store_root)
    before = tables(store)
    time.sleep(1.1)
    put(root, SECOND)
    if dies != "never":
        def kill():
            raise RuntimeError("lost")

        dead = corpus.ingest_stream(
            readers.read_files(spark, str(root), streaming=True), store_root, offsets, before_commit=kill)
        with pytest.raises(Exception, match="lost"):
            dead.awaitTermination()
        assert tables(store) == before  # nothing of the half batch is seen
    corpus.ingest_stream(readers.read_files(spark, str(root), streaming=True), store_root, offsets).awaitTermination()
    assert store.committed() == [0, 1]
    after = tables(store)
    assert [r for r in texts(store) if r[3] != "# Leave"] == [e for e in EXPECTED if e[3] != "# Leave"]
    batch = store.spark.read.parquet(f"{store_root}/chunks").filter("batch_id = 1")
    assert batch.count() == batch.select("chunk_key").distinct().count() == 2
    # a batch that is there is not done again
    corpus.ingest_batch(store, readers.read_files(spark, str(root)), 1)
    assert tables(store) == after


def test_an_empty_delivery(spark, tmp_path):
    files = spark.createDataFrame([], "path STRING, value STRING, modified TIMESTAMP")
    store = corpus.Store(spark, str(tmp_path / "store"))
    corpus.ingest_batch(store, readers.landed(files), 0)
    corpus.ingest_batch(store, readers.landed(files), 1)
    assert store.committed() == [0, 1] and store.active().isEmpty()


def test_versions_within_one_batch(spark, tmp_path):
    rows = [("/a/confluence/x.md", "# one\nsame text here"), ("/b/confluence/x.md", "# one\nsame text here")]
    files = spark.createDataFrame(rows, "path STRING, value STRING").withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    store = corpus.Store(spark, str(tmp_path / "store"))
    corpus.ingest_batch(store, readers.landed(files), 0)
    assert [(r.version, r.text) for r in store.active().collect()] == [(2, "# one\nsame text here")]
    assert store.table("chunks").count() == 2


def _files(spark, rows):
    made = spark.createDataFrame(rows, "path STRING, value STRING, modified TIMESTAMP")
    return readers.landed(made.withColumn("modified", F.lit("2024-01-01").cast("timestamp")))


def test_a_batch_without_chunks_takes_few_jobs(spark, tmp_path):
    store = corpus.Store(spark, str(tmp_path / "store"))
    broken = _files(spark, [(f"/a/slack/{i}.json", '[{"user": ', None) for i in range(3)])
    for batch_id, files in enumerate((broken, broken.limit(0))):
        spark.sparkContext.setJobGroup(f"without chunks {batch_id}", "a batch that stores no chunk")
        corpus.ingest_batch(store, files, batch_id)
    jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"without chunks {i}")) for i in (0, 1)]
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] <= 25 and jobs[1] <= 10
    # the next batch is the first with fingerprints; the one after it meets them
    for batch_id, name in ((2, "x"), (3, "y")):
        corpus.ingest_batch(store, _files(spark, [(f"/a/confluence/{name}.md", f"# one\n{LONG}", None)]), batch_id)
    assert store.committed() == [0, 1, 2, 3]
    assert [r.filename for r in store.table("chunks").collect()] == ["x.md"]
    assert [r.n_chunks for r in store.table("documents").collect()] == [1, 1]
    assert store.table("rejects").count() == 3
    assert store.table("commits").agg(F.sum("files"), F.sum("extracted"), F.sum("stored")).first()[:] == (5, 2, 1)


def test_a_replay_without_chunks_leaves_none_of_the_first_run(spark, tmp_path):
    store = corpus.Store(spark, str(tmp_path / "store"))

    def kill():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        corpus.ingest_batch(
            store, _files(spark, [("/a/confluence/x.md", f"# one\n{LONG}", None)]), 0, before_commit=kill)
    corpus.ingest_batch(store, _files(spark, [("/a/confluence/x.md", None, None)]), 0)
    assert store.active().isEmpty() and store.active("index").isEmpty() and store.table("documents").isEmpty()
    assert [r.error_message for r in store.table("rejects").collect()] == ["cannot be read"]
    # what the first run remembered is no duplicate of a later file
    corpus.ingest_batch(store, _files(spark, [("/a/confluence/z.md", f"# one\n{LONG}", None)]), 1)
    assert [r.filename for r in store.active().collect()] == ["z.md"]


def test_the_index_holds_the_ids_of_a_chunks_words(spark, tmp_path):
    store = corpus.Store(spark, str(tmp_path / "store"))
    bodies = [f"# one\n{LONG}", "# zwei\nñandú 北京 \U0001f600 a\u00a0b a b\tb", "# drei"]
    corpus.ingest_batch(store, _files(spark, [(f"/a/confluence/{i}.md", b, None) for i, b in enumerate(bodies)]), 0)
    said = store.table("chunks").select("chunk_key", F.explode(text.word_set(F.col("text"))).alias("word"))
    want = {(r.chunk_key, r.token) for r in said.select("chunk_key", text.token_id(F.col("word")).alias("token")).collect()}
    rows = store.table("index").collect()
    assert {(r.chunk_key, token) for r in rows for token in r.tokens} == want and len(rows) == 3
    assert all(r.tokens == sorted(set(r.tokens)) for r in rows)


def test_a_load_writes_a_file_a_shard(spark, tmp_path):
    made = spark.range(2000, numPartitions=8).select(
        F.col("id").alias("chunk_key"), F.concat_ws(" ", F.lit("same"), F.col("id").cast("string")).alias("text"))
    sets, state = dedup.word_sets(made), tmp_path / "state"
    fingerprints.remember(spark, sets, str(state), 0)
    for name in ("sets", "blocks"):
        shards = list((state / name / "batch_id=0").glob("shard=*"))
        assert len(shards) > 32 and all(len(list(s.glob("part-*"))) == 1 for s in shards)
