"""Every stage, and the whole, against a brute-force twin."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from corpusward.llm import mixing, quality
from corpusward.session import cut
from tests.llm.helpers import docs, smallest_reachable
from tests.llm.test_quality import measures
from tests.llm.test_simhash import plain_fingerprint

SF = "/root/testdata/sf0.001"


def fails(text):
    m = dict(zip(quality.MEASURES, measures(text), strict=True))
    return any(eval(rule.fails, {}, m) for rule in quality.RULES)


def plain(rows):
    rows = [r for r in rows if not fails(r["text"])]
    last = {}
    for r in rows:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    rows = sorted((r for r in rows if r["doc_id"] == last[r["text"]]), key=lambda r: r["doc_id"])
    prints = [plain_fingerprint(r["text"]) for r in rows]
    roots = smallest_reachable(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    return [r for i, r in enumerate(rows) if roots[i] == i]


def test_run(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = plain([r.asDict() for r in table.collect()])
    frame = spark.createDataFrame([tuple(r.values()) for r in kept], table.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect() if r.copies}
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == copies
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in kept}
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in got)


def test_stages_take_anything(spark):
    text = "a clean little text of more than ten words that nobody would ever drop {}"
    rows = [
        (1, text.format("x")), (2, text.format("x")), (3, None), (None, text.format("y z")), (4, ""),
        # ids that stand for different texts: only the copy goes
        (2, "the second row of this id says something else, and at a length that passes all rules"),
        (5, "five five five five five five five five five five five five five five five five"),
    ]
    frame = docs(spark, rows, extra=True)
    now, left = frame, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, SF))
        assert now.columns == frame.columns
        left.append(sorted({str(r.doc_id) for r in now.collect()}))
    assert left == [["1", "2", "None"], ["2", "None"], ["2", "None"], ["2", "None"]]
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    texts = Counter(r.text for r in now.collect())
    assert len(texts) == 3 and last.count() == sum(texts.values())
    assert all(r.n_tokens == len(r.ids) > 0 for r in last.collect())


def test_stages_take_nothing(spark):
    now = docs(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, SF))
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).collect() == []
