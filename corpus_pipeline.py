"""From raw documents to token ids: five stages, each a DataFrame-to-DataFrame step.

Every stage gets what its predecessor kept, written as Parquet and read again, so that a lost
executor never reaches back beyond one stage. All but the last return the columns of ``documents``.
``run`` removes a stage's table once the next one is written.

Defined results: null, empty and word-poor texts fail the quality rules and are out. Rows are told
apart by where they lie, never by id, so rows of one id, or of none, stay or go by their own text;
of equal texts the row of the largest id stays, then of each near-copy group that of the smallest,
null ids giving way to others. Documents the mix takes several times come as several equal rows.
Further columns pass through untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusward.llm import exact, mixing, pieces, quality, simhash
from corpusward.session import cut, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go."""
    return quality.keep_passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per row, with digests of the ids and of the text they decode to."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# XXH64 fingerprints and BPE have no SQL twin; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        done, docs = docs, cut(stage(spark, docs, sf_dir))
        release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
