"""Checks around answer synthesis: confidence gate, context text, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusward.functions.text import WS, regex_literal, squeeze, strip

# Refusal texts.
REFUSE_NOTHING_FOUND = (
    "I could not find any relevant information in the company documents "
    "that you are authorized to see."
)
REFUSE_LOW_CONFIDENCE = (
    "I don't have enough confident context to answer this question accurately."
)

GATE_THRESHOLD = -3.0
CITATION = rf"\[Source:{WS}*([^\]]+)\]"


def gate(n_chunks: Column, top_score: Column, threshold: float = GATE_THRESHOLD) -> Column:
    """Refusal text, or null when synthesis may go on. A missing score counts as 0."""
    low = F.coalesce(top_score, F.lit(0.0)) < threshold
    return F.when(F.coalesce(n_chunks, F.lit(0)) == 0, REFUSE_NOTHING_FOUND).when(
        low, REFUSE_LOW_CONFIDENCE
    )


def context_block(position: Column, filename: Column, text: Column) -> Column:
    return F.concat(
        F.lit("--- Document "), position.cast("string"), F.lit(" ---\nSource File: "), filename,
        F.lit("\nContent:\n"), text, F.lit("\n"),
    )


def prompt(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Context Chunks:\n"), context, F.lit("\n\nQuestion: "), question,
        F.lit("\n\nAnswer:"),
    )


def citations(answer: Column) -> Column:
    """All cited names, trimmed, repeats kept."""
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), strip)


def valid_citations(answer: Column, files: Column) -> Column:
    """Distinct cited names that were retrieved."""
    return F.array_intersect(citations(answer), files)


def invalid_citations(answer: Column, files: Column) -> Column:
    """Distinct cited names that were not retrieved."""
    return F.array_except(citations(answer), files)


def strip_invalid(answer: Column, files: Column) -> Column:
    """Remove citations of files that were not retrieved, then squeeze blanks.

    Blanks before the closing bracket do not save an invalid tag.
    """
    cleaned = F.aggregate(
        invalid_citations(answer, files),
        answer,
        lambda acc, name: F.regexp_replace(
            acc,
            F.concat(F.lit(rf"\[Source:{WS}*"), regex_literal(name), F.lit(rf"{WS}*\]")),
            F.lit(""),
        ),
    )
    return squeeze(cleaned)


def needs_review(answer: Column, files: Column, share: float = 0.5) -> Column:
    """More than ``share`` of all citations are invalid."""
    cited = citations(answer)
    bad = F.size(F.filter(cited, lambda name: ~F.array_contains(files, name)))
    return F.when(F.size(cited) > 0, bad / F.size(cited) > share).otherwise(F.lit(False))
