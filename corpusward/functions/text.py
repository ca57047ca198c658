"""Text functions: whitespace, sections, words, token ids, chunk headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusward.functions.times import micros

# The characters Python's str.split() and str.strip() treat as blank.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java character class; the Unicode property is the fast way to say it.
WS = r"[\x{1c}-\x{1f}\p{IsWhite_Space}]"

# Fixed value: token ids live in [0, 2**31 - 1).
TOKEN_SPACE = 2147483647


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it.

    Inside lambdas Spark would otherwise repeat the expression for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Trim Unicode blanks at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Every run of blanks becomes one space; ends trimmed."""
    return F.btrim(F.regexp_replace(text, WS + "+", " "))


def sections(text: Column) -> Column:
    """Markdown text cut before every heading; blank pieces dropped, order kept."""
    pieces = F.split(text, rf"(?=(?:\A|\n)#+{WS})")
    return F.filter(F.transform(pieces, strip), lambda piece: piece != "")


def words(text: Column) -> Column:
    """All blank-separated words, repeats kept."""
    return F.filter(F.split(text, WS + "+"), lambda word: word != "")


def word_set(text: Column) -> Column:
    """Distinct words, case kept."""
    return F.array_distinct(words(text))


def token_id(word: Column) -> Column:
    """``int(sha256(word)) % (2**31 - 1)``.

    2**32 leaves remainder 2, so word ``i`` of the eight 32-bit words counts ``2**(7 - i)``;
    the sum of all eight stays far below 2**63.
    """
    digest = F.sha2(word, 256)
    total = F.lit(0).cast("bigint")
    for i in range(8):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        total = total + part * F.lit(1 << (7 - i)).cast("bigint")
    return (total % F.lit(TOKEN_SPACE).cast("bigint")).cast("int")


def regex_literal(text: Column) -> Column:
    """``text`` quoted so that a Java regular expression matches it literally."""
    inner = F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"\Q"), inner, F.lit(r"\E"))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def chat_header(text: Column, index: Column) -> Column:
    return F.concat(F.lit("[Slack Conversation "), index.cast("string"), F.lit("]\n"), text)


def table_header(text: Column, filename: Column, index: Column) -> Column:
    return F.concat(
        F.lit("Table: "), filename, F.lit(" - Chunk "), index.cast("string"), F.lit("\n\n"), text
    )


def page_header(text: Column, filename: Column, index: Column) -> Column:
    return F.concat(
        F.lit("Document: "), filename, F.lit(" - Part "), (index + 1).cast("string"),
        F.lit("\n\n"), text,
    )


def overlap_windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Word windows of ``size`` that share ``overlap`` words; the last one ends the text."""
    step = size - overlap

    def cut(all_words: Column) -> Column:
        last = F.greatest(F.size(all_words) - overlap - 1, F.lit(0))
        starts = F.sequence(F.lit(0), last, F.lit(step))
        windows = F.transform(
            starts, lambda at: F.array_join(F.slice(all_words, at + 1, size), " ")
        )
        return F.when(F.size(all_words) > 0, windows).otherwise(F.array().cast("array<string>"))

    return let(words(text), cut)


def preview(text: Column, length: int = 100) -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 with microseconds only when there are any; null becomes an empty string."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.when(micros(ts) % 1000000 == 0, whole).otherwise(fine), F.lit(""))


def expand_query(query: Column, hypothetical: Column) -> Column:
    """The text both search legs embed; cache lookups use the plain query instead."""
    return F.concat_ws("\n", query, hypothetical)


def query_length_ok(query: Column, low: int = 1, high: int = 2000) -> Column:
    return F.coalesce(F.length(query).between(low, high), F.lit(False))


def source_id(source_type: Column, filename: Column) -> Column:
    return F.sha2(F.concat_ws("/", source_type, filename), 256)


def archive_path(source_type: Column, doc_id: Column, version: Column, filename: Column) -> Column:
    return F.concat(
        F.lit("/"), source_type, F.lit("/"), doc_id.cast("string"), F.lit("/v"),
        version.cast("string"), F.lit("/"), filename,
    )
