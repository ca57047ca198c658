"""Identity for rows whose ids may be missing or repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from corpusward.session import cut

PLACE = ["__file", "__row"]
# Steps above a scan that give each row of a file at most once.
_ONE_TO_ONE = {"Project", "Filter", "SubqueryAlias", "View"}


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is one table of files with nothing but projections and filters above it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ONE_TO_ONE:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and not plan.isStreaming()


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, which no two rows share.

    File and row number are an identity only where rows come straight from a scan; what a generator,
    a join or a union may have doubled, or what lies in no file, is written to a table first.
    """
    rows = docs if _is_scan(docs) and "_metadata" not in docs.columns else cut(docs)
    try:
        at = rows.metadataColumn("_metadata")
        return rows.select("*", at["file_path"].alias("__file"), at["row_index"].alias("__row"))
    except AnalysisException:  # files without row numbers, or hidden by a projection
        at = (rows := cut(docs)).metadataColumn("_metadata")
        return rows.select("*", at["file_path"].alias("__file"), at["row_index"].alias("__row"))
