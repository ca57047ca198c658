"""Readers for company files. All schemas are declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions import access
from corpusward.session import qualified

# ASCII record separator: lets many whole documents share one splittable file.
RECORD = "\u001e"


def wanted(path: Column) -> Column:
    """Editor leftovers are skipped."""
    name = access.basename(path)
    return ~(name.startswith("~$") | name.startswith("temp_"))


def folder_source(path: Column) -> Column:
    """Source type by the folder directly below the root, for a path that starts there; or null."""
    names = "|".join(access.FOLDER_SOURCES)
    return access.lookup(F.regexp_extract(path, rf"\A/({names})/", 1), access.FOLDER_SOURCES)


def below(spark: SparkSession, root: str, path: Column) -> Column:
    """What follows the root folder in ``path``, which may be URL-encoded."""
    place = qualified(spark, root)[1]
    out = F.lit(None).cast("string")
    for start in {place.toString(), place.toUri().toString()}:
        for form in {start, start.replace("file:///", "file:/"), start.replace("file:/", "file:///", 1)}:
            rest = F.substring(path, F.lit(len(form) + 1), F.length(path))
            out = F.coalesce(out, F.when(path.startswith(form + "/"), rest))
    return out


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, filename, source_type, length, modified)`` of all wanted files below ``root``.

    Only the listing is read: file contents are pruned from the scan. Folders that are missing
    simply contribute nothing.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    return (
        files.filter(wanted(F.col("path")))
        .withColumn("filename", access.basename(F.col("path")))
        .withColumn("source_type", folder_source(below(spark, base, F.col("path"))))
        .filter(F.col("source_type").isNotNull())
    )


def corpus_lines(spark: SparkSession, root: str) -> DataFrame:
    """``(source_type, filename, line)`` of all text files below the known folders."""
    base = root.rstrip("/")
    lines = (
        spark.read.option("recursiveFileLookup", True).text(base)
        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    )
    return (
        lines.filter(wanted(F.col("path")))
        .select(
            folder_source(below(spark, base, F.col("path"))).alias("source_type"),
            access.basename(F.col("path")).alias("filename"), "line",
        )
        .filter(F.col("source_type").isNotNull())
    )


def routed(names: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """``(accepted with source_type, rejected)`` by file extension."""
    typed = names.withColumn("source_type", access.extension_source(F.col(path)))
    return (
        typed.filter(F.col("source_type").isNotNull()),
        typed.filter(F.col("source_type").isNull()).drop("source_type"),
    )


def read_markdown(spark: SparkSession, path: str | list[str], bundled: bool = False) -> DataFrame:
    """``(path, filename, text)``: whole documents.

    One file per document, or with ``bundled`` many documents per file, separated by the ASCII
    record separator. Bundles are splittable and spare the cluster millions of tiny files.
    """
    read = spark.read.text(path, lineSep=RECORD) if bundled else spark.read.text(path, wholetext=True)
    return read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("value").alias("text"),
    )


def read_messages(
    spark: SparkSession, path: str | list[str], one_array_per_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(messages, rejected)`` from JSON arrays of messages, with ``filename``, ``path`` and ``pos``.

    A file holds one array, or with ``one_array_per_line`` an array per line, which splits over
    tasks. Missing fields become ``Unknown``, an empty text and time 0; JSON that is not an array
    yields nothing. Text that is not JSON is rejected as a whole (``pos`` null, the text kept); of
    an array only messages whose time is null or not a number are.
    """
    return messages_in(spark.read.text(path, wholetext=not one_array_per_line).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"),
        "value",
    ))


def messages_in(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(messages, rejected)`` of ``files(path, filename, value)``, each value an array's text."""
    # maps tell a missing field from a null one
    listed = F.from_json("value", "ARRAY<MAP<STRING, STRING>>")
    array = F.btrim("value", F.lit(" \t\r\n")).startswith("[")
    raw = files.filter(array).select("path", "filename", F.posexplode(listed).alias("pos", "m"))
    field = lambda name: F.try_element_at("m", F.lit(name)).alias(name)
    time = F.when(F.map_contains_key("m", F.lit("ts")), field("ts")).otherwise(F.lit("0")).alias("ts")
    good, bad = parse_messages(raw.select("path", "filename", "pos", field("user"), field("text"), time))
    broken = files.filter(
        (F.btrim("value", F.lit(" \t\r\n")) != "")
        & F.when(array, listed.isNull()).otherwise(F.get_json_object("value", "$").isNull())
    ).select("path", "filename", F.col("value").alias("text"))
    return good, bad.unionByName(broken, allowMissingColumns=True)


def parse_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(messages, rejected)``: defaults filled in, epoch seconds to timestamps."""
    filled = raw.withColumn("user", F.coalesce("user", F.lit("Unknown"))).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    parsed = filled.withColumn("__seconds", F.col("ts").try_cast("decimal(20,6)"))
    micros = (F.col("__seconds") * 1000000).cast("bigint")
    good = parsed.filter(F.col("__seconds").isNotNull()).withColumn("ts", F.timestamp_micros(micros))
    bad = parsed.filter(F.col("__seconds").isNull())
    return good.drop("__seconds"), bad.drop("__seconds")


def read_table_rows(
    spark: SparkSession, path: str | list[str], schema: str, separator: str = " ", **options
) -> DataFrame:
    """``(filename, row_no, split, row_text, header)`` per row of delimited tables with a header line.

    A file is read in splits by many tasks. ``row_no`` ascends in the order of the file's lines,
    with gaps: it is made of the byte at which the line's split starts and the line's place among
    those of its task, so no pass counts lines and nothing is shuffled. ``split`` is that byte, an
    order bucket for running totals. Both may differ between two scans: write the rows (``cut``)
    before an operator that reads them more than once.
    """
    split = F.col("_metadata.file_block_start")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    table = (
        spark.read.schema(schema).option("header", True)
        .option("mode", "PERMISSIVE").options(**options).csv(path)
    )
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    return table.select(
        F.col("_metadata.file_name").alias("filename"),
        (split.cast("decimal(19,0)") * F.lit(2**33).cast("decimal(10,0)") + place).cast("decimal(30,0)").alias("row_no"),
        split.alias("split"),
        F.concat_ws(separator, *cells).alias("row_text"),
        F.lit(separator.join(table.columns)).alias("header"),
    )


def table_rows_in(files: DataFrame, separator: str = " ") -> DataFrame:
    """``(filename, row_no, row_text, header)`` of ``files(filename, value)``, comma-separated.

    ``row_no`` is the line's place in the file. Cells may be quoted; a quoted cell keeps its commas,
    not its line ends. Blank lines are skipped.
    """
    cell = r',(?=(?:[^"]*"[^"]*")*[^"]*\Z)'
    plain = lambda c: F.replace(F.regexp_replace(c, r'\A\s*"|"\s*\Z', ""), F.lit('""'), F.lit('"'))
    text = lambda line: F.array_join(F.transform(F.split(line, cell, -1), plain), separator)
    lines = files.select("filename", F.posexplode(F.split("value", "\r?\n")).alias("row_no", "line"))
    lines = lines.filter(F.trim("line") != "").select("filename", "row_no", text(F.col("line")).alias("row_text"))
    first = lines.groupBy("filename").agg(F.min_by("row_text", "row_no").alias("header"), F.min("row_no").alias("__top"))
    return lines.join(first, "filename").filter(F.col("row_no") > F.col("__top")).drop("__top")


def landed(rows: DataFrame, root: str | None = None) -> DataFrame:
    """``(path, source_type, filename, value, modified)`` of files in the known folders.

    ``rows(path, value, modified)``, paths below ``root`` or, without it, absolute in a store of
    their own. A path is ``/folder/name`` or ``/delivery/folder/name``; the name below the folder is
    the file's ``filename``, so a later delivery of it is a new version. Paths below ``root`` are as
    Spark's readers spell them, with escapes, which the filename has not.
    """
    path = F.col("path") if root is None else below(rows.sparkSession, root, F.col("path"))
    spelled = F.replace("__name", F.lit("+"), F.lit("%2B"))
    name = F.col("__name") if root is None else F.coalesce(F.try_url_decode(spelled), "__name")
    names = "|".join(access.FOLDER_SOURCES)
    pattern = rf"\A/(?:[^/]+/)?({names})/(.+)\Z"
    found = rows.withColumn("__place", path).filter(wanted(F.col("path")) & F.col("__place").rlike(pattern))
    return found.withColumn("__name", F.regexp_extract("__place", pattern, 2)).select(
        "path", access.lookup(F.regexp_extract("__place", pattern, 1), access.FOLDER_SOURCES).alias("source_type"),
        name.alias("filename"), "value", "modified",
    )


def read_files(spark: SparkSession, root: str, streaming: bool = False) -> DataFrame:
    """Whole files below ``root``, as ``landed`` describes them."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    return landed(rows.select(
        F.col("_metadata.file_path").alias("path"), "value",
        F.col("_metadata.file_modification_time").alias("modified"),
    ), root)


def read_objects(spark: SparkSession, uris: list[str], fmt: str = "text", **options) -> DataFrame:
    """Read ``minio://bucket/object`` URIs through the S3 file system Spark is set up with."""
    paths = [u.replace("minio://", "s3a://", 1) if u.startswith("minio://") else u for u in uris]
    return spark.read.format(fmt).options(**options).load(paths)
