"""Sources.  Schemas are declared, so nothing is inferred and unread columns are never parsed.

A line of JSON that cannot be read is a row of NULLs with the line in ``corrupt_record``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark import schemas as S


CORRUPT = "corrupt_record"


def _json(reader, schema: str, path: str) -> DataFrame:
    return reader.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Pages from a table, or from html files (one page per file, identified by a hash of its path)."""
    if format == "parquet":
        return spark.read.parquet(path)
    if format != "html":
        raise ValueError(f"unknown page format: {format}")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    source = F.input_file_name()
    return files.select(F.xxhash64(source).alias("page_id"), source.alias("url"), F.col("value").alias("html"))


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark.read, S.REQUEST_LOG, path)


def read_mutation_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark.read, S.MUTATION_LOG, path)


def stream_mutation_log(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream of arriving files."""
    return _json(spark.readStream, S.MUTATION_LOG, path)


def stream_request_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark.readStream, S.REQUEST_LOG, path)


def read_interaction_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark.read, S.INTERACTION_LOG, path)


def read_compare_dump(spark: SparkSession, path: str) -> DataFrame:
    """Files named by stored ref comparisons: (repo, base_ref, head_ref, path, status)."""
    return explode_compare(spark.read.schema(S.COMPARE_DUMP).json(path))


def explode_compare(dump: DataFrame) -> DataFrame:
    return dump.select("repo", "base_ref", "head_ref", F.explode("files").alias("f")).select(
        "repo", "base_ref", "head_ref", F.col("f.filename").alias("path"), F.col("f.status").alias("status")
    )


def read_contents_dump(spark: SparkSession, path: str) -> DataFrame:
    """File versions from stored contents answers: (repo, ref, path, content, blob_sha)."""
    return decode_contents(spark.read.schema(S.CONTENTS_DUMP).json(path))


def decode_contents(dump: DataFrame) -> DataFrame:
    """Decode base64 UTF-8 contents.  A directory listing or a missing file is empty text without sha;
    bytes that are not UTF-8 leave ``content`` NULL."""
    is_file = F.startswith(F.trim("payload"), F.lit("{"))
    fields = F.from_json("payload", "content string, sha string")
    df = dump.withColumn("f", F.when(is_file, fields))
    packed = F.regexp_replace(F.col("f.content"), r"\s", "")
    text = F.try_validate_utf8(F.unbase64(packed).cast("string"))
    return df.select(
        "repo",
        "ref",
        "path",
        F.when(F.coalesce(is_file, F.lit(False)), text).otherwise("").alias("content"),
        F.col("f.sha").alias("blob_sha"),
    )


def read_commits_dump(spark: SparkSession, path: str) -> DataFrame:
    """Stored commits, one row per commit and file; dates become timestamps."""
    return flatten_commits(spark.read.schema(S.COMMITS_DUMP).json(path))


def flatten_commits(dump: DataFrame) -> DataFrame:
    return dump.select(
        "repo",
        "path",
        "sha",
        F.col("commit.author").alias("author"),
        F.col("commit.committer").alias("committer"),
        F.to_timestamp("commit.committer.date").alias("committed_at"),
        F.col("commit.message").alias("message"),
    )


def read_file_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_checkout(spark: SparkSession, root: str, repo: str, ref: str, glob: str = "*.py") -> DataFrame:
    """File versions from a directory tree holding one ref; ``blob_sha`` is the content's git blob id."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    size = F.octet_length("content").cast("string")
    blob = F.concat(F.encode(F.concat(F.lit("blob "), size), "UTF-8"), F.lit(bytearray(b"\0")), F.col("content"))
    at = root.rstrip("/").rsplit(":", 1)[-1] + "/"
    return files.select(
        F.lit(repo).alias("repo"),
        F.lit(ref).alias("ref"),
        F.substring_index("path", at, -1).alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
        F.sha1(blob).alias("blob_sha"),
    )
