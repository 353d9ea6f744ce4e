"""Queries that write through the sinks and read back through the sources.

Files go to a new folder under the shared folder the session names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.tables import commits, derived, mutation_log
from pagespark.operators import code as C
from pagespark.plans import history as H
from pagespark.plans import spec as G
from pagespark.plans import summary as B
from pagespark.sources import readers as R
from pagespark.sources import sinks as K
from pagespark.sources.shared import shared_folder


def _json(spark, df) -> str:
    path = f"{shared_folder(spark)}/json"
    df.write.json(path)
    return path


@query("read_pages", "SELECT page_id, url, CAST(length(html) AS INT) AS html_length FROM pages")
def _(spark, sf):
    pages = R.read_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("html_length"))


@query("read_request_log", "SELECT page_id, url, method, resource_type FROM request_log")
def _(spark, sf):
    log = R.read_request_log(spark, _json(spark, derived(spark, sf, "request_log")))
    return log.select("page_id", "url", "method", "resource_type")


@query("read_mutation_log", "SELECT page_id, seq, ts_ms, type, target_tag FROM mutation_log")
def _(spark, sf):
    log = R.read_mutation_log(spark, _json(spark, mutation_log(spark, sf)))
    return log.select("page_id", "seq", "ts_ms", "type", F.col("target.tag").alias("target_tag"))


@query("read_interaction_log", "SELECT page_id, element_id, parent_element_id, depth, success, method, content_changed FROM interaction_log")
def _(spark, sf):
    log = R.read_interaction_log(spark, _json(spark, derived(spark, sf, "interaction_log")))
    return log.select("page_id", "element_id", "parent_element_id", "depth", "success", "method", "content_changed")


def _comparisons(spark, sf):
    """The changed files of a directory as one stored comparison of its repository (ten files at most)."""
    files = C.changed_files(derived(spark, sf, "file_versions"), "base", "head")
    entry = F.struct(F.col("path").alias("filename"), "status", F.coalesce("new_sha", "old_sha").alias("sha"))
    dump = files.groupBy("repo").agg(F.collect_list(entry).alias("files"))
    return dump.withColumn("base_ref", F.lit("base")).withColumn("head_ref", F.lit("head"))


def _contents(spark, sf):
    """Stored contents answers; some are directory listings or missing."""
    v = derived(spark, sf, "file_versions")
    file = F.to_json(F.struct(F.base64(F.encode("content", "UTF-8")).alias("content"), F.col("blob_sha").alias("sha")))
    number = F.regexp_extract("path", r"m(\d+)\.", 1).cast("long")
    payload = F.when(number % 11 == 4, F.lit('[{"name": "x", "sha": "s"}]')).when(number % 11 != 5, file)
    return v.select("repo", "ref", "path", payload.alias("payload"))


@query("read_compare_dump", "SELECT repo, 'base' AS base_ref, 'head' AS head_ref, path, status FROM files")
def _(spark, sf):
    return R.read_compare_dump(spark, _json(spark, _comparisons(spark, sf)))


_CONTENTS = """SELECT repo, ref, path, CASE WHEN k IN (4, 5) THEN '' ELSE content END AS content, CASE WHEN k IN (4, 5) THEN NULL ELSE blob_sha END AS blob_sha
  FROM (SELECT *, CAST(regexp_extract(path, 'm([0-9]+)\\.', 1) AS BIGINT) % 11 AS k FROM file_versions) v"""


@query("read_contents_dump", _CONTENTS)
def _(spark, sf):
    return R.read_contents_dump(spark, _json(spark, _contents(spark, sf)))


@query(
    "changed_files_listed",
    f"""SELECT f.repo, f.path, f.status, coalesce(o.content, '') AS old_content, coalesce(n.content, '') AS new_content, o.blob_sha AS old_sha, n.blob_sha AS new_sha, CAST(NULL AS VARCHAR) AS error
    FROM files f LEFT JOIN ({_CONTENTS}) o ON f.repo = o.repo AND f.path = o.path AND o.ref = 'base'
    LEFT JOIN ({_CONTENTS}) n ON f.repo = n.repo AND f.path = n.path AND n.ref = 'head'""",
)
def _(spark, sf):
    listed = R.explode_compare(_comparisons(spark, sf))
    return C.changed_files_listed(listed, R.decode_contents(_contents(spark, sf))).drop("base_ref", "head_ref")


@query("read_commits_dump", "SELECT repo, path, sha, author_name, committer_name, message, CAST(epoch(committed_at) AS BIGINT) AS committed_s FROM commits")
def _(spark, sf):
    def dated(who):
        date = F.date_format(F.to_timestamp("committed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return F.struct(f"{who}.name", f"{who}.email", date.alias("date")).alias(who)

    dump = commits(spark, sf).select(
        "repo", "path", "sha", F.struct("message", dated("author"), dated("committer")).alias("commit")
    )
    found = R.read_commits_dump(spark, _json(spark, dump))
    people = [F.col(f"{w}.name").alias(f"{w}_name") for w in ("author", "committer")]
    return found.select("repo", "path", "sha", *people, "message", F.unix_seconds("committed_at").alias("committed_s"))


@query("read_file_versions", "SELECT repo, ref, path, content, blob_sha FROM file_versions")
def _(spark, sf):
    path = f"{shared_folder(spark)}/versions"
    derived(spark, sf, "file_versions").write.parquet(path)
    return R.read_file_versions(spark, path)


@query("write_specs_json", "SELECT page_id, url FROM pages")
def _(spark, sf):
    path = f"{shared_folder(spark)}/specs"
    specs = G.page_specs(derived(spark, sf, "pages_aug"), derived(spark, sf, "interaction_log"))
    K.write_specs_json(specs, path)
    back = spark.read.schema("page_id bigint, metadata struct<url: string>").json(path)
    return back.select("page_id", "metadata.url")


@query("write_batch_summary", "SELECT CAST(1 AS DOUBLE) AS success_rate, count(*) AS n_pages FROM pages")
def _(spark, sf):
    path = f"{shared_folder(spark)}/summary"
    K.write_batch_summary(B.batch_summary(derived(spark, sf, "pages_aug"), derived(spark, sf, "interaction_log")), path)
    back = spark.read.schema("success_rate double, common_layout_types map<string,bigint>").json(path)
    total = F.aggregate(F.map_values("common_layout_types"), F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("success_rate", total.alias("n_pages"))


@query("write_definition_diffs", "SELECT repo, path, name, change, node_type FROM changes")
def _(spark, sf):
    path = f"{shared_folder(spark)}/diffs"
    files = C.changed_files(derived(spark, sf, "file_versions"), "base", "head")
    K.write_definition_diffs(C.diff_header(C.unified_diff(C.definition_changes(files)), files), path)
    back = spark.read.parquet(path).filter(F.contains("text", F.lit("\n@@ ")))
    return back.select("repo", "path", "name", "change", "node_type")


@query(
    "write_file_versions",
    """SELECT repo, path, status, nullif(old_content, '') AS old_content, nullif(new_content, '') AS new_content FROM files""",
)
def _(spark, sf):
    path = f"{shared_folder(spark)}/files"
    K.write_file_versions(C.changed_files(derived(spark, sf, "file_versions"), "base", "head"), path)
    back = spark.read.parquet(path)
    marked = F.col("old_annotated").isNull() == F.col("old_content").isNull()
    return back.filter(marked).select("repo", "path", "status", "old_content", "new_content")


@query("write_change_report", "SELECT c.repo, c.path, c.name, f.status FROM changes c JOIN files f ON c.repo = f.repo AND c.path = f.path")
def _(spark, sf):
    path = f"{shared_folder(spark)}/report"
    files = C.changed_files(derived(spark, sf, "file_versions"), "base", "head")
    K.write_change_report(H.report(files), path)
    return spark.read.parquet(path).select("repo", "path", "name", "status")


@query(
    "stream_file_versions",
    """SELECT repo, path, status, nullif(old_content, '') AS old_content, nullif(new_content, '') AS new_content FROM files""",
)
def _(spark, sf):
    folder = shared_folder(spark)
    files = C.changed_files(derived(spark, sf, "file_versions"), "base", "head")
    files.repartition(3, "repo", "path").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    K.stream_into(stream, K.write_file_versions, f"{folder}/out", style=None).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("repo", "path", "status", "old_content", "new_content")
