import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagespark.operators import code as C
from pagespark.operators import page as P
from pagespark.plans import history as H
from pagespark.plans import spec as G
from pagespark.plans import summary as B
from pagespark.sources import readers as R
from pagespark.sources import shared
from pagespark.sources import sinks as K


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_html_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.html").write_text(f"<title>t{i}</title>\n<p>a")
    pages = R.read_pages(spark, str(tmp_path), format="html")
    assert sorted(r.title for r in P.page_titles(pages).collect()) == ["t0", "t1", "t2"]
    assert pages.select("page_id").distinct().count() == 3
    with pytest.raises(ValueError):
        R.read_pages(spark, str(tmp_path), format="pdf")


def test_contents(spark, tmp_path):
    def packed(b):
        return {"content": base64.encodebytes(b).decode(), "sha": "s", "encoding": "base64"}

    text = "é = 1\n" * 40
    rows = [
        {"repo": "r", "ref": "a", "path": "x", "payload": packed(text.encode())},
        {"repo": "r", "ref": "a", "path": "dir", "payload": [{"name": "f", "sha": "t"}]},
        {"repo": "r", "ref": "a", "path": "none", "payload": None},
        {"repo": "r", "ref": "a", "path": "bin", "payload": packed(b"\xff\xfe\x00")},
    ]
    got = {r.path: (r.content, r.blob_sha) for r in R.read_contents_dump(spark, lines(tmp_path / "c.json", rows)).collect()}
    assert got == {"x": (text, "s"), "dir": ("", None), "none": ("", None), "bin": (None, "s")}


def test_compare_and_listed_changes(spark, tmp_path):
    files = [{"filename": "a.py", "status": "modified"}, {"filename": "b.py", "status": "removed"}, {"filename": "c.md", "status": "added"},
             {"filename": "d.py", "status": "renamed", "sha": "z"}, {"filename": "e.py", "status": "added"}]
    dump = lines(tmp_path / "d.json", [{"repo": "o/r", "base_ref": "1", "head_ref": "2", "files": files}])
    listed = R.read_compare_dump(spark, dump)
    assert listed.count() == 5
    contents = spark.createDataFrame(
        [("o/r", "1", "a.py", "x", "s1"), ("o/r", "2", "a.py", "y", "s2"), ("o/r", "1", "b.py", "x", "s3"),
         ("o/r", "2", "b.py", "stale", "s4"), ("o/r", "2", "d.py", "n", "s5"),
         ("o/r", "2", "e.py", None, "s6")],
        "repo string, ref string, path string, content string, blob_sha string",
    )
    got = {r.path: tuple(r)[4:] for r in C.changed_files_listed(listed, contents).collect()}
    assert got == {
        "a.py": ("modified", "x", "y", "s1", "s2", None), "b.py": ("removed", "x", "", "s3", None, None),
        "d.py": ("renamed", "", "n", None, "s5", None), "e.py": ("added", "", "", None, "s6", "new content is not text"),
    }


def test_commits(spark, tmp_path):
    person = {"name": "Jo", "email": "j@x", "date": "2024-01-15T10:30:00Z"}
    rows = [{"repo": "o/r", "path": "a", "sha": "1", "commit": {"message": "m", "author": person, "committer": person}}]
    got = R.read_commits_dump(spark, lines(tmp_path / "k.json", rows)).first()
    assert str(got.committed_at) == "2024-01-15 10:30:00" and got.author.email == "j@x"


def test_checkout(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "m.py").write_bytes("é = 1\n".encode())
    (tmp_path / "note.txt").write_text("x")
    (got,) = R.read_checkout(spark, str(tmp_path), "o/r", "head").collect()
    data = "é = 1\n".encode()
    assert (got.repo, got.ref, got.path, got.content) == ("o/r", "head", "pkg/m.py", "é = 1\n")
    assert got.blob_sha == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def test_logs(spark, tmp_path):
    row = {"page_id": 1, "seq": 2, "ts_ms": 3, "type": "childList", "target": {"tag": "DIV"}, "added": [{"node_type": 1, "tag": "P"}]}
    log = R.read_mutation_log(spark, lines(tmp_path / "m.json", [row])).first()
    assert log.target.tag == "DIV" and log.added[0].tag == "P" and log.removed is None
    row = {"page_id": 1, "url": "u", "headers": {"a": "b"}, "ts": "2024-01-01T00:00:00Z"}
    assert R.read_request_log(spark, lines(tmp_path / "r.json", [row])).first().headers == {"a": "b"}
    row = {"page_id": 1, "element_id": "e", "depth": 0, "success": True}
    assert R.read_interaction_log(spark, lines(tmp_path / "i.json", [row])).first().success is True


def test_lines_that_are_no_json_are_kept(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('{"page_id": 1, "url": "u"}\n{"page_id": 2, "url"\n')
    rows = R.read_request_log(spark, str(path)).collect()
    assert sorted(((r.page_id, r.corrupt_record) for r in rows), key=str) == [(1, None), (None, '{"page_id": 2, "url"')]


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame(
        [("o/r", "a/x.py", "modified", "a\n", "b\n", "1", "2"), ("o/r", "b/x.py", "added", "", "c\n", None, "3")],
        "repo string, path string, status string, old_content string, new_content string, old_sha string, new_sha string",
    )
    K.write_file_versions(files, str(tmp_path / "v"))
    got = {r.path: (r.old_content, r.old_annotated, r.new_annotated) for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    assert got == {"a/x.py": ("a\n", "# [CHANGED] a", "# [CHANGED] b"), "b/x.py": (None, None, "# [ADDED] c")}
    assert "old_annotated" not in K.file_version_records(files, None).columns
    K.write_batch_summary(spark.createDataFrame([(0.5, None)], "success_rate double, message string"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == '{"success_rate":0.5,"message":null}'
    assert K.write_specs_json(spark.range(2).select(F.col("id").alias("page_id")), str(tmp_path / "j")) is None
    assert spark.read.json(str(tmp_path / "j")).count() == 2


_NAMES = ["007", "true", "2024-01-01", *(f"o/r{i}" for i in range(40))]


def _of_many_repositories(spark):
    """Two partitions that both hold files of every repository, some with names that look like other types."""
    rows = [_file(f"{side}.py", repo) for side in "ab" for repo in _NAMES]
    schema = "repo string, path string, status string, old_content string, new_content string, old_sha string, new_sha string"
    return spark.createDataFrame(rows, schema).repartition(2, "path")


def _repos_of_few_files(spark, path, n_files=2):
    """Files grow with rows and partitions, not with repositories; each is sorted by repository, which stays text and last."""
    back = spark.read.parquet(str(path))
    assert back.columns[-1] == "repo" and dict(back.dtypes)["repo"] == "string"
    assert len(list(path.rglob("*.parquet"))) <= n_files
    for part in path.rglob("*.parquet"):
        repos = [r.repo for r in spark.read.parquet(str(part)).select("repo").collect()]
        assert repos == sorted(repos)
    return sorted(r.repo for r in back.select("repo").collect())


def test_file_versions_of_many_repositories_are_few_files(spark, tmp_path):
    files = _of_many_repositories(spark)
    K.write_file_versions(files, str(tmp_path / "v"), style=None)
    assert _repos_of_few_files(spark, tmp_path / "v") == sorted(_NAMES * 2)
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    K.stream_into(stream, K.write_file_versions, str(tmp_path / "s"), style=None).awaitTermination()
    assert _repos_of_few_files(spark, tmp_path / "s" / "epoch=0") == sorted(_NAMES * 2)
    assert set(spark.read.parquet(str(tmp_path / "s")).columns) == {*spark.read.parquet(str(tmp_path / "v")).columns, "epoch"}


def test_a_change_report_of_many_repositories_is_few_files(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    K.write_change_report(H.report(_of_many_repositories(spark)), str(tmp_path / "r"))
    assert _repos_of_few_files(spark, tmp_path / "r", n) == sorted(_NAMES * 4)


def test_definition_diffs_of_many_repositories_are_few_files(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = _of_many_repositories(spark)
    related = files.select("repo", "path").withColumn("sha", F.lit("s"))
    K.write_definition_diffs(C.diff_header(C.unified_diff(C.definition_changes(files)), files), str(tmp_path / "d"), related=related)
    assert _repos_of_few_files(spark, tmp_path / "d" / "diffs", n) == sorted(_NAMES * 4)
    assert _repos_of_few_files(spark, tmp_path / "d" / "commits") == sorted(_NAMES * 2)


def _file_stream(spark, folder, batches):
    schema = "repo string, path string, status string, old_content string, new_content string, old_sha string, new_sha string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _file(path, repo="r"):
    return (repo, path, "modified", "def f():\n    return 1\n", "def f():\n    return 2\n\ndef g():\n    pass\n", "a", "b")


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    """The second batch fails after its first attempt had written, with rows that the replay does not write again."""
    stream = _file_stream(spark, tmp_path / "in", [[_file("a.py"), _file("b.py", "s")], [_file("c.py"), _file("d.py", "s")]])
    out, attempts = str(tmp_path / "out"), []

    def fails_once(batch, path, **options):
        attempts.append(path)
        if len(attempts) == 2:
            batch = batch.withColumn("repo", F.concat("repo", F.lit("-half")))
        K.write_file_versions(batch, path, **options)
        if len(attempts) == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        K.stream_into(stream, fails_once, out, style=None).awaitTermination()
    K.stream_into(stream, fails_once, out, style=None).awaitTermination()
    K.stream_into(stream, fails_once, out, style=None).awaitTermination()  # nothing new has arrived
    assert attempts == [f"{out}/epoch=0", f"{out}/epoch=1", f"{out}/epoch=1"]
    rows = spark.read.parquet(out)
    assert sorted(map(tuple, rows.select("epoch", "path", "repo").collect())) in (
        [(0, "a.py", "r"), (0, "b.py", "s"), (1, "c.py", "r"), (1, "d.py", "s")],
        [(0, "c.py", "r"), (0, "d.py", "s"), (1, "a.py", "r"), (1, "b.py", "s")],
    )


def test_every_sink_takes_a_stream(spark, tmp_path):
    stream = _file_stream(spark, tmp_path / "in", [[_file("a.py")], [_file("c.py")]])

    def to(name, write, prepare, frame=stream):
        K.stream_into(frame, write, f"{tmp_path}/{name}", prepare).awaitTermination()
        return f"{tmp_path}/{name}"

    diffs = to("diffs", K.write_definition_diffs, lambda files: C.diff_header(C.unified_diff(C.definition_changes(files)), files))
    assert sorted((r.path, r.name, r.change) for r in spark.read.parquet(diffs).collect()) == [
        ("a.py", "f", "modified"), ("a.py", "g", "added"), ("c.py", "f", "modified"), ("c.py", "g", "added")]
    assert spark.read.parquet(to("report", K.write_change_report, H.report)).select("path").distinct().count() == 2
    (tmp_path / "pages").mkdir()
    spark.createDataFrame([(1, "https://h/a", "<title>t</title><p>x")], "page_id long, url string, html string").write.json(str(tmp_path / "pages/in"))
    pages = spark.readStream.schema("page_id long, url string, html string").json(str(tmp_path / "pages/in"))
    log = spark.createDataFrame([], "page_id long, element_id string, parent_element_id string, depth int, success boolean, method string, content_changed boolean")
    specs = to("specs", K.write_specs_json, lambda p: G.page_specs(p, log), pages)
    assert spark.read.schema("page_id long").json(specs).filter("page_id is not null").count() == 1
    summary = to("summary", K.write_batch_summary, lambda p: B.batch_summary(p, log), pages)
    assert spark.read.schema("success_rate double").json(summary).count() == 1


def test_shared_folder_without_a_scheme_is_on_the_default_file_system(spark, monkeypatch):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        assert shared._qualified(spark, "/ckpt/x") == "file:/ckpt/x"
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:8020")
        assert shared._qualified(spark, "/ckpt/x") == "hdfs://127.0.0.1:8020/ckpt/x"
        assert shared._qualified(spark, "file:///ckpt/x") == "file:/ckpt/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_a_written_table_can_be_removed(spark):
    one, other = shared.written(spark.range(3)), shared.written(spark.range(4))
    shared.remove(one)
    assert other.count() == 4
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one._written_to)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path.getParent())
