"""Code-change operators on small hand-written modules."""

import difflib

import pytest
from pyspark.sql import functions as F

from pagespark.operators import code as C
from pagespark.operators import code_kernels as K
from pagespark.plans import history as H
from pagespark.sources import sinks

OLD = '''import os

@cached
@app.route("/x", methods=['GET'])
def load(path):
    """Load a file."""
    return open(path)

class Box:
    "A box"
    def get(self):
        return 1

    async def put(self, v):
        def inner(): pass
        return v

class Lid:
    def get(self):
        return 2

def gone():
    pass
'''
NEW = OLD.replace("return 1", "return 10").replace("def gone():\n    pass\n", "def fresh(x):\n    return x\n").replace(
    "import os\n", "import os\nimport re\n"
)
VERSIONS = "repo string, ref string, path string, content string, blob_sha string"


@pytest.fixture(scope="module")
def versions(spark):
    rows = [
        ("o/r", "a", "m.py", OLD, "1"), ("o/r", "b", "m.py", NEW, "2"),
        ("o/r", "a", "same.py", "x = 1\n", "3"), ("o/r", "b", "same.py", "x = 1\n", "3"),
        ("o/r", "a", "gone.py", "def a(): pass\n", "4"), ("o/r", "b", "new.py", "def a(): pass\n", "4"),
        ("o/r", "a", "t.txt", "x", "5"), ("o/r", "b", "t.txt", "y", "6"),
        ("o/r", "b", "bad.py", "def (", "7"), ("solo", "b", "n.py", "def z(): pass", "8"),
    ]
    return spark.createDataFrame(rows, VERSIONS)


def test_definitions_in_preorder():
    found, error = K.definitions_of(OLD)
    assert error is None
    assert [(d["qualname"], d["node_type"], d["start_line"], d["end_line"]) for d in found] == [
        ("load", "function", 4, 6), ("Box", "class", 8, 15), ("Box.get", "function", 10, 11),
        ("Box.put", "async_function", 13, 15), ("Box.put.inner", "function", 14, 14), ("Lid", "class", 17, 19),
        ("Lid.get", "function", 18, 19), ("gone", "function", 21, 22),
    ]
    assert found[0]["decorators"] == ["cached", "app.route('/x', methods=['GET'])"]
    assert found[0]["source_code"].startswith("def load") and found[0]["docstring"] == "Load a file."
    assert found[1]["docstring"] == "A box" and found[2]["docstring"] is None


@pytest.mark.parametrize("source", [None, "", "  \n\t", "def (", "x = 1\0", "(" * 400])
def test_unparsable_sources_have_no_definitions(source):
    found, error = K.definitions_of(source)
    assert found == []
    assert (error is None) == (source is None or not source.strip())


def test_changed_files(versions):
    got = {r.path: (r.status, r.old_sha, r.new_sha) for r in C.changed_files(versions, "a", "b").filter("repo = 'o/r'").collect()}
    assert got == {
        "m.py": ("modified", "1", "2"), "gone.py": ("removed", "4", None), "new.py": ("added", None, "4"),
        "bad.py": ("added", None, "7"),
    }
    back = C.changed_files(versions, "b", "a")
    assert back.count() == C.changed_files(versions, "a", "b").count()
    renamed = {"added": "removed", "removed": "added", "modified": "modified"}
    assert {r.path: renamed[r.status] for r in back.filter("repo = 'o/r'").collect()} == {k: v[0] for k, v in got.items()}


def test_unreadable_files_are_rows_with_an_error(spark):
    rows = [("r", "a", "x.py", None, None), ("r", "b", "x.py", "a", None), ("r", "b", "y.py", "a", None), ("r", "a", "z.py", None, None)]
    got = {r.path: (r.status, r.error) for r in C.changed_files(spark.createDataFrame(rows, VERSIONS), "a", "b").collect()}
    assert got == {"x.py": ("modified", "old content is not text"), "y.py": ("added", None), "z.py": ("removed", "old content is not text")}


def test_without_shas_texts_are_compared(versions):
    plain = C.changed_files(versions.drop("blob_sha"), "a", "b")
    assert sorted(r.path for r in plain.collect()) == ["bad.py", "gone.py", "m.py", "n.py", "new.py"]


def test_changed_definitions_by_name_and_by_qualified_name(versions):
    files = C.changed_files(versions, "a", "b").filter("path = 'm.py'")
    by_name = {r.name: r.change for r in C.definition_changes(files).collect()}
    # the last "get" of the file wins and did not change; its class did
    assert by_name == {"Box": "modified", "gone": "removed", "fresh": "added"}
    by_path = {r.qualname: r.change for r in C.definition_changes(files, "qualname").collect()}
    assert by_path == {"Box": "modified", "Box.get": "modified", "gone": "removed", "fresh": "added"}


def test_totals_count_files_without_changed_definitions(versions):
    files, defs = H.analyze_refs(versions, "a", "b")
    assert [tuple(r) for r in C.repo_totals(files, defs).collect()] == [("o/r", 4, 5)]
    assert tuple(C.overall_totals(C.repo_totals(files, defs)).first()) == (1, 4, 5)
    assert C.repo_totals_of(files).collect() == C.repo_totals(files, defs).collect()
    report = C.change_report(C.file_definition_changes(files)).collect()
    assert sorted(map(str, H.report(files).collect())) == sorted(map(str, report))
    assert len(report) == 5 and {r.path for r in report} == {"m.py", "gone.py", "new.py"}
    assert {(r.repo_files_changed, r.all_definitions_changed) for r in report} == {(4, 5)}
    assert [r.path for r in C.parse_errors(versions).collect()] == ["bad.py"]


A = "\n".join(["def one():", "    return 1 < 2 & 3", "", "x = 1", "y = 2", "end"]) + "\n"
B_ = "\n".join(["def one():", "    return 10", "    # more", "", "x = 1", "end", "tail"]) + "\n"


@pytest.fixture(scope="module")
def changes(spark):
    cols = "repo string, path string, status string, old_content string, new_content string, old_sha string, new_sha string"
    rows = [("o/r", "f.py", "modified", A, B_, "s1", "s2"), ("o/r", "n.py", "added", "", "a\n", None, "s3")]
    return spark.createDataFrame(rows, cols)


def test_line_status(changes):
    got = [tuple(r) for r in C.line_status(changes).filter("path = 'f.py'").select("side", "line_no", "status", "mapped_line").collect()]
    assert got == [
        ("old", 0, "unchanged", None), ("old", 1, "changed", 1), ("old", 2, "unchanged", None),
        ("old", 3, "unchanged", None), ("old", 4, "removed", None), ("old", 5, "unchanged", None),
        ("new", 0, "unchanged", None), ("new", 1, "changed", None), ("new", 2, "changed", None),
        ("new", 3, "unchanged", None), ("new", 4, "unchanged", None), ("new", 5, "unchanged", None),
        ("new", 6, "added", None),
    ]
    summary = {r.path: tuple(r)[2:] for r in C.change_summary(changes).collect()}
    assert summary == {"f.py": (1, 1, 1, 4), "n.py": (1, 0, 0, 0)}


def test_annotations(changes):
    def text(side, style, path="f.py"):
        return C.annotate(changes, side, style).filter(F.col("path") == path).first().annotated

    assert text("old", "comment").split("\n") == [
        "def one():", "# [CHANGED]     return 1 < 2 & 3", "", "x = 1", "# [REMOVED] y = 2", "end"]
    assert text("new", "inline").split("\n")[-1] == ">>> [ADDED] tail"
    assert text("old", "whatever") == text("old", "comment")
    html = text("old", "html").split("\n")
    assert html[1] == '<span class="changed-line">    return 1 &lt; 2 &amp; 3</span>'
    assert html[-1] == "</html>" and html[2] == '<span class="unchanged-line"></span>'
    assert text("old", "html", "n.py") == "" and text("new", "comment", "n.py") == "# [ADDED] a"


@pytest.mark.parametrize("sep", ["\n", "\r\n", "\x0c", " "])
def test_line_numbers_follow_python_line_ends(sep):
    rows = K.line_statuses(sep.join("abc"), sep.join("abd"))
    assert [r["line"] for r in rows if r["side"] == "old"] == ["a", "b", "c"]


def test_frequent_lines_stop_anchoring_in_long_files():
    old = [f"a{i}" if i % 3 else "pass" for i in range(250)]
    new = ["pass"] + old[60:] + ["pass"] * 20
    statuses = K.line_statuses("\n".join(old), "\n".join(new))
    equal = sum(b.size for b in difflib.SequenceMatcher(None, old, new).get_matching_blocks())
    assert sum(r["status"] == "unchanged" and r["side"] == "old" for r in statuses) == equal
    assert len(statuses) == len(old) + len(new)
    for side, n in (("old", len(old)), ("new", len(new))):
        assert [r["line_no"] for r in statuses if r["side"] == side] == list(range(n))


def test_diffs_and_headers(spark, versions):
    files = C.changed_files(versions, "a", "b").filter("path = 'm.py'")
    commits = spark.createDataFrame(
        [("o/r", "m.py", "abcdef1234", "2024-01-15 10:30:00", "Fix box\n\n  twice\n", "Jo", "Jo"),
         ("o/r", "m.py", "0123456789", "2024-01-16 10:30:00", "Open", "Al", "Bo")],
        "repo string, path string, sha string, at string, message string, a string, c string",
    )
    person = lambda c: F.struct((F.col(c) if isinstance(c, str) else c).alias("name"), F.concat(c, F.lit("@x")).alias("email"))
    commits = commits.select("repo", "path", "sha", F.to_timestamp("at").alias("committed_at"), "message",
                             person("a").alias("author"), person("c").alias("committer"))
    related = C.related_commits(files, commits)
    full = C.diff_header(C.unified_diff(C.definition_changes(files)), files, related).cache()
    rows = {r.name: r for r in full.collect()}
    box = rows["Box"]
    assert box.diff.split("\n")[:2] == ["--- m.py (old) - class: Box", "+++ m.py (new) - class: Box"]
    assert "-        return 1\n+        return 10" in box.diff
    assert box.header == (
        "# Diff for class: Box\n# File: m.py\n# Repository: o/r\n# Status: modified\n# Old SHA: 1\n# New SHA: 2\n"
        "# Related commits: 2\n#" + "=" * 60 + "\n"
    )
    assert [r.text for r in related.orderBy(F.desc("committed_at")).collect()] == [
        "# Commit: 01234567\n# Date: 2024-01-16T10:30:00Z\n# Author: Al <Al@x>\n# Committer: Bo <Bo@x>\n# Message: Open\n#\n",
        "# Commit: abcdef12\n# Date: 2024-01-15T10:30:00Z\n# Author: Jo <Jo@x>\n# Message: Fix box\n#          twice\n#\n",
    ]
    assert "# Old SHA" not in rows["fresh"].header and "# New SHA" not in rows["gone"].header
    at = lambda d: F.to_timestamp(F.lit(d))
    bounds = spark.range(1).select(F.lit("o/r").alias("repo"), at("2024-01-15 10:30:00").alias("base_at"), at("2024-01-16 10:30:00").alias("head_at"))
    assert [r.sha for r in C.related_commits(files, commits, bounds).collect()] == ["0123456789"]
    many = spark.range(250).select(F.lit("o/r").alias("repo"), F.lit("m.py").alias("path"), F.col("id").cast("string").alias("sha"),
                                   F.timestamp_seconds("id").alias("committed_at"), F.lit("m").alias("message"), person(F.lit("a")).alias("author"), person(F.lit("a")).alias("committer"))
    assert C.related_commits(files, many).count() == 250
    assert sinks.diff_records(full).count() == 3
    assert sinks.diff_records(full.withColumn("diff", F.lit(" "))).count() == 0


_LONG = 'def f():\n    """' + "x" * 100_000 + '"""\n    return %d\n'


def _with_broadcasts_of(spark, size, df):
    """Rows of a frame, where a larger broadcast fails."""
    setting = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, size)
        return df.collect()
    finally:
        spark.conf.set(setting, before)


def test_texts_of_changed_files_are_not_broadcast(spark, tmp_path):
    """Compressed, 6 MB of texts look small to Spark; the bit map of their keys takes less than the 2 MB that may be sent."""
    rows = [("o/r", ref, f"m{i}.py", _LONG % n, f"{ref}{i}") for n, ref in enumerate("ab") for i in range(30)]
    spark.createDataFrame(rows, VERSIONS).write.parquet(str(tmp_path / "v"))
    files = C.changed_files(spark.read.parquet(str(tmp_path / "v")), "a", "b")
    got = _with_broadcasts_of(spark, "2m", files.select("path", "status", F.length("old_content"), F.length("new_content")))
    assert sorted(map(tuple, got)) == sorted((f"m{i}.py", "modified", len(_LONG) - 1, len(_LONG) - 1) for i in range(30))


def test_diffs_and_files_of_headers_are_not_broadcast(spark, tmp_path):
    rows = [("o/r", f"m{i}.py", "modified", _LONG % 0, _LONG % 1, f"a{i}", f"b{i}") for i in range(30)]
    schema = "repo string, path string, status string, old_content string, new_content string, old_sha string, new_sha string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    related = files.select("repo", "path", F.explode(F.array(F.lit("s"), F.lit("t"))).alias("sha"))
    for commits, shown in ((None, ""), (related, "# Related commits: 2\n")):
        diffs = sinks.diff_records(C.diff_header(C.unified_diff(C.definition_changes(files)), files, commits))
        found = {r.path: r for r in _with_broadcasts_of(spark, "1k", diffs)}
        assert sorted(found) == sorted(f"m{i}.py" for i in range(30))
        assert all(f"# Old SHA: a{p[1:-3]}\n# New SHA: b{p[1:-3]}\n{shown}#=" in r.text for p, r in found.items())
        assert all(r.diff.endswith("-    return 0\n+    return 1") and len(r.diff) > 100_000 for r in found.values())


def test_side_by_side(versions):
    files = C.changed_files(versions, "a", "b").filter("path = 'm.py'")
    texts = {r.name: r.comparison for r in C.side_by_side(C.definition_changes(files)).collect()}
    assert texts["fresh"] == (
        "\n" + "=" * 80 + "\nFUNCTION: fresh\n" + "=" * 80 + "\nSTATUS: ADDED\nDecorators: []\n\nNEW VERSION:\n"
        + "-" * 40 + "\ndef fresh(x):\n    return x"
    )
    assert "STATUS: MODIFIED\nOld decorators: []\nNew decorators: []\n\nOLD VERSION:" in texts["Box"]


def test_python_list_notation(spark):
    items = [["a"], [], ["x('y')", 'q"'], ["it's \"both\""], ["b\\c"]]
    df = spark.createDataFrame([(i,) for i in items], "d array<string>")
    assert [r[0] for r in df.select(C._python_list(F.col("d"))).collect()] == [repr(i) for i in items]


def test_commit_pairs_cross_bucket_ends(spark):
    rows = [("r", f"s{i}", f"2024-01-{1 + i // 3:02d} {i % 3:02d}:00:00") for i in range(20)] + [("q", "only", "2024-01-01 00:00:00")]
    commits = spark.createDataFrame(rows, "repo string, sha string, at string").withColumn("committed_at", F.to_timestamp("at"))
    for buckets in ((), ("hour",), ("day",), ("hour", "day"), ("minute", "hour", "day"), ("day", "month")):
        got = [(r.repo, r.head_ref, r.base_ref) for r in C.commit_pairs(commits, buckets=buckets).collect()]
        assert sorted(got) == sorted(("r", f"s{i + 1}", f"s{i}") for i in range(19))
    since = C.commit_pairs(commits, since="2024-01-06")
    assert {r.base_ref for r in since.collect()} == {f"s{i}" for i in range(15, 19)}


def test_commits_stop_at_the_base(spark):
    rows = [("r", "f", str(i), i, d) for i, d in enumerate(["2024-03-05", "2024-03-04", "2024-03-01", "2024-03-06"])]
    commits = spark.createDataFrame(rows, "repo string, path string, sha string, seq int, d string").withColumn("committed_at", F.to_timestamp("d"))
    base = spark.createDataFrame([("r", "2024-03-02")], "repo string, d string").select("repo", F.to_timestamp("d").alias("base_at"))
    assert sorted(r.sha for r in C.commits_for_file(commits, base).collect()) == ["0", "1", "3"]
    assert sorted(r.sha for r in C.commits_for_file(commits, base, strict=True).collect()) == ["0", "1"]
    assert C.commits_for_file(commits, base.limit(0), strict=True).count() == 4


def test_history(spark):
    rows = [("o/r", f"c{i}", "m.py", f"def f(): return {i // 2}\n", str(i // 2)) for i in range(4)]
    versions = spark.createDataFrame(rows, VERSIONS)
    commits = spark.createDataFrame([("o/r", f"c{i}", f"2024-01-0{i + 1}") for i in range(4)], "repo string, sha string, d string")
    files, defs = H.history(versions, commits.withColumn("committed_at", F.to_timestamp("d")))
    assert [(r.base_ref, r.head_ref) for r in files.collect()] == [("c1", "c2")]
    assert [(r.head_ref, r.name, r.change) for r in defs.collect()] == [("c2", "f", "modified")]
    assert [tuple(r) for r in C.repo_totals(files, defs).collect()] == [("o/r", "c1", "c2", 1, 1)]


# -- intervals and the parse store ------------------------------------------------------------------
def _commits(spark, n, repo="o/r"):
    rows = [(repo, f"c{i:03d}", i) for i in range(n)]
    return spark.createDataFrame(rows, "repo string, sha string, i int").select("repo", "sha", F.timestamp_seconds(F.col("i") * 40).alias("committed_at"))


def test_intervals_of_a_file_that_goes_and_comes_back(spark):
    states = ["x", "x", None, "x", "y", "y", None]
    rows = [("o/r", f"c{i:03d}", "m.py", f"{s} = 1\n", s) for i, s in enumerate(states) if s]
    rows += [("o/r", f"c{i:03d}", "k.py", "k = 1\n", None) for i in range(7)]
    got = C.version_intervals(spark.createDataFrame(rows, VERSIONS), _commits(spark, 7))
    assert sorted((r.path, r.blob_sha, r.valid_from, r.valid_to, r.before_ref, r.after_ref) for r in got.collect()) == [
        ("k.py", None, "c000", "c006", None, None),
        ("m.py", "x", "c000", "c001", None, "c002"),
        ("m.py", "x", "c003", "c003", "c002", "c004"),
        ("m.py", "y", "c004", "c005", "c003", "c006"),
    ]
    changes = C.interval_changes(got).collect()
    assert sorted((r.base_ref, r.head_ref, r.status, r.old_sha, r.new_sha) for r in changes) == [
        ("c001", "c002", "removed", "x", None), ("c002", "c003", "added", None, "x"),
        ("c003", "c004", "modified", "x", "y"), ("c005", "c006", "removed", "y", None),
    ]


def test_history_equals_pairwise_comparison(spark):
    import random

    pick = random.Random(3)
    rows = []
    for p in range(6):
        state = 0
        for i in range(40):
            state += pick.random() < 0.2
            if pick.random() < 0.9:
                rows.append(("o/r", f"c{i:03d}", f"m{p}.py", f"def f(): return {state % 3}\ndef g{state % 2}(): pass\n", None if p == 5 else f"b{state % 3}{state % 2}"))
    versions, commits = spark.createDataFrame(rows, VERSIONS), _commits(spark, 40)
    files, defs = H.history(versions, commits)
    plain = C.changed_files_of_pairs(versions, C.commit_pairs(commits))
    columns = sorted(plain.columns)
    assert sorted(map(tuple, files.select(columns).collect()), key=repr) == sorted(map(tuple, plain.select(columns).collect()), key=repr)
    want = C.definition_changes(plain)
    columns = sorted(want.columns)
    assert sorted(map(tuple, defs.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_changes_of_a_history_look_up_no_texts(spark):
    """Also where a side has no sha; texts settle only those pairs of which one side has a sha and the other none."""
    one, two = "def f(): return 1\n", "def f(): return 2\n"
    states = {
        "m.py": [(one, "x"), (two, "y"), (two, "y"), (one, "x")],
        "n.py": [(one, None), (two, None), (None, None), (one, None)],
        "k.py": [(one, "x"), (one, None), (two, "y"), (one, None)],
    }
    rows = [("o/r", f"c{i:03d}", path, *state) for path, of in states.items() for i, state in enumerate(of)]
    for paths in (["m.py", "n.py"], ["m.py", "n.py", "k.py"]):
        versions, commits = spark.createDataFrame([r for r in rows if r[2] in paths], VERSIONS), _commits(spark, 4)
        files, defs = H.history(versions, commits)
        if "k.py" not in paths:
            assert "content" not in defs._jdf.queryExecution().optimizedPlan().toString()
        plain = C.changed_files_of_pairs(versions, C.commit_pairs(commits))
        for got, want in ((files, plain), (defs, C.definition_changes(plain))):
            columns = sorted(want.columns)
            assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_a_blob_of_many_pairs_is_parsed_once(spark, tmp_path):
    blobs = {"s0": "def f(): return 0\n", "s1": "def f(): return 1\ndef f(): return 2\n"}
    rows = [("o/r", f"c{i:03d}", f"m{p}.py", blobs[f"s{i % 2}"], f"s{i % 2}") for i in range(101) for p in range(3)]
    versions = spark.createDataFrame(rows, VERSIONS)
    store = C.parse_store(versions, f"{tmp_path}/store")
    assert sorted((r.blob, len(r.defs), r.last_of_name) for r in store.collect()) == [("s0", 1, [0]), ("s1", 2, [1])]
    files, defs = H.history(versions, _commits(spark, 101))
    assert files.count() == 300 and defs.count() == 300
    assert "MapInArrow" not in defs._jdf.queryExecution().executedPlan().toString()
    # a later call parses what is new only
    more = spark.createDataFrame([("o/r", "c", "n.py", "def (", None), ("o/r", "c", "m.py", "never read", "s1")], VERSIONS)
    again = {r.blob: (r.defs, r.parse_error) for r in C.parse_store(more, f"{tmp_path}/store").collect()}
    assert len(again) == 3 and len(again["s1"][0]) == 2 and [e for d, e in again.values() if e]


def test_definitions_from_store(spark, versions):
    want = C.definitions(C.python_files(versions))
    got = C.definitions_from_store(versions, C.parse_store(versions))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_changes_from_store_by_qualified_name(spark, versions):
    files = C.changed_files(versions, "a", "b")
    want, got = C.file_definition_changes(files, "qualname"), C.definition_changes_from_store(files, C.parse_store(versions), "qualname")
    rows = [sorted(((r.path, sorted(map(tuple, r.changes), key=repr)) for r in df.collect()), key=repr) for df in (want, got)]
    assert rows[0] == rows[1]


def test_commits_of_pairs_against_all_pairs(spark):
    import datetime as dt
    import random

    pick, start = random.Random(5), dt.datetime(2024, 1, 1)
    commits = [("r", f"c{i}", start + dt.timedelta(seconds=pick.choice((30, 4000)) * pick.randrange(60))) for i in range(80)] + [("q", "one", start)]
    asked = [(r, f"a{i}", start + dt.timedelta(seconds=pick.randrange(-500, 250_000))) for i in range(200) for r in ("r", "q")]
    schema = "repo string, sha string, committed_at timestamp"
    pairs = C.commit_pairs(spark.createDataFrame(commits, schema))
    got = C.commits_of_pairs(spark.createDataFrame(asked + commits, schema), pairs)
    spans = pairs.collect()
    want = sorted((c[1], p.head_ref) for c in asked + commits for p in spans if p.repo == c[0] and p.base_at < c[2] <= p.head_at)
    assert sorted((r.sha, r.head_ref) for r in got.collect()) == want and want


def test_related_commits_of_history_equal_the_general_join(spark):
    rows = [("o/r", f"c{i:03d}", "m.py", f"x = {i // 2}\n", str(i // 2)) for i in range(12)]
    versions, commits = spark.createDataFrame(rows, VERSIONS), _commits(spark, 12)
    person = F.struct(F.lit("A").alias("name"), F.lit("a@x").alias("email"))
    told = commits.withColumns({"path": F.lit("m.py"), "message": F.lit("m"), "author": person, "committer": person})
    files, pairs = C.history_files(versions, commits), C.commit_pairs(commits)
    want, got = C.related_commits(files, told, pairs), C.related_commits_of_history(files, told, pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.count() == 5
