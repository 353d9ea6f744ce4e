"""Queries over file versions and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.tables import commits, derived
from pagespark.operators import code as C
from pagespark.plans import history as H


def _versions(spark, sf):
    return derived(spark, sf, "file_versions")


def _files(spark, sf):
    return C.changed_files(_versions(spark, sf), "base", "head")


def _changes(spark, sf):
    return C.definition_changes(_files(spark, sf))


_SHORT = ["repo", "path", "name", "change", "node_type"]


@query("python_files", "SELECT repo, ref, path FROM file_versions WHERE path LIKE '%.py'")
def _(spark, sf):
    return C.python_files(_versions(spark, sf)).select("repo", "ref", "path")


@query("changed_files", "SELECT *, CAST(NULL AS VARCHAR) AS error FROM files")
def _(spark, sf):
    return _files(spark, sf)


@query(
    "definitions",
    """SELECT repo, ref, path, name, name AS qualname, node_type, code AS source_code, CASE WHEN decorated THEN 'cache' ELSE '' END AS decorators, doc AS docstring,
      CAST(row_number() OVER (PARTITION BY repo, ref, path ORDER BY p_partkey) - 1 AS INT) AS ord,
      CAST(before + CASE WHEN decorated THEN 1 ELSE 0 END AS INT) AS start_line,
      CAST(before + CASE WHEN decorated THEN 1 ELSE 0 END + length(code) - length(replace(code, chr(10), '')) AS INT) AS end_line
    FROM (SELECT *, coalesce(sum(length(src) - length(replace(src, chr(10), '')) + 1) OVER (PARTITION BY repo, ref, path ORDER BY p_partkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM py_functions WHERE NOT broken) f""",
)
def _(spark, sf):
    found = C.definitions(C.python_files(_versions(spark, sf)))
    return found.withColumn("decorators", F.array_join("decorators", ","))


@query("parse_errors", "SELECT DISTINCT repo, ref, path FROM py_functions WHERE broken")
def _(spark, sf):
    return C.parse_errors(C.python_files(_versions(spark, sf))).select("repo", "ref", "path")


@query("changed_definitions", "SELECT repo, path, name, change, node_type, old_code, new_code FROM changes")
def _(spark, sf):
    renamed = {"old_source_code": "old_code", "new_source_code": "new_code"}
    return _changes(spark, sf).withColumnsRenamed(renamed).select(*_SHORT, "old_code", "new_code")


@query(
    "changed_definitions_of_tables",
    """SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, coalesce(o.name, n.name) AS name,
      CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM (SELECT * FROM py_functions WHERE ref = 'base' AND NOT broken) o
    FULL JOIN (SELECT * FROM py_functions WHERE ref = 'head' AND NOT broken) n ON o.repo = n.repo AND o.path = n.path AND o.name = n.name
    WHERE o.code IS DISTINCT FROM n.code""",
)
def _(spark, sf):
    py = C.python_files(_versions(spark, sf))
    old, new = (C.definitions(py.filter(F.col("ref") == r)).drop("ref") for r in ("base", "head"))
    return C.changed_definitions(old, new, key="qualname").select("repo", "path", "name", "change")


@query(
    "added_definitions",
    "SELECT repo, path, name, node_type, CASE WHEN decorated THEN 'cache' ELSE '' END AS decorators FROM changes WHERE change = 'added'",
)
def _(spark, sf):
    added = C.filter_changes(_changes(spark, sf), "added")
    return added.select("repo", "path", "name", "node_type", F.array_join("decorators", ",").alias("decorators"))


@query("valid_repositories", "SELECT DISTINCT repo FROM file_versions WHERE contains(repo, '/')")
def _(spark, sf):
    return C.valid_repos(_versions(spark, sf).select("repo").distinct())


@query("repository_totals", "SELECT * FROM totals")
def _(spark, sf):
    return C.repo_totals_of(_files(spark, sf))


@query("repository_totals_of_tables", "SELECT * FROM totals")
def _(spark, sf):
    files = _files(spark, sf)
    return C.repo_totals(files, C.definition_changes(files))


@query(
    "overall_totals",
    """SELECT count(*) AS repositories, CAST(sum(files_changed) AS BIGINT) AS files_changed, CAST(sum(definitions_changed) AS BIGINT) AS definitions_changed
    FROM totals WHERE contains(repo, '/')""",
)
def _(spark, sf):
    files = C.changed_files(C.valid_repos(_versions(spark, sf)), "base", "head")
    return C.overall_totals(C.repo_totals_of(files))


@query(
    "change_report",
    """SELECT c.repo, c.path, c.name, c.change, c.node_type, f.status, f.old_sha, f.new_sha, t.files_changed AS repo_files_changed,
      t.definitions_changed AS repo_definitions_changed, a.repositories AS all_repositories, a.files_changed AS all_files_changed,
      a.definitions_changed AS all_definitions_changed
    FROM changes c JOIN files f ON c.repo = f.repo AND c.path = f.path JOIN totals t ON c.repo = t.repo
    CROSS JOIN (SELECT count(*) AS repositories, CAST(sum(files_changed) AS BIGINT) AS files_changed, CAST(sum(definitions_changed) AS BIGINT) AS definitions_changed FROM totals) a""",
)
def _(spark, sf):
    report = H.report(_files(spark, sf))
    shown = [c for c in report.columns if c.startswith(("repo_", "all_"))]
    return report.select(*_SHORT, "status", "old_sha", "new_sha", *shown)


# -- commits -----------------------------------------------------------------------------------
@query(
    "commits_after_base",
    """SELECT c.repo, c.path, c.sha FROM commits c LEFT JOIN base_dates b ON c.repo = b.repo WHERE b.base_at IS NULL OR c.committed_at > b.base_at""",
)
def _(spark, sf):
    found = C.commits_for_file(commits(spark, sf), derived(spark, sf, "base_dates"))
    return found.select("repo", "path", "sha")


@query(
    "commits_until_base",
    """SELECT repo, path, sha FROM (SELECT c.repo, c.path, c.sha, max(CASE WHEN c.committed_at <= b.base_at THEN 1 ELSE 0 END)
      OVER (PARTITION BY c.repo, c.path ORDER BY c.seq) AS ended FROM commits c LEFT JOIN base_dates b ON c.repo = b.repo) s WHERE ended = 0""",
)
def _(spark, sf):
    found = C.commits_for_file(commits(spark, sf), derived(spark, sf, "base_dates"), strict=True)
    return found.select("repo", "path", "sha")


@query(
    "commits_in_range",
    """SELECT repo, sha FROM commits WHERE committed_at >= TIMESTAMP '1996-01-01' AND committed_at <= TIMESTAMP '1998-12-31' AND path = 'pkg/1-URGENT.py'""",
)
def _(spark, sf):
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1998-12-31"))
    return C.commits_in_range(commits(spark, sf), since, until, "pkg/1-URGENT.py").select("repo", "sha")


@query("commit_pairs", "SELECT * FROM pairs")
def _(spark, sf):
    return C.commit_pairs(commits(spark, sf))


# each derived commit is given the two refs of the file table in turn
@query(
    "history_changes",
    """SELECT p.head_ref AS head_commit, c.repo, c.path, c.name, CASE WHEN p.forward OR c.change = 'modified' THEN c.change WHEN c.change = 'added' THEN 'removed' ELSE 'added' END AS change
      FROM (SELECT repo, head_ref, CAST(head_ref AS BIGINT) % 2 = 0 AS forward FROM pairs WHERE CAST(head_ref AS BIGINT) % 2 <> CAST(base_ref AS BIGINT) % 2) p
      JOIN changes c ON p.repo = c.repo""",
)
def _(spark, sf):
    found = H.history(_history_versions(spark, sf), commits(spark, sf))[1]
    return found.select(F.col("head_ref").alias("head_commit"), "repo", "path", "name", "change")


def _history_versions(spark, sf):
    """Versions per commit: even commits hold the head state of their repository, odd ones the base state."""
    refs = commits(spark, sf).select("repo", "sha").distinct()
    state = F.when(F.col("sha").cast("long") % 2 == 0, "head").otherwise("base")
    held = refs.withColumn("ref", state).join(_versions(spark, sf), ["repo", "ref"])
    return held.drop("ref").withColumnRenamed("sha", "ref")


_HELD = """SELECT v.repo, v.path, v.blob_sha, c.sha, c.committed_at, c.before_ref, c.after_ref, c.place FROM (
        SELECT repo, sha, committed_at, lag(sha) OVER w AS before_ref, lead(sha) OVER w AS after_ref, row_number() OVER w AS place
        FROM commits WINDOW w AS (PARTITION BY repo ORDER BY committed_at, sha)) c
      JOIN file_versions v ON v.repo = c.repo AND v.ref = CASE WHEN CAST(c.sha AS BIGINT) % 2 = 0 THEN 'head' ELSE 'base' END WHERE v.path LIKE '%.py'"""


@query(
    "version_intervals",
    f"""SELECT repo, path, blob_sha, arg_min(sha, place) AS valid_from, arg_max(sha, place) AS valid_to, min(committed_at) AS from_at, max(committed_at) AS to_at,
      arg_min(coalesce(before_ref, ''), place) AS before_ref, arg_max(coalesce(after_ref, ''), place) AS after_ref
    FROM (SELECT *, place - row_number() OVER (PARTITION BY repo, path, blob_sha ORDER BY place) AS run FROM ({_HELD}) h) r GROUP BY repo, path, blob_sha, run""",
)
def _(spark, sf):
    found = C.version_intervals(_history_versions(spark, sf), commits(spark, sf)).drop("digest")
    return found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before_ref", "after_ref")})


@query(
    "definitions_by_blob",
    """SELECT blob_sha, any_value(defs) AS n_definitions FROM (
      SELECT v.repo, v.ref, v.path, any_value(v.blob_sha) AS blob_sha, count(f.name) AS defs FROM file_versions v
      LEFT JOIN (SELECT * FROM py_functions WHERE NOT broken) f ON f.repo = v.repo AND f.ref = v.ref AND f.path = v.path
      WHERE v.path LIKE '%.py' GROUP BY v.repo, v.ref, v.path) d GROUP BY blob_sha""",
)
def _(spark, sf):
    store = C.parse_store(_versions(spark, sf))
    return store.select(F.col("blob").alias("blob_sha"), F.size("defs").cast("long").alias("n_definitions"))


@query(
    "commits_of_pairs",
    """SELECT c.repo, c.sha, p.base_ref, p.head_ref FROM commits c JOIN pairs p ON p.repo = c.repo AND p.base_at < c.committed_at AND c.committed_at <= p.head_at""",
)
def _(spark, sf):
    found = C.commits_of_pairs(commits(spark, sf), C.commit_pairs(commits(spark, sf)))
    return found.select("repo", "sha", "base_ref", "head_ref")


@query(
    "history_related_commits",
    """SELECT p.repo, p.base_ref, p.head_ref, f.path, c.sha FROM (
        SELECT *, CAST(regexp_extract(repo, '([0-9]+)$', 1) AS BIGINT) AS k FROM pairs WHERE CAST(head_ref AS BIGINT) % 2 <> CAST(base_ref AS BIGINT) % 2) p
      JOIN files f ON f.repo = p.repo AND f.path = concat('pkg/d', p.k // 10, '/m', p.k * 10 + 1, '.py')
      JOIN commits c ON c.repo = p.repo AND p.base_at < c.committed_at AND c.committed_at <= p.head_at""",
)
def _(spark, sf):
    pairs = C.commit_pairs(commits(spark, sf))
    files = C.interval_changes(C.version_intervals(_history_versions(spark, sf), commits(spark, sf)))
    return C.related_commits_of_history(files, _related(spark, sf), pairs).drop("committed_at", "text")


# -- lines and texts ---------------------------------------------------------------------------------
@query("line_status")
def _(spark, sf):
    return C.line_status(_files(spark, sf))


@query(
    "line_counts",
    """SELECT repo, path, CASE WHEN status = 'removed' THEN 0 ELSE CAST(length(new_content) - length(replace(new_content, chr(10), ''))
      + CASE WHEN new_content LIKE '%' || chr(10) THEN 0 ELSE 1 END AS INT) END AS new_lines,
      CASE WHEN status = 'added' THEN 0 ELSE CAST(length(old_content) - length(replace(old_content, chr(10), '')) AS INT) END AS old_lines FROM files""",
)
def _(spark, sf):
    lines = C.line_status(_files(spark, sf)).groupBy("repo", "path")
    sides = [F.count_if(F.col("side") == s).cast("int").alias(f"{s}_lines") for s in ("new", "old")]
    return lines.agg(*sides)


@query("change_summary")
def _(spark, sf):
    return C.change_summary(_files(spark, sf))


@query("annotated_old_files")
def _(spark, sf):
    return C.annotate(_files(spark, sf), "old", "comment")


@query("annotated_new_files_html")
def _(spark, sf):
    return C.annotate(_files(spark, sf), "new", "html")


@query("annotated_old_files_unmarked", "SELECT repo, path, rtrim(old_content, chr(10)) AS text FROM files")
def _(spark, sf):
    files = C.annotate(_files(spark, sf), "old", "inline")
    plain = F.regexp_replace("annotated", r"(?m)^>>> \[(CHANGED|REMOVED)\] ", "")
    return files.select("repo", "path", F.rtrim(plain, F.lit("\n")).alias("text"))


@query("annotated_new_files_unmarked", "SELECT repo, path, rtrim(new_content, chr(10)) AS text FROM files")
def _(spark, sf):
    files = C.annotate(_files(spark, sf), "new", "html")
    body = F.regexp_replace("annotated", r"\n        </pre>[\s\S]*$", "")
    plain = F.regexp_replace(body, r'(?m)^<span class="(changed|added|unchanged)-line">|</span>$', "")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(safe), F.lit(raw))
    return files.select("repo", "path", F.rtrim(plain, F.lit("\n")).alias("text"))


_DECORATED = "CASE WHEN decorated THEN '[''cache'']' ELSE '[]' END"
_BAR, _DASH = "repeat('=', 80)", "repeat('-', 40)"


def _one_sided(status: str, side: str) -> str:
    doc = f"nullif(regexp_extract({side}_code, '\"\"\"(Doc [0-9]+)\"\"\"', 1), '')"
    return f"""concat_ws(chr(10), 'STATUS: {status}', concat('Decorators: ', {_DECORATED}),
      CASE WHEN {doc} IS NOT NULL THEN concat('Docstring: ', {doc}) END, concat(chr(10), '{side.upper()} VERSION:'), {_DASH}, {side}_code)"""


@query(
    "side_by_side",
    f"""SELECT repo, path, name, concat_ws(chr(10), concat(chr(10), {_BAR}), concat(upper(node_type), ': ', name), {_BAR},
      CASE change WHEN 'added' THEN {_one_sided('ADDED', 'new')} WHEN 'removed' THEN {_one_sided('REMOVED', 'old')}
      ELSE concat_ws(chr(10), 'STATUS: MODIFIED', concat('Old decorators: ', {_DECORATED}), concat('New decorators: ', {_DECORATED}),
        concat(chr(10), 'OLD VERSION:'), {_DASH}, old_code, concat(chr(10), 'NEW VERSION:'), {_DASH}, new_code) END) AS comparison FROM changes""",
)
def _(spark, sf):
    return C.side_by_side(_changes(spark, sf)).select("repo", "path", "name", "comparison")


def _prefixed(side: str, sign: str) -> str:
    return f"'{sign}' || replace({side}_code, chr(10), chr(10) || '{sign}')"


_N_LINES = "(length({0}_code) - length(replace({0}_code, chr(10), '')) + 1)"
_HUNK = (
    f"CASE change WHEN 'added' THEN '@@ -0,0 +1,' || {_N_LINES.format('new')} || ' @@' "
    f"WHEN 'removed' THEN '@@ -1,' || {_N_LINES.format('old')} || ' +0,0 @@' "
    f"ELSE '@@ -1,' || {_N_LINES.format('old')} || ' +1,' || {_N_LINES.format('new')} || ' @@' END"
)
# the derived changes only ever touch the last line of a function
_BODY = (
    f"CASE change WHEN 'added' THEN {_prefixed('new', '+')} WHEN 'removed' THEN {_prefixed('old', '-')} "
    "ELSE regexp_replace(' ' || replace(old_code, chr(10), chr(10) || ' '), '\\n [^\\n]*$', '') || chr(10) || "
    "'-    return x + 1' || chr(10) || '+    return x + 2' END"
)


@query(
    "unified_diffs",
    f"""SELECT repo, path, name, concat_ws(chr(10), concat('--- ', path, ' (old) - ', node_type, ': ', name), concat('+++ ', path, ' (new) - ', node_type, ': ', name),
    {_HUNK}, {_BODY}) AS diff FROM changes""",
)
def _(spark, sf):
    return C.unified_diff(_changes(spark, sf)).select("repo", "path", "name", "diff")


def _related(spark, sf):
    """Commits of the derived orders, laid onto the first file of the repository they belong to."""
    c = commits(spark, sf)
    number = F.regexp_extract("repo", r"(\d+)$", 1).cast("long")
    path = F.concat(F.lit("pkg/d"), F.floor(number / 10), F.lit("/m"), number * 10 + 1, F.lit(".py"))
    return c.withColumn("path", path)


def _bounds(spark, sf):
    """From the base commit of each repository to the newest of its even commits."""
    head = F.max(F.when(F.col("seq") % 2 == 0, F.col("committed_at"))).alias("head_at")
    heads = commits(spark, sf).groupBy("repo").agg(head)
    return heads.join(derived(spark, sf, "base_dates"), "repo", "left")


_BETWEEN = """SELECT f.repo, f.path, m.* EXCLUDE (repo, path) FROM files f JOIN (
        SELECT *, CAST(regexp_extract(repo, '([0-9]+)$', 1) AS BIGINT) AS k FROM commits) m
        ON f.repo = m.repo AND f.path = concat('pkg/d', m.k // 10, '/m', m.k * 10 + 1, '.py')
      LEFT JOIN base_dates b ON f.repo = b.repo
      LEFT JOIN (SELECT repo, max(CASE WHEN seq % 2 = 0 THEN committed_at END) AS head_at FROM commits GROUP BY repo) h ON f.repo = h.repo
      WHERE (b.base_at IS NULL OR m.committed_at > b.base_at) AND (h.head_at IS NULL OR m.committed_at <= h.head_at)"""


@query(
    "related_commits",
    f"""SELECT repo, path, sha, concat('# Commit: ', substr(sha, 1, 8), chr(10), '# Date: ',
        strftime(committed_at, '%Y-%m-%dT%H:%M:%SZ'), chr(10), '# Author: ', author_name, ' <', replace(author_name, ' ', '.'), '@example.org>', chr(10),
        CASE WHEN author_name <> committer_name THEN concat('# Committer: ', committer_name, ' <', replace(committer_name, ' ', '.'), '@example.org>', chr(10)) ELSE '' END,
        '# Message: order ', sha, chr(10), '#          ', regexp_extract(message, 'total .*$'), chr(10), '#', chr(10)) AS text FROM ({_BETWEEN}) r""",
)
def _(spark, sf):
    return C.related_commits(_files(spark, sf), _related(spark, sf), _bounds(spark, sf)).drop("committed_at")


@query(
    "diff_headers",
    f"""SELECT c.repo, c.path, c.name, concat('# Diff for ', c.node_type, ': ', c.name, chr(10), '# File: ', c.path, chr(10), '# Repository: ', c.repo, chr(10),
      '# Status: ', f.status, chr(10), CASE WHEN c.change <> 'added' THEN concat('# Old SHA: ', coalesce(f.old_sha, 'None'), chr(10)) ELSE '' END,
      CASE WHEN c.change <> 'removed' THEN concat('# New SHA: ', coalesce(f.new_sha, 'None'), chr(10)) ELSE '' END,
      CASE WHEN r.n > 0 THEN concat('# Related commits: ', r.n, chr(10)) ELSE '' END, '#', repeat('=', 60), chr(10)) AS header
    FROM changes c JOIN files f ON c.repo = f.repo AND c.path = f.path
    LEFT JOIN (SELECT repo, path, count(*) AS n FROM ({_BETWEEN}) r GROUP BY repo, path) r ON c.repo = r.repo AND c.path = r.path""",
)
def _(spark, sf):
    files = _files(spark, sf)
    related = C.related_commits(files, _related(spark, sf), _bounds(spark, sf))
    return C.diff_header(C.definition_changes(files), files, related).select("repo", "path", "name", "header")
