"""Code-change analysis over tables of file versions and commits.

A file is one row.  The kernels add arrays to that row, so annotating and counting lines
are projections; only matching definitions by name, joining versions and totals shuffle,
on keys as fine as (repo, path[, name]).  Repository totals combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from pagespark.functions.keyfilter import key_filter, might_hold
from pagespark.functions.scalars import escape_html
from pagespark.operators import code_kernels as K
from pagespark.operators.dom import spread
from pagespark.operators.order import BUCKETS, neighbours
from pagespark.sources.shared import written

DEFINITION_DDL = (
    "ord int, name string, qualname string, node_type string, start_line int, end_line int, source_code string, "
    "decorators array<string>, docstring string"
)
DEFINITION_FIELDS = [part.split()[0] for part in DEFINITION_DDL.split(", ")]
LINE_DDL = "side string, line_no int, status string, mapped_line int, line string"


def file_keys(df: DataFrame) -> list[str]:
    return [c for c in ("repo", "base_ref", "head_ref", "ref", "path") if c in df.columns]


def _arrow_type(ddl: str) -> pa.DataType:
    names = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.list_(pa.struct([(f.name, names[f.dataType.simpleString()]) for f in T.StructType.fromDDL(ddl)]))


_CHUNK_CHARS = 4_000_000


def _add_columns(
    df: DataFrame, made: dict[str, str], inputs: list[str], fn: Callable[..., tuple], keep_inputs: bool = False
) -> DataFrame:
    """Append kernel results as columns, yielding small batches: ``fn`` gets the inputs of one row.

    The input texts do not travel back from Python unless they are kept.
    """
    kept = [c for c in df.columns if keep_inputs or c not in inputs]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(k, T.DataType.fromDDL(v)) for k, v in made.items()])
    arrow = {k: _arrow_type(v[len("array<struct<") : -2]) if v.startswith("array<struct") else {"array<int>": pa.list_(pa.int32())}.get(v, pa.string())
             for k, v in made.items()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            first = 0
            while first < batch.num_rows:
                rows, chars, last = [], 0, first
                while last < batch.num_rows and chars < _CHUNK_CHARS:
                    values = [c[last].as_py() for c in columns]
                    chars += sum(len(v or "") for v in values)
                    rows.append(fn(*values))
                    last += 1
                part = batch.slice(first, last - first)
                arrays = [part.column(batch.schema.get_field_index(c)) for c in kept]
                arrays += [pa.array([r[i] for r in rows], type=arrow[k]) for i, k in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *made])
                first = last

    keys = [c for c in file_keys(df)] or inputs
    return spread(df, keys).mapInArrow(kernel, schema)


def python_files(df: DataFrame) -> DataFrame:
    return df.filter(F.endswith("path", F.lit(".py")))


# -- files between two refs ---------------------------------------------------------------
def _marks(versions: DataFrame, side: str) -> DataFrame:
    """What tells a file's versions apart: the blob's sha or, without one, a digest of the content."""
    sha = F.col("blob_sha") if "blob_sha" in versions.columns else F.lit(None).cast("string")
    digest = F.when(sha.isNull(), F.sha2(F.col("content"), 256))
    return versions.select(
        "repo", "ref", "path", sha.alias(f"{side}_sha"), digest.alias(f"{side}_digest"), F.lit(True).alias(side)
    )


def _both_sides(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """``changed`` (base_ref, head_ref) with the texts of both sides. Versions whose key is not marked stay where they are read."""
    found = changed
    for side, ref in (("old", "base_ref"), ("new", "head_ref")):
        keys = ["repo", ref, "path"]
        texts = versions.select("repo", F.col("ref").alias(ref), "path", F.col("content").alias(f"{side}_content"))
        found = found.join(might_hold(texts, key_filter(changed, keys), keys), keys, "left")
    return found


_SAME = "coalesce(old_sha = new_sha, old_digest <=> new_digest)"
#: Marks cannot tell a sha from a digest: only texts say whether these files differ.
_MIXED = "old and new and (old_sha is null) <> (new_sha is null)"
_STATUS = "case when old is null then 'added' when new is null then 'removed' else 'modified' end"


def _between(py: DataFrame, base: str, head: str) -> DataFrame:
    """Files that differ between two refs, without texts: one scan, one exchange of marks combined before they move."""
    marks = _marks(py.filter(F.col("ref").isin(base, head)), "mark")
    sides = []
    for side, ref in (("old", base), ("new", head)):
        mine = F.col("ref") == ref
        sides += [F.max(F.when(mine, F.col(c))).alias(c.replace("mark", side)) for c in ("mark_sha", "mark_digest", "mark")]
    found = marks.groupBy("repo", "path").agg(*sides)
    return found.filter(f"not coalesce(old and new and {_SAME}, false)").withColumn("status", F.expr(_STATUS))


def _differ(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose marks differ: keys, status, shas, and which sides are there.  No text takes part."""
    return old.join(new, keys, "full_outer").filter(f"not coalesce(old and new and {_SAME}, false)").withColumn("status", F.expr(_STATUS))


def _with_texts(changed: DataFrame) -> DataFrame:
    """Settle what marks could not, report sides whose bytes were no text, and tidy up."""
    alike = F.coalesce(F.expr(_MIXED) & F.col("old_content").eqNullSafe(F.col("new_content")), F.lit(False))
    errors = [
        F.when(F.col(side) & F.col(f"{side}_content").isNull(), F.lit(f"{side} content is not text")) for side in ("old", "new")
    ]
    return (
        changed.filter(~alike)
        .withColumn("error", F.nullif(F.concat_ws("; ", *errors), F.lit("")))
        .withColumn("old_content", F.coalesce("old_content", F.lit("")))
        .withColumn("new_content", F.coalesce("new_content", F.lit("")))
        .drop("old", "new", "old_digest", "new_digest")
    )


def changed_files(versions: DataFrame, base: str, head: str) -> DataFrame:
    """Python files that differ between two refs of each repository; an absent side is empty text, NULL sha.

    Versions are compared by sha or digest first; a bit map of the files that differ is asked at the second
    scan, so only their texts move.  A file whose content is no text (NULL) is a row with the reason in ``error``.
    """
    py = python_files(versions)
    changed = _between(py, base, head)
    keys = ["repo", "path"]
    texts = might_hold(py.filter(F.col("ref").isin(base, head)).select(*keys, "ref", "content"), key_filter(changed, keys), keys)
    sides = [F.max(F.when(F.col("ref") == ref, F.col("content"))).alias(f"{side}_content") for side, ref in (("old", base), ("new", head))]
    # both are grouped by file already: a merge costs no exchange, and texts are never broadcast
    return _with_texts(changed.join(texts.groupBy(*keys).agg(*sides).hint("merge"), keys, "left"))


def changed_files_of_pairs(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for many (repo, base_ref, head_ref) at once."""
    py = python_files(versions)
    keys = ["repo", "base_ref", "head_ref"]
    refs = pairs.select(*keys)
    old = refs.join(_marks(py, "old").withColumnRenamed("ref", "base_ref"), ["repo", "base_ref"])
    new = refs.join(_marks(py, "new").withColumnRenamed("ref", "head_ref"), ["repo", "head_ref"])
    changed = _differ(old, new, [*keys, "path"])
    return _with_texts(_both_sides(changed, py))


def changed_files_listed(comparison: DataFrame, contents: DataFrame) -> DataFrame:
    """Files listed by a ref comparison (repo, base_ref, head_ref, path, status), with their contents.

    The given status decides which sides are looked up.  A side without stored contents is empty;
    one whose stored content is no text is empty and named in ``error``.
    """
    py = python_files(comparison)
    sides = py
    for side, ref in (("old", "base_ref"), ("new", "head_ref")):
        stored = contents.select(
            "repo", F.col("ref").alias(ref), "path", F.col("content").alias(f"{side}_content"),
            (F.col("blob_sha") if "blob_sha" in contents.columns else F.lit(None).cast("string")).alias(f"{side}_sha"),
            F.lit(True).alias(side),
        )
        sides = sides.join(stored, ["repo", ref, "path"], "left")
    had, has = F.col("status") != "added", F.col("status") != "removed"
    bad = [
        F.when(used & F.col(side) & F.col(f"{side}_content").isNull(), F.lit(f"{side} content is not text"))
        for side, used in (("old", had), ("new", has))
    ]
    return sides.select(
        "repo", "base_ref", "head_ref", "path", "status",
        F.coalesce(F.when(had, F.col("old_content")), F.lit("")).alias("old_content"),
        F.coalesce(F.when(has, F.col("new_content")), F.lit("")).alias("new_content"),
        F.when(had, F.col("old_sha")).alias("old_sha"),
        F.when(has, F.col("new_sha")).alias("new_sha"),
        F.nullif(F.concat_ws("; ", *bad), F.lit("")).alias("error"),
    )


# -- definitions ------------------------------------------------------------------------------
def parse_sources(versions: DataFrame) -> DataFrame:
    """Replace ``content`` by ``defs`` (array of definitions) and ``parse_error``."""
    made = {"defs": f"array<struct<{DEFINITION_DDL}>>", "parse_error": "string"}
    return _add_columns(versions, made, ["content"], K.definitions_of)


def definitions(versions: DataFrame) -> DataFrame:
    parsed = parse_sources(versions)
    return parsed.select(*file_keys(parsed), F.inline("defs"))


def parse_errors(versions: DataFrame) -> DataFrame:
    parsed = parse_sources(versions)
    return parsed.filter(F.col("parse_error").isNotNull()).select(*file_keys(parsed), "parse_error")


def _last_of_each(key: str):
    """Kernel: definitions of both sides of a file, of each key the last."""

    def sides(old: str | None, new: str | None):
        return tuple(list({d[key]: d for d in K.definitions_of(text)[0]}.values()) for text in (old, new))

    return sides


def file_definition_changes(file_changes: DataFrame, key: str = "name") -> DataFrame:
    """Changed files without their texts, with ``changes``: their added, removed and modified definitions.

    Both sides of a file are in its row, so they are paired there; nothing is shuffled.
    """
    ddl = f"array<struct<{DEFINITION_DDL}>>"
    return _paired(_add_columns(file_changes, {"old_defs": ddl, "new_defs": ddl}, ["old_content", "new_content"], _last_of_each(key)), key)


def _paired(parsed: DataFrame, key: str) -> DataFrame:
    """Replace ``old_defs`` and ``new_defs``, where a key stands once, by ``changes``."""

    def by_key(side: str) -> Column:
        return F.map_from_arrays(F.transform(f"{side}_defs", lambda d: d[key]), F.col(f"{side}_defs"))

    paired = F.map_entries(F.map_zip_with(by_key("old"), by_key("new"), lambda k, o, n: F.struct(o.alias("old"), n.alias("new"))))
    differ = F.filter(paired, lambda e: ~e["value"]["old"]["source_code"].eqNullSafe(e["value"]["new"]["source_code"]))

    def change(e: Column) -> Column:
        old, new = e["value"]["old"], e["value"]["new"]
        return F.struct(
            e["key"].alias(key),
            *([] if key == "name" else [F.coalesce(new["name"], old["name"]).alias("name")]),
            F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("modified").alias("change"),
            F.coalesce(new["node_type"], old["node_type"]).alias("node_type"),
            *[d[f].alias(f"{side}_{f}") for side, d in (("old", old), ("new", new))
              for f in ("source_code", "decorators", "docstring", "start_line", "end_line")],
        )

    return parsed.withColumn("changes", F.transform(differ, change)).drop("old_defs", "new_defs")


def changed_definitions(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Added, removed and modified definitions, matched by ``key`` within a file; the last of a name wins."""
    sides = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    return match_definitions(sides, key)


def match_definitions(sides: DataFrame, key: str = "name") -> DataFrame:
    """One grouping by (file, key) both picks the last definition of each side and pairs the sides."""
    keys = [c for c in file_keys(sides) if c != "ref"]
    whole = F.struct("node_type", "start_line", "end_line", "source_code", "decorators", "docstring", "name")

    def last(side: str) -> Column:
        return F.max_by(whole, F.when(F.col("side") == side, F.col("ord"))).alias(side)

    grouped = sides.groupBy(*keys, F.col(key).alias("key")).agg(last("old"), last("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return grouped.filter(~F.col("old.source_code").eqNullSafe(F.col("new.source_code"))).select(
        *keys,
        F.col("key").alias(key),
        *([] if key == "name" else [F.coalesce("new.name", "old.name").alias("name")]),
        change.alias("change"),
        F.coalesce("new.node_type", "old.node_type").alias("node_type"),
        *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("old", "new")
          for f in ("source_code", "decorators", "docstring", "start_line", "end_line")],
    )


def definition_changes(file_changes: DataFrame, key: str = "name") -> DataFrame:
    """One row per changed definition of changed files; the last of a key in a file wins."""
    keys = [c for c in file_keys(file_changes) if c != "ref"]
    found = file_definition_changes(file_changes.select(*keys, "old_content", "new_content"), key)
    return found.select(*keys, F.inline("changes"))


def filter_changes(def_changes: DataFrame, kind: str) -> DataFrame:
    kept = def_changes.filter(F.col("change") == kind)
    shown = F.coalesce("new_decorators", "old_decorators")
    return kept.withColumn("decorators", shown)


# -- totals ------------------------------------------------------------------------------------
def valid_repos(df: DataFrame) -> DataFrame:
    return df.filter(F.contains("repo", F.lit("/")))


def repo_totals(file_changes: DataFrame, def_changes: DataFrame) -> DataFrame:
    """Files and definitions changed per repository (and ref pair); zero where a repository has none."""
    keys = [k for k in file_keys(file_changes) if k not in ("path", "ref")]
    files = file_changes.groupBy(*keys).agg(F.count("*").alias("files_changed"))
    defs = def_changes.groupBy(*keys).agg(F.count("*").alias("definitions_changed"))
    return files.join(defs, keys, "left").withColumn(
        "definitions_changed", F.coalesce("definitions_changed", F.lit(0))
    )


def repo_totals_of(file_changes: DataFrame, key: str = "name") -> DataFrame:
    """The same straight from changed files: counts are made in a file's row, and one grouping adds them up."""
    keys = [k for k in file_keys(file_changes) if k != "ref"]
    return totals_of_files(file_definition_changes(file_changes.select(*keys, "old_content", "new_content"), key))


def totals_of_files(changes_of_files: DataFrame) -> DataFrame:
    """Totals per repository (and ref pair) of what ``file_definition_changes`` gives."""
    return changes_of_files.groupBy(*[k for k in file_keys(changes_of_files) if k not in ("path", "ref")]).agg(
        F.count("*").alias("files_changed"), F.sum(F.size("changes").cast("long")).alias("definitions_changed")
    )


def overall_totals(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.count("*").alias("repositories"),
        F.coalesce(F.sum("files_changed"), F.lit(0)).alias("files_changed"),
        F.coalesce(F.sum("definitions_changed"), F.lit(0)).alias("definitions_changed"),
    )


def change_report(changes_of_files: DataFrame) -> DataFrame:
    """One row per changed definition with its file's status and shas, repository and overall totals.

    Takes what ``file_definition_changes`` gives; detail and totals both come from it.
    """
    totals = totals_of_files(changes_of_files)
    repo_keys = [k for k in file_keys(changes_of_files) if k != "path"]
    overall = overall_totals(totals)
    named = totals.select(
        *repo_keys,
        F.col("files_changed").alias("repo_files_changed"),
        F.col("definitions_changed").alias("repo_definitions_changed"),
        overall.select(F.struct("*")).scalar().alias("all"),
    ).select("*", *[F.col(f"all.{c}").alias(f"all_{c}") for c in overall.columns]).drop("all")
    rows = changes_of_files.select(*file_keys(changes_of_files), "status", "old_sha", "new_sha", F.inline("changes"))
    return rows.join(named, repo_keys)


# -- commits -------------------------------------------------------------------------------------
def commits_in_range(commits: DataFrame, since=None, until=None, path: str | None = None) -> DataFrame:
    for bound, keep in ((since, lambda c, b: c >= b), (until, lambda c, b: c <= b)):
        if bound is not None:
            commits = commits.filter(keep(F.col("committed_at"), bound if isinstance(bound, Column) else F.lit(bound)))
    return commits if path is None else commits.filter(F.col("path") == path)


def commits_for_file(commits: DataFrame, base: DataFrame, strict: bool = False) -> DataFrame:
    """Commits of each file after its repository's base commit; all of them where the base is unknown.

    ``commits(repo, path, sha, committed_at[, seq])``, ``base(repo, base_at)``.  With ``strict`` the
    listing (by ``seq``) ends at the first commit that is not newer than the base, even if later
    ones are: that end is one minimum per file, not a running window over its commits.
    """
    dated = commits.join(base.select("repo", "base_at"), "repo", "left")
    newer = F.col("base_at").isNull() | (F.col("committed_at") > F.col("base_at"))
    if not strict:
        return dated.filter(newer)
    ends = dated.filter(~newer).groupBy("repo", "path").agg(F.min("seq").alias("end_seq"))
    joined = dated.join(ends, ["repo", "path"], "left")
    return joined.filter(F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))).drop("end_seq")


def commit_order(commits: DataFrame, since=None, buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """Each commit with its neighbours: repo, current, newer, older, all three struct<committed_at, sha>."""
    c = commits_in_range(commits, since).select("repo", F.struct("committed_at", "sha").alias("current"))
    return neighbours(c, ["repo"], "current", F.col("current.committed_at"), buckets, distinct=True)


def commit_pairs(commits: DataFrame, since=None, buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """Each commit with the next older one of its repository: (repo, head_ref, base_ref, head_at, base_at).

    A repository may hold most commits, and a day of imports most of a repository's, so a history is
    not sorted in one piece, see ``neighbours``.
    """
    return commit_order(commits, since, buckets).filter(F.col("older").isNotNull()).select(
        "repo",
        F.col("current.sha").alias("head_ref"),
        F.col("older.sha").alias("base_ref"),
        F.col("current.committed_at").alias("head_at"),
        F.col("older.committed_at").alias("base_at"),
    )


# -- history -----------------------------------------------------------------------------------------
def version_intervals(versions: DataFrame, commits: DataFrame, since=None) -> DataFrame:
    """How long each state of a Python file lasted: one row per run of commits that hold it unchanged.

    ``versions`` has a file's row for each commit (``ref``) whose tree holds it.  repo, path, old-to-new bounds
    ``valid_from`` and ``valid_to`` (commits, both inclusive) with their times, the commit before the first
    (``before_ref``, NULL at the history's begin) and after the last (``after_ref``), and the state's
    ``blob_sha`` or ``digest``.  A file that goes and comes back has a row for each stay.  No text moves, and each
    version moves once to its commit and once along its file's history.
    """
    older, newer = F.col("older.sha").alias("before_ref"), F.col("newer.sha").alias("after_ref")
    order = commit_order(commits, since).select("repo", F.col("current.sha").alias("ref"), F.col("current.committed_at").alias("at"), older, newer)
    held = _marks(python_files(versions), "mark").drop("mark").join(order, ["repo", "ref"])
    state = F.struct("at", "ref", "mark_sha", "mark_digest", "before_ref", "after_ref")
    along = neighbours(held.select("repo", "path", state.alias("current")), ["repo", "path"], "current", F.col("current.at"))

    def stays(other: str, commit: str) -> Column:
        a, b = F.col("current"), F.col(other)
        same = F.coalesce(a["mark_sha"] == b["mark_sha"], a["mark_digest"].eqNullSafe(b["mark_digest"]))
        return F.coalesce((b["ref"] == a[commit]) & same, F.lit(False))

    ends = along.select("repo", "path", "current", (~stays("older", "before_ref")).alias("first"), (~stays("newer", "after_ref")).alias("last"))
    ends = neighbours(ends.filter(F.col("first") | F.col("last")).drop("newer", "older"), ["repo", "path"], "current", F.col("current.at"))
    to = F.when(F.col("last"), F.col("current")).otherwise(F.col("newer"))
    return ends.filter("first").withColumn("to", to).select(
        "repo", "path", F.col("current.ref").alias("valid_from"), F.col("current.at").alias("from_at"),
        F.col("to.ref").alias("valid_to"), F.col("to.at").alias("to_at"), F.col("current.before_ref").alias("before_ref"),
        F.col("to.after_ref").alias("after_ref"), F.col("current.mark_sha").alias("blob_sha"), F.col("current.mark_digest").alias("digest"),
    )


def interval_changes(intervals: DataFrame) -> DataFrame:
    """Files that differ between neighbouring commits: the intervals that start or end there, without texts.

    repo, base_ref, head_ref, path, status, old_sha, new_sha, and what ``_with_texts`` needs.
    """

    def event(side: str, base: str, head: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(base).alias("base_ref"), F.col(head).alias("head_ref"))

    events = F.array(event("new", "before_ref", "valid_from"), event("old", "valid_to", "after_ref"))
    found = intervals.select("repo", "path", "blob_sha", "digest", F.inline(events)).filter("base_ref is not null and head_ref is not null")
    sides = []
    for side in ("old", "new"):
        mine = F.col("side") == side
        sides += [F.max(F.when(mine, F.col("blob_sha"))).alias(f"{side}_sha"), F.max(F.when(mine, F.col("digest"))).alias(f"{side}_digest"), F.max(F.when(mine, F.lit(True))).alias(side)]
    return found.groupBy("repo", "base_ref", "head_ref", "path").agg(*sides).withColumn("status", F.expr(_STATUS))


def history_marks(versions: DataFrame, commits: DataFrame, since=None) -> DataFrame:
    """Python files that may differ between neighbouring commits, without texts; see ``interval_changes``.

    Runs its comparison when called: the changes are written once, as both sides of texts and definitions are looked up.
    """
    return written(interval_changes(version_intervals(versions, commits, since)))


def history_texts(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """Files of ``history_marks`` that do differ, with their texts; see ``changed_files``."""
    return _with_texts(_both_sides(changed, python_files(versions)))


def history_files(versions: DataFrame, commits: DataFrame, since=None) -> DataFrame:
    """Python files that differ between neighbouring commits, with their texts; see ``changed_files``."""
    return history_texts(history_marks(versions, commits, since), versions)


def history_blobs(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """Files of ``history_marks`` that do differ, for ``definition_changes_from_store``: keys, and ``old_blob`` and ``new_blob``.

    A sha or a digest names a side's blob, so texts move only where one side has a sha and the other a digest.
    """
    keys = file_keys(changed)
    blobs = [F.coalesce(f"{side}_sha", f"{side}_digest").alias(f"{side}_blob") for side in ("old", "new")]
    mixed = changed.filter(_MIXED)
    if mixed.isEmpty():
        return changed.select(*keys, *blobs)
    settled = history_texts(mixed, versions).select(*keys)
    unmixed = changed.filter(f"not coalesce({_MIXED}, false)")
    return unmixed.unionByName(changed.join(settled, keys, "left_semi")).select(*keys, *blobs)


# -- definitions by blob -----------------------------------------------------------------------------
_STORE = {"defs": f"array<struct<{DEFINITION_DDL}>>", "last_of_name": "array<int>", "last_of_qualname": "array<int>", "parse_error": "string"}


def _blob(sha: Column, content: Column) -> Column:
    return F.coalesce(sha, F.sha2(content, 256))


def _stored(source: str | None):
    found, error = K.definitions_of(source)
    last = [sorted({d[key]: d["ord"] for d in found}.values()) for key in ("name", "qualname")]
    return found, *last, error


def parse_store(versions: DataFrame, path: str | None = None) -> DataFrame:
    """Definitions of each distinct blob of Python files, parsed once: blob, defs, last_of_name, last_of_qualname, parse_error.

    A blob is known by its sha or, without one, a digest of the content.  One version of each is chosen by its keys
    alone; only the chosen ones' texts move.  With a ``path`` the store is kept there and later calls parse
    only blobs that it lacks.
    """
    spark, keys = versions.sparkSession, ["repo", "ref", "path"]
    sha = F.col("blob_sha") if "blob_sha" in versions.columns else F.lit(None).cast("string")
    py = python_files(versions).filter(F.col("content").isNotNull())
    chosen = py.select(_blob(sha, F.col("content")).alias("blob"), F.struct(*keys).alias("one")).groupBy("blob").agg(F.min("one").alias("one"))
    if path is not None and _exists(spark, path):
        chosen = chosen.join(spark.read.parquet(path).select("blob"), "blob", "left_anti")
    chosen = written(chosen.select("blob", "one.*"))
    texts = might_hold(py.select(*keys, "content"), key_filter(chosen, keys), keys).join(chosen, keys).select("blob", "content")
    parsed = _add_columns(texts, _STORE, ["content"], _stored)
    if path is None:
        return written(parsed)
    parsed.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def definitions_from_store(versions: DataFrame, store: DataFrame) -> DataFrame:
    """What ``definitions`` gives, without parsing: versions find their blob's definitions."""
    sha = F.col("blob_sha") if "blob_sha" in versions.columns else F.lit(None).cast("string")
    found = python_files(versions).select(*file_keys(versions), _blob(sha, F.col("content")).alias("blob"))
    return found.join(store.select("blob", "defs"), "blob").select(*file_keys(versions), F.inline("defs"))


def definition_changes_from_store(file_changes: DataFrame, store: DataFrame, key: str = "name") -> DataFrame:
    """What ``file_definition_changes`` gives, without parsing: both sides find their blob's definitions.

    ``file_changes`` carries ``old_blob`` and ``new_blob`` or else ``old_sha``, ``new_sha`` and, where one is NULL,
    that side's content.
    """
    df = file_changes
    for side in ("old", "new"):
        content = F.col(f"{side}_content") if f"{side}_content" in df.columns else F.lit(None).cast("string")
        last = F.transform(f"last_of_{key}", lambda i: F.get(F.col("defs"), i))
        defs = store.select(F.col("blob").alias(f"{side}_blob"), last.alias(f"{side}_defs"))
        if f"{side}_blob" not in df.columns:
            df = df.withColumn(f"{side}_blob", _blob(F.col(f"{side}_sha"), F.nullif(content, F.lit(""))))
        df = df.join(defs, f"{side}_blob", "left")
        df = df.withColumn(f"{side}_defs", F.coalesce(f"{side}_defs", F.array().cast(f"array<struct<{DEFINITION_DDL}>>"))).drop(f"{side}_blob", f"{side}_content")
    return _paired(df, key)


# -- line differences ------------------------------------------------------------------------------
def with_lines(file_changes: DataFrame) -> DataFrame:
    """Add ``lines``: the status of every line of both sides, old side first, in line order."""
    made = {"lines": f"array<struct<{LINE_DDL}>>"}
    texts = ["old_content", "new_content"]
    return _add_columns(file_changes, made, texts, lambda a, b: (K.line_statuses(a, b),), keep_inputs=True)


def _lines_of(file_changes: DataFrame) -> DataFrame:
    return file_changes if "lines" in file_changes.columns else with_lines(file_changes)


def line_status(file_changes: DataFrame) -> DataFrame:
    df = _lines_of(file_changes)
    return df.select(*file_keys(df), F.inline("lines"))


def change_summary(file_changes: DataFrame) -> DataFrame:
    """Lines added, removed, changed and unchanged; the last two are counted on the old side only."""
    df = _lines_of(file_changes)

    def n(side: str, status: str) -> Column:
        return F.size(F.filter("lines", lambda x: (x["side"] == side) & (x["status"] == status)))

    return df.select(
        *file_keys(df),
        n("new", "added").alias("lines_added"),
        n("old", "removed").alias("lines_removed"),
        n("old", "changed").alias("lines_changed"),
        n("old", "unchanged").alias("lines_unchanged"),
    )


# Markers of annotated files.
_PLAIN_MARKERS = {"comment": "# [%s] ", "inline": ">>> [%s] "}
_HTML_LINE = '<span class="%s-line">%s</span>'
_HTML_END = "\n        </pre>\n    </div>\n</body>\n</html>"


def annotated_text(side: str, style: str = "comment") -> Column:
    """Text of one side with changed lines marked, over ``lines`` and ``<side>_content``; empty if absent."""
    marker = _PLAIN_MARKERS.get(style, _PLAIN_MARKERS["comment"])

    def shown(x: Column) -> Column:
        if style == "html":
            return F.format_string(_HTML_LINE, x["status"], escape_html(x["line"]))
        mark = F.when(x["status"] == "unchanged", "").otherwise(F.format_string(marker, F.upper(x["status"])))
        return F.concat(mark, x["line"])

    text = F.array_join(F.transform(F.filter("lines", lambda x: x["side"] == side), shown), "\n")
    if style == "html":
        text = F.concat(text, F.lit(_HTML_END))
    return F.when(F.coalesce(F.col(f"{side}_content"), F.lit("")) == "", "").otherwise(text)


def annotate(file_changes: DataFrame, side: str, style: str = "comment") -> DataFrame:
    """One side of every changed file, annotated; an unknown style means ``comment``."""
    df = _lines_of(file_changes)
    return df.select(*file_keys(df), annotated_text(side, style).alias("annotated"))


# -- texts per definition ----------------------------------------------------------------------------
def _python_list(items: Column) -> Column:
    """An array of strings the way Python prints a list."""
    tick, quote = F.lit("'"), F.lit('"')

    def shown(s: Column) -> Column:
        safe = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        plain = F.concat(tick, F.replace(safe, tick, F.lit("\\'")), tick)
        return F.when(F.contains(s, tick) & ~F.contains(s, quote), F.concat(quote, safe, quote)).otherwise(plain)

    listed = F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), shown), ", ")
    return F.concat(F.lit("["), listed, F.lit("]"))


def side_by_side(def_changes: DataFrame, docstring_limit: int | None = None) -> DataFrame:
    """Both versions of a changed definition as one text block, in column ``comparison``.

    A ``docstring_limit`` cuts docstrings to so many characters and marks them with "...".
    """
    # Labels and rules of the block.
    bar, dash = F.lit("=" * 80), F.lit("-" * 40)

    def version(side: str) -> list[Column]:
        return [F.lit(f"\n{side.upper()} VERSION:"), dash, F.col(f"{side}_source_code")]

    def one_sided(side: str, status: str) -> Column:
        doc = F.nullif(F.col(f"{side}_docstring"), F.lit(""))
        return F.concat_ws(
            "\n",
            F.lit(f"STATUS: {status}"),
            F.concat(F.lit("Decorators: "), _python_list(F.col(f"{side}_decorators"))),
            F.concat(F.lit("Docstring: "), doc if docstring_limit is None else F.concat(F.substring(doc, 1, docstring_limit), F.lit("..."))),
            *version(side),
        )

    both = F.concat_ws(
        "\n",
        F.lit("STATUS: MODIFIED"),
        F.concat(F.lit("Old decorators: "), _python_list(F.col("old_decorators"))),
        F.concat(F.lit("New decorators: "), _python_list(F.col("new_decorators"))),
        *version("old"),
        *version("new"),
    )
    body = (
        F.when(F.col("change") == "added", one_sided("new", "ADDED"))
        .when(F.col("change") == "removed", one_sided("old", "REMOVED"))
        .otherwise(both)
    )
    head = F.concat(F.upper("node_type"), F.lit(": "), F.col("name"))
    text = F.concat_ws("\n", F.concat(F.lit("\n"), bar), head, bar, body)
    return def_changes.withColumn("comparison", text)


@F.pandas_udf(T.StringType())
def _unified(old: pd.Series, new: pd.Series, old_label: pd.Series, new_label: pd.Series) -> pd.Series:
    return pd.Series([K.unified(*row) for row in zip(old, new, old_label, new_label)], dtype=object)


def unified_diff(def_changes: DataFrame) -> DataFrame:
    """Standard unified diff (three lines of context) of each changed definition, in column ``diff``."""

    def label(side: str) -> Column:
        return F.concat("path", F.lit(f" ({side}) - "), "node_type", F.lit(": "), "name")

    return def_changes.withColumn(
        "diff", _unified("old_source_code", "new_source_code", label("old"), label("new"))
    )


def related_commits(file_changes: DataFrame, commits: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Commits of each changed file between its base and its head: file keys, sha, committed_at, text.

    ``commits(repo, path, sha, committed_at, author, committer, message)``;
    ``bounds(repo[, base_ref, head_ref], base_at, head_at)``: base_at < committed_at <= head_at, a
    bound that is NULL or whose row is missing does not bind.  One row for each commit, however many a file has.
    """
    keys = file_keys(file_changes)
    found = file_changes.select(*keys).join(commits.withColumn("_date", _iso_date(commits)), ["repo", "path"])
    if bounds is not None:
        at = [k for k in keys if k in bounds.columns]
        found = found.join(bounds.select(*at, "base_at", "head_at"), at, "left")
        after = F.col("base_at").isNull() | (F.col("committed_at") > F.col("base_at"))
        found = found.filter(after & (F.col("head_at").isNull() | (F.col("committed_at") <= F.col("head_at"))))
    return found.select(*keys, "sha", "committed_at", _commit_text().alias("text"))


def commits_of_pairs(commits: DataFrame, pairs: DataFrame, bucket: str = "minute") -> DataFrame:
    """Each commit with the pair of neighbouring commits in whose span it falls: base_at < committed_at <= head_at.

    ``pairs(repo, base_ref, head_ref, base_at, head_at)`` of a repository do not overlap, as those of
    ``commit_pairs``; a commit outside all spans is left out.  An as-of join by sorted merge: commits and heads
    meet in their time bucket, sorted together; commits whose bucket has no later head take the first
    head of the next bucket that has one, from a table of one row per bucket.  Every commit moves twice, whatever
    the number of pairs.
    """
    kept, names = commits.columns, ["base_ref", "head_ref", "base_at", "head_at"]
    pair = F.struct("head_at", "base_at", "base_ref", "head_ref")
    heads = pairs.filter("base_at < head_at").select("repo", F.col("head_at").alias("_at"), pair.alias("_pair"))
    asked = commits.select("repo", F.col("committed_at").alias("_at"), F.struct(*kept).alias("_row"))
    events = heads.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_at"))
    # heads come before the commits of their moment: the span includes its end
    along = W.partitionBy("repo", "_bucket").orderBy(F.desc("_at"), F.col("_pair").isNull())
    events = events.withColumn("_here", F.last("_pair", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = events.filter("_row is not null").drop("_pair", "_at")
    first = events.groupBy("repo", "_bucket").agg(F.min("_pair").alias("_first"))
    later = W.partitionBy("repo").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    first = first.select("repo", "_bucket", F.last("_first", ignorenulls=True).over(later).alias("_next")).filter("_next is not null")
    found = rows.join(first, ["repo", "_bucket"], "left").withColumn("_pair", F.coalesce("_here", "_next"))
    found = found.select("_row.*", *[F.col(f"_pair.{c}").alias(c) for c in names])
    return found.filter("base_at < committed_at")


def related_commits_of_history(file_changes: DataFrame, commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """What ``related_commits`` gives for pairs of neighbouring commits, each commit meeting its own pair only."""
    keys = file_keys(file_changes)
    dated = commits_of_pairs(commits.withColumn("_date", _iso_date(commits)), pairs.select("repo", "base_ref", "head_ref", "base_at", "head_at"))
    return file_changes.select(*keys).join(dated, keys).select(*keys, "sha", "committed_at", _commit_text().alias("text"))


def diff_header(def_changes: DataFrame, file_changes: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Header lines of a definition's diff: file status, shas, and the number of its file's related commits.

    The commits themselves are rows, see ``related_commits``: a file may have any number.
    """
    keys = file_keys(file_changes)
    files = file_changes.select(*keys, "status", "old_sha", "new_sha")
    if related is None:
        files = files.withColumn("_related", F.lit(0))
    else:
        files = files.join(related.groupBy(*keys).agg(F.count("*").alias("_related")).hint("merge"), keys, "left")
    # Spark takes texts and lists for 20 bytes each: unless told, it may broadcast all diffs as a small table
    df = def_changes.hint("merge").join(files, keys)

    # Labels and rules of the header.
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"# {label}: "), F.coalesce(value, F.lit("None")), F.lit("\n"))

    blank = F.lit("")
    header = F.concat(
        F.concat(F.lit("# Diff for "), F.col("node_type"), F.lit(": "), F.col("name"), F.lit("\n")),
        line("File", F.col("path")),
        line("Repository", F.col("repo")),
        line("Status", F.col("status")),
        F.when(F.col("change") != "added", line("Old SHA", F.col("old_sha"))).otherwise(blank),
        F.when(F.col("change") != "removed", line("New SHA", F.col("new_sha"))).otherwise(blank),
        F.when(F.col("_related") > 0, line("Related commits", F.col("_related").cast("string"))).otherwise(blank),
        F.lit("#" + "=" * 60 + "\n"),
    )
    return df.withColumn("header", header).drop("_related")


def _iso_date(commits: DataFrame) -> Column:
    """committed_at as ISO text in UTC; a timestamp without zone is taken to be UTC."""
    at = F.col("committed_at")
    if isinstance(commits.schema["committed_at"].dataType, T.TimestampType):
        at = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Labels of a commit's text.
def _commit_text() -> Column:
    """One related commit: short sha, date, people, and its message with the lines indented."""

    def person(who: str) -> Column:
        return F.concat(F.col(f"{who}.name"), F.lit(" <"), F.col(f"{who}.email"), F.lit(">\n"))

    lines = F.split(F.regexp_replace("message", r"^\s+|\s+$", ""), "\n")
    more = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    other = F.col("committer.name") != F.col("author.name")
    return F.concat(
        F.lit("# Commit: "), F.substring("sha", 1, 8), F.lit("\n# Date: "), F.col("_date"), F.lit("\n# Author: "), person("author"),
        F.when(other, F.concat(F.lit("# Committer: "), person("committer"))).otherwise(""),
        F.lit("# Message: "), F.element_at(lines, 1), F.lit("\n"),
        F.array_join(F.transform(more, lambda s: F.concat(F.lit("#          "), s, F.lit("\n"))), ""),
        F.lit("#\n"),
    )
