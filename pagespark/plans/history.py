"""Repository analysis end to end: two refs, or every commit pair of a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.operators import code as C
from pagespark.sources.shared import written


def analyze_refs(versions: DataFrame, base: str, head: str, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """(changed files, changed definitions) of every repository between two refs."""
    files = C.changed_files(C.valid_repos(versions), base, head)
    return files, C.definition_changes(files, key)


def history(versions: DataFrame, commits: DataFrame, since=None, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """The same for each pair of neighbouring commits since a point in time; rows carry base_ref and head_ref.

    Pairs read the intervals of file states, and each distinct blob is parsed once.  Changed definitions are found by
    blob, so only ``files`` looks up texts.  Runs its comparison and its parse when called.
    """
    valid = C.valid_repos(versions)
    changed = C.history_marks(valid, commits, since)
    blobs = C.history_blobs(changed, valid)
    changes = C.definition_changes_from_store(blobs, C.parse_store(valid), key)
    return C.history_texts(changed, valid), changes.select(*C.file_keys(blobs), F.inline("changes"))


def report(file_changes: DataFrame, key: str = "name") -> DataFrame:
    """The change report of changed files.

    Detail and totals both read the changed definitions by file, so that table is written once, and
    versions are read once.  This runs its job when called: call it when the report is wanted.
    """
    return C.change_report(written(C.file_definition_changes(file_changes, key)))
