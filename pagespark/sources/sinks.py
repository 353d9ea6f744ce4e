"""Sinks.  All writes are distributed; rows of one repository may go to several files.

Tables of repositories are sorted by repository inside each file, not a folder for each of them: files then grow
with the rows, not with tasks times repositories, and a reader that asks for one repository skips the rest by
the statistics of row groups and pages.  Names stay text, also those that a folder's name would turn into a number or NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagespark.operators import code as C


def write_specs_json(specs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per page and line."""
    _json(specs).write.mode(mode).text(path)


def write_batch_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _json(summary).write.mode(mode).text(path)


def _json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def _by_repo(df: DataFrame, path: str, mode: str) -> None:
    """``repo`` comes last, where readers of a partitioned table have it."""
    columns = [c for c in df.columns if c != "repo"]
    df.select(*columns, "repo").sortWithinPartitions("repo").write.mode(mode).parquet(path)


def diff_records(with_headers: DataFrame) -> DataFrame:
    """Diffs with their headers (see ``code.unified_diff`` and ``code.diff_header``), empty ones left out."""
    text = F.concat("header", F.lit("\n"), "diff")
    return with_headers.filter(F.trim("diff") != "").select(
        *C.file_keys(with_headers), "node_type", "name", "change", "diff", text.alias("text")
    )


def write_definition_diffs(
    with_headers: DataFrame, path: str, mode: str = "errorifexists", related: DataFrame | None = None
) -> None:
    """Diffs under ``path`` or, with ``related`` commits, in its folders ``diffs`` and ``commits``."""
    to = path if related is None else f"{path}/diffs"
    _by_repo(diff_records(with_headers), to, mode)
    if related is not None:
        _by_repo(related, f"{path}/commits", mode)


def file_version_records(file_changes: DataFrame, style: str | None = "comment") -> DataFrame:
    """Old and new text of each changed file, with annotated forms unless ``style`` is None.

    Rows are keyed by the full path, so equally named files of two folders both survive.
    """
    df, made = file_changes, {f"{side}_content": F.col(f"{side}_content") for side in ("old", "new")}
    if style is not None:
        df = C.with_lines(file_changes)
        made |= {f"{side}_annotated": C.annotated_text(side, style) for side in ("old", "new")}
    texts = [F.nullif(c, F.lit("")).alias(k) for k, c in made.items()]
    return df.select(*C.file_keys(df), "status", "old_sha", "new_sha", *texts)


def write_file_versions(
    file_changes: DataFrame, path: str, style: str | None = "comment", mode: str = "errorifexists"
) -> None:
    _by_repo(file_version_records(file_changes, style), path, mode)


def write_change_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _by_repo(report, path, mode)


def stream_into(
    stream: DataFrame,
    write: Callable[..., None],
    path: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    checkpoint: str | None = None,
    **options,
) -> StreamingQuery:
    """Run ``write`` (any sink of this module) on each batch of a stream, after ``prepare``; all input that is there now.

    A batch has a folder of its own, ``epoch=N`` under ``path``, which it replaces as a whole.  A batch that is run
    again after a failure therefore leaves the same rows, also where the first attempt had reached the folder, and
    readers of ``path`` get the epoch as a column.  Epochs belong to a checkpoint, which is kept in ``path`` (hidden from
    readers) unless named: a folder with another checkpoint would be written over from epoch 0 on.
    """

    def replace(batch: DataFrame, epoch: int) -> None:
        write(prepare(batch) if prepare else batch, f"{path}/epoch={epoch}", mode="overwrite", **options)

    return (
        stream.writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint or f"{path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
