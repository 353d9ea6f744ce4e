"""Files of an operator's own format in the shared folder, written and read by tasks.

A task writes a file under a name of its own attempt and reports it; only reported names are read,
so attempts that failed or came second leave nothing that counts.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def _of(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    # Spark's names of the object store's connector
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def make_folder(uri: str) -> None:
    where, path = _of(uri)
    where.create_dir(path, recursive=True)


def new_name(folder: str, part: int, suffix: str) -> str:
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"


def writer(uri: str):
    where, path = _of(uri)
    return where.open_output_stream(path, compression=None)


def reader(uri: str):
    where, path = _of(uri)
    return where.open_input_file(path)


def drop(uri: str) -> None:
    where, path = _of(uri)
    where.delete_file(path)
