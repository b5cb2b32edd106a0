"""Files that tasks write beside the step tables, for formats that Spark has no writer for.

A task writes under a name of its own and returns a row for it. Readers follow the rows of a manifest that Spark has
committed, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from verdikt.operators.lineage import shared_root


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def create(folder: str, suffix: str):
    """``path, stream`` of a new file in ``folder``."""
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, name = _place(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(name, compression=None)


def read(path: str, start: int, length: int) -> bytes:
    system, name = _place(path)
    with system.open_input_file(name) as stream:
        return stream.read_at(length, start)
