"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

from gapgrid.llm.common import checkpoint_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the session's checkpoint folder."""
    root = checkpoint_root(spark)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def publish(store: pyarrow.fs.FileSystem, attempt: str, final: str) -> None:
    """Give a file that a task attempt has finished its name. A repeated attempt writes the same bytes, so either may win."""
    store.move(attempt, final)
