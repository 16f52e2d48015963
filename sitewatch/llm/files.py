"""Files that tasks write and read themselves, below the folder all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

from sitewatch.sources.scratch import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below ``spark.checkpoint.dir``."""
    path = scratch_path(spark, name)
    if path.startswith("/"):
        return f"file://{path}"
    return re.sub(r"^file:/(?!/)", "file:///", path)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


@contextmanager
def written(uri: str) -> Iterator:
    """A file that appears under its name only when it is whole.

    A repeated or a second attempt of a task replaces it with the same content.
    """
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(attempt, compression=None) as out:
            yield out
        store.move(attempt, path)
    except BaseException:
        if store.get_file_info(attempt).type != fs.FileType.NotFound:
            store.delete_file(attempt)
        raise


@contextmanager
def opened(uri: str) -> Iterator:
    """A file for reading from any place."""
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        yield f
