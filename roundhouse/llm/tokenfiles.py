"""Binary token files in the shared folder, written and read by tasks through the file systems that Arrow knows.

A task writes to a name of its own attempt and reports it in its output row. The reports are written as a table, of which Spark keeps
one attempt of each task, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

from pyspark import TaskContext


def place(path: str):
    """File system and path within it of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def own_path(folder: str, end: str) -> str:
    """A name in the folder that no other attempt of this or another task uses."""
    task = TaskContext.get()
    return f"{folder}/{task.partitionId():08d}-{task.attemptNumber()}-{uuid.uuid4().hex[:12]}{end}"


def create(path: str):
    system, inner = place(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def read_range(path: str, start: int, length: int) -> bytes:
    system, inner = place(path)
    with system.open_input_file(inner) as file:
        return file.read_at(length, start)
