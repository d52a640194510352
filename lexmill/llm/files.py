"""Files that tasks write to and read from the shared folder.

Paths are URIs that pyarrow's file systems know (file, hdfs, s3, gs).  A task writes under a
name of its own attempt; only the names that committed rows of a manifest list are ever read,
so a retried or speculative attempt can do no harm.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, stem: str, data: bytes) -> str:
    """Write a new file and return its URI."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        return source.read_at(source.size() - start if length is None else length, start)
