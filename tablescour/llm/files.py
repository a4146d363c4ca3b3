"""Files that tasks write and read beside Spark's own formats."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; ``file:`` and bare paths are local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    """A random-access file, mapped into memory where it is local."""
    system, path = store(uri)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


class Output:
    """A file that appears under its name once it is whole.

    Each attempt of a task writes under a name of its own; the move at the end replaces
    what an earlier attempt left, which has the same content.
    """

    def __init__(self, uri: str, attempt: int):
        self.system, self.path = store(uri)
        folder, name = self.path.rsplit("/", 1)
        self.system.create_dir(folder, recursive=True)
        self.draft = f"{folder}/_{name}.{attempt}"
        self.stream = self.system.open_output_stream(self.draft)

    def finish(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)
