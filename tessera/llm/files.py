"""Byte-range access to the shared folder from tasks."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` (file, hdfs, s3, gs, abfs or a plain path) and the
    path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


class Attempt:
    """A file that appears under its name only when it is whole: attempts of a task
    that is run again, or run twice, never show half a file."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.uri = f"{base}/{name}", f"{folder}/{name}"
        self.own = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Appends; returns where the data begin."""
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.uri
