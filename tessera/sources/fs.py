"""File access from inside tasks, for any URI the cluster uses (file:, hdfs:,
s3a: via pyarrow).  Writes go to a temporary name and are then renamed, so a
retried task never leaves a half-written file under the final name."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs


def resolve(uri: str):
    """(filesystem, path) for a Spark-style path or URI."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parsed.path if parsed.scheme else uri
    if parsed.scheme == "s3a":
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri)


def join(base: str, name: str) -> str:
    return base.rstrip("/") + "/" + name


def ensure_dir(uri: str) -> None:
    fs, path = resolve(uri)
    fs.create_dir(path, recursive=True)


def exists(uri: str) -> bool:
    fs, path = resolve(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def names(uri: str) -> list[str]:
    """The names in a folder, sorted (absent: none)."""
    fs, path = resolve(uri)
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)))


def remove(uri: str) -> None:
    """Delete a folder or file that is no longer needed (absent: nothing)."""
    fs, path = resolve(uri)
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        fs.delete_dir(path)
    elif kind == pafs.FileType.File:
        fs.delete_file(path)


class atomic_output:
    """``with atomic_output(uri) as f: f.write(...)`` then rename into place."""

    def __init__(self, uri: str):
        self.fs, self.path = resolve(uri)
        parent = self.path.rsplit("/", 1)[0]
        self.tmp = f"{parent}/._tmp-{uuid.uuid4().hex}"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.tmp)
        return self.stream

    def __exit__(self, exc_type, exc, tb):
        self.stream.close()
        if exc_type is not None:
            self.fs.delete_file(self.tmp)
            return False
        try:
            self.fs.move(self.tmp, self.path)
        except OSError:
            # Some stores (HDFS) refuse to rename over an existing file, which
            # a retried task with a fixed file name meets: replace it.
            if self.fs.get_file_info(self.path).type == pafs.FileType.NotFound:
                raise
            self.fs.delete_file(self.path)
            self.fs.move(self.tmp, self.path)
        return False


def open_input(uri: str):
    fs, path = resolve(uri)
    return fs.open_input_file(path)


def open_input_stream(uri: str):
    fs, path = resolve(uri)
    return fs.open_input_stream(path)
