"""Files in the shared folder, from Python workers."""

from __future__ import annotations

from urllib.parse import urlparse

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path (file, s3, gs, abfs, hdfs) and the path on it."""
    kind = urlparse(uri)
    if kind.scheme in ("", "file"):
        return fs.LocalFileSystem(), kind.path
    return fs.FileSystem.from_uri(uri)
