"""File systems as Python workers open them."""

from __future__ import annotations


def store_of(root: str):  # noqa: ANN201
    """(file system, path in it) of a URI, or of a path that all nodes have mounted."""
    from pyarrow import fs

    root = root.rstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")
