"""Whole binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def open_file(uri: str):
    """A file that can be read from any place on."""
    store, path = _at(uri)
    return store.open_input_file(path)


def write_file(uri: str, parts: list[bytes]) -> int:
    """Writes under a name of this attempt, then moves: a retried task leaves one whole file."""
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with store.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(own, path)
    return size
