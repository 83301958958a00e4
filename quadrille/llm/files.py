"""Bytes in the shared folder, opened from executors by URI (local, HDFS or object store)."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


def write_bytes(uri: str, data: bytes) -> None:
    store, path = opened(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def delete(uri: str) -> None:
    store, path = opened(uri)
    store.delete_file(path)
