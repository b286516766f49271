"""Numpy arrays in the shared folder, written by tasks and memory-mapped by tasks.

An array is written under a name of its own attempt and moved in place, so a repeated task
leaves the same file.  A store on a local or mounted file system is mapped where it is; from any
other, a copy is mapped that has no name and goes with the process.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _at(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def save(root: str, name: str, array: np.ndarray) -> None:
    store, path = _at(root)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(array))
        out.write(np.ascontiguousarray(array).data)
    store.move(attempt, f"{path}/{name}")


def load(root: str, name: str) -> np.ndarray:
    store, path = _at(root)
    if isinstance(store, fs.LocalFileSystem):
        return np.load(f"{path}/{name}", mmap_mode="r")
    handle, copy = tempfile.mkstemp()
    try:
        with os.fdopen(handle, "wb") as out, store.open_input_stream(f"{path}/{name}") as source:
            while chunk := source.read(1 << 22):
                out.write(chunk)
        return np.load(copy, mmap_mode="r")
    finally:
        os.unlink(copy)
