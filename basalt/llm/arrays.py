"""Numpy arrays in the shared folder, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import zstandard

_maps: dict[str, np.ndarray] = {}


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(root: str, name: str, array: np.ndarray) -> None:
    """Write ``name``; a repeated task writes the same bytes and replaces the file whole."""
    path = _local(root)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        np.save(f, array)
    store.move(part, f"{path}/{name}.npy")


def load(root: str, name: str) -> np.ndarray:
    """Memory-map ``name``; a store that isn't mounted is copied to the worker's disk first."""
    key = f"{root}/{name}"
    if key not in _maps:
        path = _local(root)
        if path is None:
            from pyarrow import fs

            store, far = fs.FileSystem.from_uri(root)
            path = tempfile.mkdtemp(prefix="arrays-")
            fs.copy_files(f"{far}/{name}.npy", f"{path}/{name}.npy", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        if len(_maps) > 4096:
            _maps.clear()
        _maps[key] = np.load(f"{path}/{name}.npy", mmap_mode="r")
    return _maps[key]


def squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compress unsigned integers by byte planes, of the differences if they ascend."""
    if ascending and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return values.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, ascending: bool = False) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, len(planes) // kind.itemsize).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending else values
