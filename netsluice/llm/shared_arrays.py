"""Numpy arrays in files of the shared folder, written by one task and mapped by others."""

from __future__ import annotations

import io
import json
import mmap
import os
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays one after another behind a line that says where each is; return the path."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    head, at, parts = {}, 0, []
    for key, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        head[key] = (array.dtype.str, at, len(array))
        parts += [raw, b"\0" * (-len(raw) % 64)]
        at += len(raw) + -len(raw) % 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"
    path = f"{base}/{name}-{uuid.uuid4().hex}.arrays"
    with store.open_output_stream(path, compression=None) as f:
        f.write(line)
        for part in parts:
            f.write(part)
    return path if isinstance(store, fs.LocalFileSystem) else f"{folder.rstrip('/')}/{os.path.basename(path)}"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@lru_cache(maxsize=100_000)
def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the shared folder is a mounted one, else read into memory."""
    store, inner = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        with open(inner, "rb") as f:
            raw = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    else:
        with store.open_input_file(inner) as f:
            raw = memoryview(f.read())
    head = io.BytesIO(raw[: 1 << 16]).readline()
    return {k: np.frombuffer(raw, d, n, len(head) + at) for k, (d, at, n) in json.loads(head).items()}


def located(folder: str, *parts: int) -> str:
    """A path under a folder that numbers alone decide."""
    return f"{folder.rstrip('/')}/{'_'.join(str(int(p)) for p in parts)}.arrays"
