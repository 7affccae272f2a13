"""Arrays in files of the shared folder, written and read inside tasks."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_shared(uri: str, data: bytes | list[bytes]) -> None:
    """The file appears whole or not at all, so a task may be repeated or run twice."""
    pieces = [data] if isinstance(data, bytes) else data
    if local := _local(uri):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(made := f"{local}.{uuid.uuid4().hex}", "wb") as out:
            out.writelines(pieces)
        os.replace(made, local)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(made := f"{path}.{uuid.uuid4().hex}") as out:
        for piece in pieces:
            out.write(piece)
    store.move(made, path)


def map_shared(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped where the shared folder is mounted."""
    if local := _local(uri):
        return np.memmap(local, np.uint8, "r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """A length, a JSON table of contents, and the arrays, each at a multiple of 8 bytes."""
    contents, at, pieces = {}, 0, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        contents[name] = [array.dtype.str, list(array.shape), at]
        pieces.append(data + b"\0" * (-len(data) % 8))
        at += len(pieces[-1])
    head = json.dumps(contents).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(pieces)


def unpack_arrays(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8].tobytes(), "little")
    contents = json.loads(data[8:8 + size].tobytes())
    out = {}
    for name, (kind, shape, at) in contents.items():
        length = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[8 + size + at:8 + size + at + length].view(kind).reshape(shape)
    return out
