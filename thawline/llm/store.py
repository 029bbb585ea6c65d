"""Whole files in the shared folder, from driver and workers alike."""
from __future__ import annotations

import io

import numpy as np


def opened(uri: str):
    """(file system, path) of a folder in the shared store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def save_arrays(folder: str, name: str, attempt: int, **arrays) -> None:
    """Written under the attempt's name, then renamed: a repeated task leaves a whole file."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    with store.open_output_stream(f"{root}/{name}.{attempt}") as f:
        f.write(buffer.getbuffer())
    store.move(f"{root}/{name}.{attempt}", f"{root}/{name}")


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    store, root = opened(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        with np.load(io.BytesIO(f.read())) as z:
            return {k: z[k] for k in z.files}
