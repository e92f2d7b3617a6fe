"""Files that tasks write to, and read from, the shared folder. A file appears whole or not at all, under a name that a repeated task gives it again."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    """A file to write to; it takes its name when it is complete, so a lost or repeated task leaves no half of it."""
    store, path = _open(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(temp) as f:
            yield f
        store.move(temp, path)
    finally:
        if store.get_file_info(temp).type != fs.FileType.NotFound:
            store.delete_file(temp)


def read_file(uri: str):
    """A file with random access."""
    store, path = _open(uri)
    return store.open_input_file(path)


def file_size(uri: str) -> int:
    store, path = _open(uri)
    return store.get_file_info(path).size
