"""Files in the shared scratch folder, written and read by tasks through Arrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def _open(uri: str):
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_blob(folder: str, data: bytes, suffix: str) -> str:
    """Write a file under a name of its own and return its URI.

    A retried or speculative task writes another file; only files listed in a committed manifest count.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path + ".part") as out:
        out.write(data)
    system.move(path + ".part", path)
    return uri


def read_blob(uri: str, start: int, length: int) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as src:
        src.seek(start)
        return src.read(length)
