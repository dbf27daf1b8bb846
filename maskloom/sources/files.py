"""Single plain files in a folder that all executors share, for formats that Spark does not write itself."""

from __future__ import annotations

import uuid


def file_system(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def save_file(path: str, content: bytes) -> None:
    """Write under another name, then rename: a task that runs again or twice leaves one whole file."""
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, place)


def read_file(path: str) -> bytes:
    system, place = file_system(path)
    with system.open_input_file(place) as file:
        return file.read()
