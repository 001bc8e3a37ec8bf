"""Writing and reading whole files from tasks, in any store that pyarrow opens."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path; a bare path is local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Replacing:
    """Writes beside the target and moves it there when complete: a task that is lost or runs twice
    leaves either nothing or the same whole file."""

    def __init__(self, path: str) -> None:
        self.store, self.path = opened(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __enter__(self) -> Replacing:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self.out.close()
        if kind is None:
            self.store.move(self.part, self.path)
        else:
            self.store.delete_file(self.part)
