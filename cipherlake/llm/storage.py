"""Files that executors write and read in the shared folder, through any file system pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def _normal(path: str) -> str:
    """file:/x and file://x/... as pyarrow wants them."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def make_dir(path: str) -> None:
    system, at = open_fs(_normal(path))
    system.create_dir(at, recursive=True)


class AtomicFile:
    """Writes beside the target and moves into place on close, so a task that is run again or twice leaves one whole file."""

    def __init__(self, path: str):
        self.system, self.at = open_fs(_normal(path))
        self.beside = f"{self.at}.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.beside)
        self.size = 0

    def write(self, data) -> int:
        """Appends and returns the offset at which the data begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.system.move(self.beside, self.at)


def write_file(path: str, data: bytes) -> None:
    f = AtomicFile(path)
    f.write(data)
    f.close()


def read_file(path: str) -> bytes:
    system, at = open_fs(_normal(path))
    with system.open_input_stream(at) as f:
        return f.read()


def file_size(path: str) -> int:
    system, at = open_fs(_normal(path))
    return system.get_file_info(at).size


def open_file(path: str):
    """A file for random access."""
    system, at = open_fs(_normal(path))
    return system.open_input_file(at)
