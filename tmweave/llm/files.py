"""Files in the shared folder, written and range-read inside tasks."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs


class Writer:
    """One new file; a task that runs again writes another, and only the rows of the task that succeeded name theirs."""

    def __init__(self, folder: str, ending: str):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}{ending}"
        self.out, self.at = self.fs.open_output_stream(f"{base}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> int:
        """Where the data starts."""
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def close(self) -> None:
        self.out.close()


class Ranges:
    """Reads ranges of a folder's files; keeps a few open."""

    def __init__(self, folder: str, most: int = 32):
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, object] = OrderedDict()
        self.most = most

    def read(self, name: str, at: int, n: int) -> bytes:
        f = self.open.pop(name, None) or self.fs.open_input_file(f"{self.base}/{name}")
        self.open[name] = f
        if len(self.open) > self.most:
            self.open.popitem(last=False)[1].close()
        data = f.read_at(n, at)
        if len(data) != n:
            raise OSError(f"{name} ends before {at + n}")
        return data
