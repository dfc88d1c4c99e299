"""Edits of single files in a folder: guarded paths, versions checked before a write, writes whole or not at all.

These act on the driver's file system; the change stream or the next pass brings the index after them.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
from collections.abc import Callable

from .folder import decode
from .store import guard, read_text_file, retry, write_atomically

#: A line with its end; the last one may have none.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_END = re.compile(r"\r\n|\r|\n")


class Changed(RuntimeError):
    """The file is no longer the version that the edit was meant for."""


def version(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def line_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each line, its end included; a text that ends with a line end has no further line."""
    return [m.span() for m in _LINE.finditer(text)]


def locate(text: str, start: int, end: int) -> tuple[int, int]:
    """The characters of lines start to end, counted from 1; a range outside the text raises ValueError."""
    spans = line_spans(text)
    if not 1 <= start <= end <= len(spans):
        raise ValueError(f"lines {start} to {end} of a text that has {len(spans)}")
    return spans[start - 1][0], spans[end - 1][1]


def with_ends(text: str, end: str) -> str:
    """The text with every line end replaced by `end`."""
    return _END.sub(lambda _: end, text)


class Workspace:
    """A folder's files by relative paths. `changed` hears of each path written or deleted."""

    def __init__(self, root: str, changed: Callable[[str, str], None] = lambda path, kind: None):
        self.root, self.changed = root, changed

    def _told(self, full: str, kind: str) -> None:
        self.changed(os.path.relpath(full, os.path.realpath(self.root)).replace(os.sep, "/"), kind)

    def read(self, path: str) -> tuple[str, str]:
        """The text and its version."""
        data = read_text_file(guard(self.root, path))
        return decode(data), version(data)

    def create(self, path: str, text: str) -> str:
        """A new file, with the folders that it needs; one that exists raises FileExistsError."""
        full = guard(self.root, path)
        if os.path.lexists(full):
            raise FileExistsError(path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        data = text.encode()
        write_atomically(full, data)
        self._told(full, "Created")
        return version(data)

    def update(self, path: str, text: str, expected: str) -> str:
        """The whole text replaced, if the file still is the expected version."""
        full = guard(self.root, path)
        if version(read_text_file(full)) != expected:
            raise Changed(path)
        data = text.encode()
        write_atomically(full, data)
        self._told(full, "Modified")
        return version(data)

    def replace_lines(self, path: str, start: int, end: int, replacement: str, expected: str) -> str:
        """Lines start to end replaced, in the file's own line ends; an empty replacement deletes them."""
        text, now = self.read(path)
        if now != expected:
            raise Changed(path)
        a, b = locate(text, start, end)
        own = _END.search(text)
        new = with_ends(replacement, own[0]) if own else replacement
        tail = _END.search(text, max(a, b - 2), b)
        if new and tail and not _END.search(new, len(new) - 1):
            new += tail[0]
        return self.update(path, text[:a] + new + text[b:], expected)

    def delete(self, path: str) -> int:
        """A file, or a folder with all in it, and the number of files that went. The root and links raise ValueError."""
        full = guard(self.root, path)
        if full == os.path.realpath(self.root):
            raise ValueError("the root stays")
        if not os.path.isdir(full):
            retry(lambda: os.remove(full), 6, 0.025)
            self._told(full, "Deleted")
            return 1
        found = list(os.walk(full))
        if any(os.path.islink(os.path.join(d, x)) for d, folders, names in found for x in folders + names):
            raise ValueError(f"{path} holds a link")
        files = [os.path.join(d, x) for d, _, names in found for x in sorted(names)]
        retry(lambda: shutil.rmtree(full), 6, 0.025)
        for f in files:
            self._told(f, "Deleted")
        return len(files)
