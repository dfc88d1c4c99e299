import os

import pytest

from lodestone.sources.edits import Changed, Workspace, line_spans, locate


def test_lines():
    assert line_spans("") == [] and line_spans("a") == [(0, 1)] and line_spans("a\r\n\rb\n") == [(0, 3), (3, 4), (4, 6)]
    assert locate("a\nbb\n", 2, 2) == (2, 5)
    for bad in ((0, 1), (2, 1), (1, 3)):
        with pytest.raises(ValueError, match="has 2"):
            locate("a\nbb\n", *bad)


def test_edits(tmp_path):
    heard = []
    w = Workspace(str(tmp_path), lambda p, k: heard.append((p, k)))
    v = w.create("sub/a.txt", "one\r\ntwo\r\nthree")
    with pytest.raises(FileExistsError):
        w.create("sub/a.txt", "x")
    assert w.read("sub/a.txt") == ("one\r\ntwo\r\nthree", v)
    v2 = w.replace_lines("sub/a.txt", 2, 2, "2\n2b", v)
    assert w.read("sub/a.txt")[0] == "one\r\n2\r\n2b\r\nthree"
    with pytest.raises(Changed):
        w.update("sub/a.txt", "x", v)
    v3 = w.replace_lines("sub/a.txt", 4, 4, "end", v2)
    v4 = w.replace_lines("sub/a.txt", 1, 1, "", v3)
    assert (tmp_path / "sub/a.txt").read_bytes() == b"2\r\n2b\r\nend"
    w.update("sub/a.txt", "new", v4)
    w.create("sub/deep/b.txt", "b")
    for bad in ("", ".", "../x", ".lodestone/x"):
        with pytest.raises(ValueError):
            w.delete(bad)
    os.symlink(tmp_path / "sub/a.txt", tmp_path / "sub/link.txt")
    for linked in ("sub", "sub/link.txt"):
        with pytest.raises(ValueError):
            w.delete(linked)
    os.remove(tmp_path / "sub/link.txt")
    assert w.delete("sub") == 2 and not (tmp_path / "sub").exists()
    assert heard == [("sub/a.txt", "Created"), *[("sub/a.txt", "Modified")] * 4, ("sub/deep/b.txt", "Created"), ("sub/a.txt", "Deleted"), ("sub/deep/b.txt", "Deleted")]
