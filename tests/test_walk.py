"""The distributed listing, held against os.walk."""

import fnmatch
import hashlib
import os
import random

import pytest

from lexiforge.errors import ScanError
from lexiforge.sources.scan import scan_files
from lexiforge.sources.walk import scan_tree, walked


def grow(folder, rng, depth=0):
    for k in range(rng.randint(1, 4)):
        name = rng.choice(["", ".", "_"]) + rng.choice("abc") + str(k) + rng.choice([".txt", ".md", ""])
        (folder / name).write_text(name * rng.randint(0, 5))
    for k in range(rng.randint(0, 3) if depth < 4 else 0):
        sub = folder / (rng.choice(["", ".", "_"]) + rng.choice(["lib", "node", "x"]) + str(k))
        sub.mkdir()
        grow(sub, rng, depth + 1)


def plainly(root, globs):
    out = []
    for folder, _, names in os.walk(root):
        for n in names:
            path = os.path.join(folder, n)
            inside = os.path.relpath(path, root)
            parts = inside.split("/")
            held = [*parts, *("/".join(parts[:i]) for i in range(1, len(parts) + 1))]
            if not any(fnmatch.fnmatchcase(p, g) for p in held for g in globs):
                out.append(path)
    return sorted(out)


@pytest.mark.parametrize("globs", [[], ["node*", "*.md"], [".*"], ["lib0/_*", "x1"]])
def test_equals_a_plain_walk(spark, tmp_path, globs):
    root = tmp_path / "tree"
    root.mkdir()
    grow(root, random.Random(8))
    files, problems = walked(spark, str(root), globs)
    rows = files.collect()
    assert sorted(r.path for r in rows) == plainly(root, globs) and problems.count() == 0
    assert all(r.size == os.path.getsize(r.path) for r in rows)


def test_content_and_what_spark_does_not_list(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "_x.txt").write_text("deep")
    (tmp_path / "a.TXT").write_text("a")
    (tmp_path / "b.md").write_text("b")
    assert {r.path for r in scan_files(spark, str(tmp_path), extensions=["txt"]).collect()} == {f"{tmp_path}/a.TXT"}
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "dead.txt").symlink_to(tmp_path / "none")
    files, problems = scan_tree(spark, f"file://{tmp_path}", ["txt"], content=True)
    rows = {r.path.rpartition("/")[2]: r for r in files.collect()}
    assert set(rows) == {"_x.txt", "a.TXT"} and bytes(rows["_x.txt"].content) == b"deep" and problems.count() == 0
    assert rows["a.TXT"].checksum == hashlib.sha256(b"a").hexdigest()


def test_problems(spark, tmp_path):
    files, problems = walked(spark, str(tmp_path / "none"))
    assert files.count() == 0 and problems.first().path == str(tmp_path / "none")
    with pytest.raises(ScanError):
        scan_tree(spark, str(tmp_path), algorithm="crc")


def test_an_excluded_folder_is_not_opened(spark, tmp_path, monkeypatch):
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "x").write_text("x")
    (tmp_path / "keep").mkdir()
    (tmp_path / "keep" / "y").write_text("y")
    before = os.stat(tmp_path / "skip").st_atime_ns
    os.utime(tmp_path / "skip", ns=(before - 10**15, before - 10**15))  # reading it would set this
    files, _ = walked(spark, str(tmp_path), ["skip"])
    assert [r.path.rpartition("/")[2] for r in files.collect()] == ["y"]
    assert os.stat(tmp_path / "skip").st_atime_ns == before - 10**15
