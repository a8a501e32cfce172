"""Archives made by tasks, read back by the standard library."""

import hashlib
import json
import os
import tarfile
import zipfile

import pytest

from marlstone.sources import archives

FILES = {f"d{i % 3}/资料-{i:03d}.txt": (b"x" * i * 37 + str(i).encode()) * (i % 5) for i in range(60)} | {"long/" + "n" * 180 + ".bin": os.urandom(3 << 20)}


def entries(spark, files=FILES):
    return spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content binary")


def manifest_of(files):
    return sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items())


def test_tar(spark, tmp_path):
    target = f"{tmp_path}/out/a.tar.gz"
    made = archives.write(entries(spark), target, parts=7)
    assert sorted(map(tuple, made.collect())) == manifest_of(FILES)
    with tarfile.open(target) as tar:
        found = {m.name: tar.extractfile(m).read() for m in tar}
    lines = [json.loads(x) for x in found.pop(archives.MANIFEST).decode().splitlines()]
    assert found == FILES and sorted((x["path"], x["bytes"], x["sha256"]) for x in lines) == manifest_of(FILES)
    assert {r["path"]: bytes(r["content"]) for r in archives.read(spark, target).collect()} == FILES
    with open(target, "rb") as f:
        assert open(target + ".sha256").read() == f"{hashlib.sha256(f.read()).hexdigest()}  a.tar.gz\n"
    with pytest.raises(FileExistsError):
        archives.write(entries(spark), target)


def test_zip(spark, tmp_path):
    target = f"{tmp_path}/a.zip"
    made = archives.write(entries(spark), target, "zip", parts=5)
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == FILES and len(z.namelist()) == len(FILES)
    assert {r["path"]: bytes(r["content"]) for r in archives.read_zip(made, target).collect()} == FILES


@pytest.mark.parametrize("kind", ["tar.gz", "zip"])
def test_nothing_to_pack(spark, tmp_path, kind):
    target = f"{tmp_path}/none"
    assert archives.write(entries(spark).limit(0), target, kind).count() == 0
    if kind == "zip":
        assert zipfile.ZipFile(target).namelist() == []
    else:
        assert tarfile.open(target).getnames() == [archives.MANIFEST]


def test_files_are_read_where_they_lie(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}").write_bytes(os.urandom(i * 700_000))
    rows = spark.createDataFrame([(f"in/f{i}", str(tmp_path / f"f{i}")) for i in range(4)] + [("in/none", None)], "path string, file string")
    archives.write(rows, f"{tmp_path}/b.tgz")
    with tarfile.open(f"{tmp_path}/b.tgz") as tar:
        assert all(tar.extractfile(f"in/f{i}").read() == (tmp_path / f"f{i}").read_bytes() for i in range(4)) and tar.extractfile("in/none").read() == b""


def test_a_file_that_changes_is_noticed(tmp_path):
    f = tmp_path / "f"
    f.write_bytes(b"a" * (3 * archives.BLOCK))
    blocks = archives._blocks(None, str(f), 3 * archives.BLOCK)
    next(blocks)
    with open(f, "ab") as out:
        out.write(b"more")
    with pytest.raises(ValueError, match="changed"):
        list(blocks)


@pytest.mark.parametrize("rows, said", [([("../x", b"")], "leaves"), ([("/x", b"")], "leaves"), ([(None, b"")], "leaves"), ([("x", b"1"), ("x", b"2")], "two files"), ([("x", b"1"), ("x", b"1")], "two files")])
def test_what_is_refused_leaves_nothing(spark, tmp_path, rows, said):
    with pytest.raises(Exception, match=said):
        archives.write(spark.createDataFrame(rows, "path string, content binary"), f"{tmp_path}/c.tgz")
    assert os.listdir(tmp_path) == []


def test_only_mounted_folders():
    assert archives.mounted("file:///a/b") == archives.mounted("file:/a/b") == "/a/b"
    with pytest.raises(ValueError):
        archives.mounted("s3a://bucket/a")
