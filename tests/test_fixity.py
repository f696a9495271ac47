"""Digests of files of any size and of folders of many."""

from __future__ import annotations

import hashlib

import pytest

from lamina.sources import fixity, tables


def test_large_files_are_streamed(spark, tmp_path):
    sizes = {"big.csv": 3 << 30, "rest.bin": (1 << 20) + 1}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    with open(tmp_path / "big.csv", "r+b") as f:
        f.write(b"k,v\n1,a\n")
        f.seek(-2, 2)
        f.write(b"z\n")
    found = {r.file: (r.size, r.sha256) for r in fixity.fixity_manifest(spark, str(tmp_path)).collect()}
    for name, size in sizes.items():
        with open(tmp_path / name, "rb") as f:
            assert found[name] == (size, hashlib.file_digest(f, "sha256").hexdigest())


def test_log_of_a_source_above_two_gigabytes(spark, tmp_path):
    block = b"k,v\n" + b"".join(b"%d,%s\n" % (k, b"x" * 1_000) for k in range(1_000))
    with open(tmp_path / "wide.csv", "wb") as f:
        f.write(block)
        for _ in range(2_200):
            f.write(block[4:])
    (row,) = tables.load_tables(spark, {"wide": str(tmp_path / "wide.csv")}, ["wide"]).collect()
    with open(tmp_path / "wide.csv", "rb") as f:
        assert (row.status, row.row_count, row.source_sha256) == ("OK", 2_201_000, hashlib.file_digest(f, "sha256").hexdigest())
    (tmp_path / "wide.csv").unlink()


def test_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "small").write_bytes(b"s" * 10)
    (tmp_path / "large").write_bytes(b"l" * 5_000)
    monkeypatch.setattr(fixity, "WHOLE", 100)
    monkeypatch.setattr(fixity, "_scheme", lambda spark, path: "other")
    monkeypatch.setattr(fixity, "_stream", lambda path: (_ for _ in ()).throw(OSError(path)))
    found = {r.file: (r.size, r.sha256) for r in fixity.fixity_manifest(spark, str(tmp_path)).collect()}
    assert found == {"small": (10, hashlib.sha256(b"s" * 10).hexdigest()), "large": (5_000, hashlib.sha256(b"l" * 5_000).hexdigest())}


def test_odd_names(spark, tmp_path):
    for name in ("a b", "a#b", "a%20b", "ä?b"):
        (tmp_path / name).write_text(name)
    found = {r.file: r.sha256 for r in fixity.fixity_manifest(spark, str(tmp_path)).collect()}
    assert found == {name: hashlib.sha256(name.encode()).hexdigest() for name in ("a b", "a#b", "a%20b", "ä?b")}


def test_folder_of_many_files(spark, tmp_path):
    for k in range(10_000):
        (tmp_path / f"part-{k}").write_text(str(k % 7))
    manifest = fixity.fixity_manifest(spark, str(tmp_path))
    digest = fixity.folder_digest(manifest)
    assert digest == fixity.source_digest(spark, str(tmp_path)) == fixity.folder_digest(manifest.repartition(3))
    (tmp_path / "part-77").write_text("changed")
    assert fixity.source_digest(spark, str(tmp_path)) != digest


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_folder_digest_is_a_fold_of_groups(spark, monkeypatch, n):
    monkeypatch.setattr(fixity, "LINES", 2)
    rows = [(f"f{k}", f"{k:064x}") for k in range(n)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    digits = 0
    while n > 2 * 16**digits:
        digits += 1
    lines = [(sha(file), f"{digest}  {file}") for file, digest in rows]
    while lines:
        groups = {}
        for at, line in lines:
            groups.setdefault(at[:digits], []).append(line)
        lines = [(at, f"{sha(chr(10).join(sorted(held)))}  {at}") for at, held in groups.items()]
        if not digits:
            break
        digits = max(0, digits - 2)
    assert fixity.folder_digest(spark.createDataFrame(rows, "file string, sha256 string")) == (lines[0][1].split()[0] if lines else None)
