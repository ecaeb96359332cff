"""Digests of files against hashlib."""

from __future__ import annotations

import hashlib

from veritrail.sources import readers


def test_digests_of_files_in_pieces(spark, tmp_path, monkeypatch):
    texts = {"a b.bin": b"abc", "b.bin": b"x" * 9, "c.bin": bytes(range(256)) * 5000}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    true = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in texts.items()}
    took = lambda: {r.file: (r.size, r.sha256) for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert took() == true
    monkeypatch.setattr(readers, "WHOLE", 5)
    monkeypatch.setattr(readers, "PIECE", 1000)
    assert took() == true


def test_manifest_query(spark, sf_dir):
    from pathlib import Path

    from veritrail import catalog

    rows = {r.file: r.sha256 for r in catalog.queries()["S17_split_manifest"](spark, sf_dir).collect()}
    path = Path(sf_dir) / "documents.parquet"
    files = [path] if path.is_file() else [f for f in path.iterdir() if f.suffix == ".parquet"]
    assert rows == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in files}
