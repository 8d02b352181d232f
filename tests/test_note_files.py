"""Files as results, the stream of a folder's changes, and scans that open only what changed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stratalog.plans import vault_jobs
from stratalog.sources import notes


def _write(folder, name, text, at=None):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    if at:
        os.utime(path, (at, at))


def _files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(folder) for n in names}


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "out")
    _write(at, "old.md", "stays")
    _write(at, "a/b.md", "replaced")
    rows = spark.createDataFrame([("a/b.md", "new\r\n中"), ("c.txt", None), ("d/e/f.json", "{}")], "rel string, value string").repartition(3)
    notes.write_files(rows, at)
    want = {"old.md": "stays", "a/b.md": "new\n中", "c.txt": "", "d/e/f.json": "{}"}
    assert _files(at) == want and open(f"{at}/a/b.md", newline="").read() == "new\r\n中"
    for bad in (rows.withColumn("value", F.when(F.col("rel") == "c.txt", F.raise_error(F.lit("no"))).otherwise("x")), rows.withColumn("rel", F.lit("same.md")), rows.withColumn("rel", F.lit("../out.md"))):
        with pytest.raises(Exception):
            notes.write_files(bad.select("rel", "value"), at)
        assert _files(at) == want and not os.path.exists(str(tmp_path / "out.md"))
    with pytest.raises(Exception):
        notes.write_files(rows, at, overwrite=False)
    assert _files(at) == want


def test_payloads_have_a_text_file_a_video(spark, tmp_path):
    rows = spark.createDataFrame([("v", "c", "d1\nd2", "e", "p"), ("w", "c", "d3", "e3", "p")], "video_id string, content string, content_dehydrated string, content_evidence string, content_plain string")
    notes.write_payloads(rows, str(tmp_path / "x.json"))
    assert _files(str(tmp_path / "x_text")) == {"v.txt": "d1\nd2", "w.txt": "d3"}
    notes.write_payloads(rows, str(tmp_path / "x.json"), evidence=True)
    assert _files(str(tmp_path / "x_text")) == {"v.txt": "e", "w.txt": "e3"}


def _index(spark, index):
    return sorted((r.rel, r.title, tuple(r.aliases), r.size) for r in vault_jobs.load_index(spark, index).collect())


def test_a_stream_of_changes_ends_where_a_scan_does(spark, tmp_path):
    vault, index, cp = (str(tmp_path / x) for x in ("vault", "index", "cp"))
    _write(vault, "a.md", "---\ntitle: A\n---\n")
    _write(vault, "sub/b.md", "---\naliases: [x, y]\n---\n")
    _write(vault, ".hidden/c.md", "no")
    vault_jobs.follow(spark, vault, index, cp).awaitTermination()
    first = _index(spark, index)
    assert [r[0] for r in first] == ["a.md", "sub/b.md"]
    vault_jobs.follow(spark, vault, index, cp).awaitTermination()  # a restart without changes
    assert _index(spark, index) == first
    _write(vault, "a.md", "---\ntitle: A2 longer\n---\n")
    os.remove(f"{vault}/sub/b.md")
    _write(vault, "new.md", "x")
    vault_jobs.follow(spark, vault, index, cp).awaitTermination()
    os.remove(f"{vault}/new.md")
    _write(vault, "sub/d.md", "---\ntitle: D\n---\n")
    vault_jobs.follow(spark, vault, index, cp).awaitTermination()
    assert vault_jobs.scan(spark, vault, str(tmp_path / "fresh")) == 0
    assert _index(spark, index) == _index(spark, str(tmp_path / "fresh")) and len(_index(spark, index)) == 2
    assert len(os.listdir(f"{cp}-snapshots")) <= 2  # spent ones go


def test_a_scan_opens_only_what_changed(spark, tmp_path, monkeypatch):
    vault, index = str(tmp_path / "vault"), str(tmp_path / "index")
    for i in range(6):
        _write(vault, f"n{i} +ä.md", f"---\ntitle: T{i}\n---\n", 1_700_000_000 + i)
    assert vault_jobs.scan(spark, vault, index) == 0
    _write(vault, "n0 +ä.md", "---\ntitle: X0\n---\n", 1_700_000_000)  # same time and size: counts as unchanged, so it isn't read
    _write(vault, "n1 +ä.md", "---\ntitle: X1\n---\n", 1_700_000_099)
    _write(vault, "n9.md", "---\ntitle: T9\n---\n")
    os.remove(f"{vault}/n2 +ä.md")
    opened, plain = [], notes.read_listed
    monkeypatch.setattr(notes, "read_listed", lambda s, folder, paths: opened.extend(paths) or plain(s, folder, paths))
    monkeypatch.setattr(notes, "read_notes", lambda *a: pytest.fail("reads all files"))
    monkeypatch.setattr(vault_jobs, "READ_PATHS", 1)
    assert vault_jobs.scan(spark, vault, index) == 0
    assert len(opened) == 2 and {r[0]: r[1] for r in _index(spark, index)} == {"n0 +ä.md": "T0", "n1 +ä.md": "X1", "n3 +ä.md": "T3", "n4 +ä.md": "T4", "n5 +ä.md": "T5", "n9.md": "T9"}


def test_notes_are_linked_in_place(spark, tmp_path):
    vault, source, index = (str(tmp_path / x) for x in ("vault", "in", "index"))
    _write(vault, "graph.md", "x")
    _write(source, "me.md", "A graph is fine.")
    _write(source, "sub/other.md", "No term here.")
    _write(str(tmp_path), "terms.json", json.dumps([{"term": "graph", "type": "concept"}]))
    common = ["all", "--vault", vault, "--index", index, "--input", source, "--terms", str(tmp_path / "terms.json")]
    assert vault_jobs.main(common, spark) == 2
    assert vault_jobs.main([*common, "--files", str(tmp_path / "out")], spark) == 0
    out = _files(str(tmp_path / "out"))
    assert set(out) == {"me.md", "sub/other.md"} and "[[graph" in out["me.md"] and _files(source)["me.md"] == "A graph is fine."
    assert vault_jobs.main([*common, "--inplace"], spark) == 0
    assert _files(source) == out
