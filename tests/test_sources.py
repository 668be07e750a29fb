"""Readers and writers."""

import hashlib
import io
import zipfile

import pytest

from tracewell import sinks, sources
from tracewell.sources import archives


def test_read_by_format(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    for kind in ("parquet", "json", "csv", "orc"):
        df.write.option("header", True).format(kind).save(f"{tmp_path}/x.{kind}")
        got = sources.read(spark, f"{tmp_path}/x.{kind}", schema="k long, t string")
        assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        sources.read(spark, "x.unknown")


def test_inventory(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.bin").write_bytes(b"\x7fELFxx")
    (tmp_path / "in/deep/b.txt").write_bytes(b"hello")
    got = {r.path: tuple(r)[1:] for r in sources.inventory(spark, f"{tmp_path}/in", most_bytes=5).collect()}
    assert got == {"a.bin": (6, None, "too_large", "elf"), "deep/b.txt": (5, hashlib.sha256(b"hello").hexdigest(), "hashed", "other")}


def test_zip_entries(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", b"hello")
        z.writestr("../bad.txt", b"out")
        z.writestr("bomb", b"0" * 1_000_000)
        z.writestr("large", bytes(range(256)) * 100)
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.apk").write_bytes(b"no archive")
    got = {(r.archive[-5:], r.entry): (r.sha256, r.status) for r in archives.zip_entries(spark, str(tmp_path), most_bytes=2_000_000, most_ratio=150).collect()}
    assert got[("a.zip", "good.txt")] == (hashlib.sha256(b"hello").hexdigest(), "ok") and got[("b.apk", None)] == (None, "damaged")
    assert got[("a.zip", "../bad.txt")][1] == "unsafe" and got[("a.zip", "bomb")][1] == "ratio"
    small = {r.entry: r.status for r in archives.zip_entries(spark, str(tmp_path), most_bytes=10_000).where("entry = 'large'").collect()}
    assert small == {"large": "too_large"}


def test_page_parts(spark):
    html = '<a href="/x?y#z">q</a><SCRIPT src="m.js"></SCRIPT><script>let a = "<b>";\n</script><a class="c" href=\'w\'>'
    df = spark.createDataFrame([(1, html), (2, None)], "k int, h string")
    assert [tuple(r)[:4] for r in archives.page_scripts(df, "k", "h").orderBy("ordinal").collect()] == [(1, 0, "m.js", 0), (1, 1, None, 15)]
    assert [r.href for r in archives.page_links(df, "k", "h").orderBy("ordinal").collect()] == ["/x?y#z", "w"]


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "k long, t string, x array<int>")
    sinks.write_bundle(df, f"{tmp_path}/b")
    assert sorted(map(str, sinks.read_bundle(spark, f"{tmp_path}/b").collect())) == sorted(map(str, df.collect()))
    df.where("k = 1").write.mode("append").json(f"{tmp_path}/b/records")
    with pytest.raises(ValueError):
        sinks.read_bundle(spark, f"{tmp_path}/b")


def test_snapshots(spark, tmp_path):
    folder = f"{tmp_path}/s"
    one = spark.range(3)
    assert sinks.head(spark, folder) is None and sinks.write_snapshot(one, folder, None) == 1
    assert sinks.write_snapshot(spark.range(5), folder, 1) == 2
    with pytest.raises(ValueError):
        sinks.write_snapshot(one, folder, 1)
    assert sinks.read_snapshot(spark, folder).count() == 5 and sinks.read_snapshot(spark, folder, 1).count() == 3
    sinks.write_snapshot(spark.range(7), folder, 2)
    assert sinks.retain(spark, folder, 2) == [1] and sinks.head(spark, folder) == 3
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, folder, 1)


def test_interleaved_snapshots(spark, tmp_path, monkeypatch):
    """Two writers that both saw the same head: one snapshot, of the first to note it, and no rows of the other."""
    folder, note = f"{tmp_path}/s", sinks._note
    sinks.write_snapshot(spark.range(2), folder, None)

    def late(session, name, value):
        monkeypatch.setattr(sinks, "_note", note)
        assert sinks.write_snapshot(spark.range(30), folder, 1) == 2  # the other writer is faster
        note(session, name, value)

    monkeypatch.setattr(sinks, "_note", late)
    with pytest.raises(ValueError):
        sinks.write_snapshot(spark.range(7), folder, 1)
    assert sinks.head(spark, folder) == 2 and sinks.read_snapshot(spark, folder).count() == 30
    assert len([x for x in (tmp_path / "s" / "00000002").iterdir() if x.name.startswith("data")]) == 1


def test_files_that_are_not_opened(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\x7fELF" + b"0" * 100)
    (tmp_path / "b").write_bytes(b"\x7fELF" + b"0" * 10)
    got = {r.path: (r.hash_status, r.kind) for r in sources.inventory(spark, str(tmp_path), most_bytes=5, most_opened=50).collect()}
    assert got == {"a": ("too_large", None), "b": ("too_large", "elf")}


def test_bounded_text(spark, tmp_path):
    df = spark.createDataFrame([("short",), ("x" * 50,)], "t string")
    assert [r.t for r in sinks.write_text(df, "t", f"{tmp_path}/t", 10).collect()] == ["x" * 50]
    assert [r.t for r in spark.read.json(f"{tmp_path}/t").collect()] == ["short"]
