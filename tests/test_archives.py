"""Archives of several entries, nested archives, long entries and odd ones."""

import io
import zipfile

from padlens.sources import archives


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_entries_are_dealt_to_tasks_and_long_ones_cut_at_lines(spark, tmp_path):
    text = {f"{u}/{s}/Touch.csv": "".join(f"{u},{s},{i},é\n" for i in range(200)) for u in range(4) for s in range(3)}
    inner = {"100/1/Touch.csv": "a,b\nc,d", "100/1/readme.md": "no", "100/2/empty.csv": ""}
    (tmp_path / "a.zip").write_bytes(packed({**text, "notes.txt": "x", "100.zip": packed(inner), "9/9/bad.csv": b"\xff,1\n"}))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.zip").write_bytes(packed({"7/1/Touch.csv": "1\r\n2\r\n", "7/1/": ""}))
    (tmp_path / "none.zip").write_bytes(packed({}))
    df = archives.archive_rows(spark, str(tmp_path), split=5000, chunk=700)
    assert df.rdd.getNumPartitions() >= 6
    rows = df.collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["first_line"])):
        if r["kept"]:
            body = got.setdefault(r["name"], "")
            assert r["first_line"] == body.count("\n") and len(r["body"].encode()) <= 1400 + 20
            got[r["name"]] = body + r["body"]
            assert r["name"].startswith(f"{r['user']}/{r['session']}/")
    assert got == text | {"100/1/Touch.csv": "a,b\nc,d", "100/2/empty.csv": "", "9/9/bad.csv": "�,1\n", "7/1/Touch.csv": "1\r\n2\r\n"}
    assert sorted(r["name"] for r in rows if not r["kept"]) == ["100/1/readme.md", "notes.txt"] and all(r["body"] is None for r in rows if not r["kept"])
    one = archives.archive_rows(spark, f"file://{tmp_path}/deep/b.zip")
    assert [r["body"] for r in one.collect()] == ["1\r\n2\r\n"]
    assert archives.archive_rows(spark, str(tmp_path / "none.zip")).collect() == []


def test_chunks_keep_lines_whole():
    for size in (1, 3, 7, 100):
        for data in (b"", b"\n", b"ab\n\ncd", b"long line without an end" * 3, b"x\n" * 20):
            parts = list(archives.chunks(io.BytesIO(data), size))
            assert "".join(t for _, t in parts).encode() == data
            assert [n for n, _ in parts] == [data[: len("".join(t for _, t in parts[:i]).encode())].count(b"\n") for i in range(len(parts))]
            assert all(t.endswith("\n") for _, t in parts[:-1])
