"""Archives written and read back, against a reader that goes through each file from its start."""

import glob
import hashlib
import random
import uuid

import oracle
import pytest

from padlens.llm import warc
from padlens.llm.queries import op12_warc
from padlens.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
LOOKS = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
FAR = LOOKS.replace("Length: 5", "Length: 100000")
PAGES = [
    (1, "http://a/", "x" * 100),
    (2, None, "x" * 100),  # a revisit
    (2, "http://b/\r\nWARC-Type: odd", "x" * 100),
    (3, "", "x" * 99),
    (4, "u", "x" * 99),
    (5, "u", None),
    (6, "u", ""),
    (None, "u", "x" * 100),
    (-7, "ü", "日本 é 😀" * 30),
    (8, "u", LOOKS),
    (9, "u", "\r\n\r\n" + LOOKS * 3 + "WARC/1.1\r\n"),
    (10, "u", FAR * 20),
    (11, "u", "WARC/1.1\r\n" * 50),
    (12, "u", "y" * 9000),
    (13, "u", LOOKS * 90),
    (14, "u", LOOKS * 90),  # a revisit
    (15, "u", "WARC/1.WARC/1.1\r\nWARC/1.1\r"),
]


def plain(data):
    """Records of an archive from its start on, one by one."""
    out, at = [], 0
    while data.startswith(b"WARC/1.1\r\n", at):
        head = warc.header_of(data[at + 10 :])
        if not head:
            break
        begin = at + 10 + head[1]
        end = begin + int(head[0][b"content-length"])
        if end > len(data):
            break
        out.append((head[0][b"warc-record-id"].decode(), data[begin:end]))
        at = end + 4
    return out


def records(spark, path, **how):
    return sorted((r["headers"]["warc-record-id"], bytes(r["block"])) for r in warc.read(spark, path, **how).collect())


def expected(pages):
    first = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = i is not None and i > first.get(html, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


@pytest.fixture
def small_splits(spark):
    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [900, 7001, 1 << 20])
def test_pages_of_all_kinds_in_splits_of_any_size(spark, tmp_path, small_splits, size):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    table = spark.createDataFrame([(*p, 1, "k") for p in PAGES], "page_id long, url string, html string, n int, digest string")
    warc.write(table.repartition(2), path)
    want = sorted(r for f in glob.glob(f"{path[7:]}/part-*") for r in plain(open(f, "rb").read()))
    assert len(want) == len(PAGES)
    small_splits(size)
    found = warc.read(spark, path)
    assert sorted((r["headers"]["warc-record-id"], bytes(r["block"])) for r in found.collect()) == want
    assert sorted(map(tuple, warc.pages_of(found).collect()), key=str) == expected(PAGES)
    if size == 7001:
        assert records(spark, path, broadcast_splits=0) == want


@pytest.mark.parametrize("size", [400, 1500])
def test_broken_files(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    good = (LOOKS + LOOKS.replace("77", "78").replace("Length: 5", f"Length: {len(FAR * 30)}").replace("hello", FAR * 30) + LOOKS.replace("77", "79")).encode()
    want = []
    for i in range(12):
        data = good[: rng.randrange(len(good))] if i % 3 else good
        if i % 4 == 1:
            at = rng.randrange(len(data))
            data = data[:at] + b"junk" + data[at:]
        data = [data, b"junk" + data, b""][(i % 7 == 6) + (i == 9)]
        (tmp_path / f"f{i}").write_bytes(data)
        want += plain(data)
    small_splits(size)
    assert records(spark, f"file://{tmp_path}") == sorted(want)


def test_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.pages_of(warc.read(spark, path)).collect() == []


def test_given_table_and_sql(spark):
    got = op12_warc(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert oracle.differences(got, oracle.connect(SF), ORACLES["op12_warc"]) == ""
