"""Archives read back by the chain of their records, whatever the payloads hold and however the files are split."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import queries, warc

from ..conftest import SMALL

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "u", None), (2, None, ""), (3, "a b\n", "x" * 99), (4, "c", "x" * 99), (5, "d", "y" * 100), (6, "e", "y" * 100), (None, "f", "y" * 100), (6, "e", "y" * 100),
    (7, "g", "<p>WARC/1.</p>" * 50), (8, "h", FAKE * 7), (9, "i", FAKE * 7 + "WARC/1.0\r\nContent-Length: 99999\r\n\r\n"), (10, "j", "é漢" * 80 + "\r\n\r\n" + FAKE),
    (11, "k", "z" * 300_000 + FAKE + "WARC/1"), (12, "l", "WARC/1."), (13, "m", FAKE * 7),
]


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html in first and i != first[html]
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


@pytest.fixture
def splits(spark):
    """Sets how many bytes a task reads of a file."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda most: [spark.conf.set(n, v) for n, v in zip(names, (most, "1"))]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    return df.withColumns({"digest": F.lit(1), "size": F.lit("clash"), "off": F.lit(None)})


@pytest.mark.parametrize("most", ["128m", "1k", "100b"])
@pytest.mark.parametrize("small", [warc.SMALL, 0])
def test_awkward_pages_come_back(spark, splits, most, small):
    rows = ROWS if most == "128m" else [r for r in ROWS if r[0] != 11]
    splits(most)
    got = [tuple(r) for r in warc.through_archives(pages(spark, rows), small=small).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_the_query_equals_brute_force(spark, duck):
    rows = duck.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert sorted(map(tuple, queries.op11_warc(spark, SMALL).collect()), key=str) == expected(rows)


def test_no_pages(spark):
    assert warc.through_archives(pages(spark, ROWS).where("false")).count() == 0


def test_string_ids(spark):
    df = pages(spark, ROWS).withColumn("page_id", F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 3, "0")))
    name = lambda i: None if i is None else f"p{i:03d}"
    got = sorted((tuple(r) for r in warc.through_archives(df).collect()), key=str)
    assert got == sorted([(name(i), n, d, t, name(r)) for i, n, d, t, r in expected(ROWS)], key=str)


def test_an_archive_of_other_origin(spark, tmp_path):
    """Records without HTTP, lower-case names, and bytes that aren't UTF-8 stay whole."""
    body = b"\xff\xfe WARC/1.0 \x00\r\n\r\nrest"
    one = b"WARC/1.1\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:a>\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    two = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(two + one + two)
    got = {r["off"]: (r["record_type"], r["record_id"], r["payload_bytes"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {0: ("warcinfo", "<urn:b>", 0), len(two): ("resource", "<urn:a>", len(body)), len(two + one): ("warcinfo", "<urn:b>", 0)}


def test_a_broken_chain_is_told(spark, tmp_path):
    whole = FAKE.encode() * 3
    (tmp_path / "a.warc").write_bytes(whole[:-20])
    with pytest.raises(warc.BrokenArchive):
        warc.read_archives(spark, str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path), strict=False).count() == 2
    (tmp_path / "a.warc").write_bytes(b"junk" + whole)
    with pytest.raises(warc.BrokenArchive):
        warc.read_archives(spark, str(tmp_path))


def test_a_wrong_digest_is_told(spark, tmp_path):
    pages(spark, ROWS[:3]).coalesce(1).createOrReplaceTempView("few")
    warc.write_archives(spark.table("few"), str(tmp_path / "w"))
    part = next(p for p in (tmp_path / "w").iterdir() if p.suffix == ".txt")
    os.remove(tmp_path / "w" / f".{part.name}.crc")
    part.write_bytes(part.read_bytes().replace(b"xxx", b"xyx", 1))
    with pytest.raises(warc.BrokenArchive):
        warc.read_archives(spark, str(tmp_path / "w"))
