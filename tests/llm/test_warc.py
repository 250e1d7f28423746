"""Archives written and read back, whatever their payloads and splits hold."""

import hashlib
from pathlib import Path

import pytest

from tessera.llm import warc

PAGES = "page_id bigint, url string, html string, record_type string, at string"
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def _expected(rows, least=100):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html)
        again = i is not None and to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (3, None, None), (4, "", ""), (5, "http://c/\r\nWARC/1.1\r\n", "short"), (6, "http://d/", "short"),
    (7, "http://e/", "before " + INNER * 3 + "after"), (8, "http://f/", INNER), (9, "http://g/WARC/1.1", "é" * 60), (10, "http://h/", "é" * 60),
    (11, "http://i/", "WARC/1.1\r\n" * 50), (12, "http://j/", "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <y>\r\nContent-Length: 99999\r\n\r\n" * 4), (None, "http://k/", "x" * 150),
    (13, "http://l/", "line\r\n\r\n" * 40), (14, "http://m/", "long words " * 3000), (15, "http://n/", INNER * 200),
]


def _read_back(spark, pages, path, split):
    warc.write_pages(pages, path)
    found = warc.read(spark, path, split_bytes=split)
    page = warc.page_of(found.record_id)
    return sorted(
        [tuple(r) for r in found.select(page, "payload_bytes", "payload_digest", "record_type", warc.page_of(found.refers)).collect()], key=str
    )


@pytest.mark.parametrize("split", [None, 499])
def test_payloads_that_look_like_records(spark, tmp_path, split):
    pages = _pages(spark, ROWS).coalesce(1)
    assert _read_back(spark, pages, str(tmp_path / "a"), split) == _expected(ROWS)


def test_many_splits_agree_with_one(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"{i % 7}" * (i % 5 * 60) + (INNER if i % 11 == 0 else "")) for i in range(300)]
    assert _read_back(spark, _pages(spark, rows).coalesce(2), str(tmp_path / "a"), 8192) == _expected(rows)


def test_payloads_come_back_whole(spark, tmp_path):
    warc.write_pages(_pages(spark, ROWS).coalesce(1), str(tmp_path / "a"))
    found = warc.read(spark, str(tmp_path / "a"), split_bytes=997, payloads=True)
    got = {r["record_id"]: r["payload"] for r in found.where("record_type = 'response'").collect()}
    assert bytes(got["<urn:x-tessera-page:7>"]).decode() == ROWS[6][2]
    assert bytes(got["<urn:x-tessera-page:15>"]).decode() == ROWS[15][2]
    assert found.where("record_type = 'revisit' and payload is not null").isEmpty()


def test_headers_that_hold_the_magic_bytes(spark, tmp_path):
    def record(i, body):
        return (
            f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-tessera-page:{i}>\r\nWARC-Target-URI: http://a/WARC/1.0\r\nX-Note: WARC/1.1\r\n WARC/1.1\r\n"
            f"X-Long: {'WARC/1. ' * 40}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
        )

    (tmp_path / "a").mkdir()
    Path(tmp_path / "a" / "one.warc").write_bytes("".join(record(i, "b" * i) for i in range(30)).encode())
    for split in (None, 128):
        found = warc.read(spark, str(tmp_path / "a"), split_bytes=split)
        assert sorted((r["record_id"], r["payload_bytes"]) for r in found.collect()) == sorted((f"<urn:x-tessera-page:{i}>", i) for i in range(30)), split


def test_a_broken_record_ends_its_chain_and_only_that(spark, tmp_path):
    def record(i, size):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-tessera-page:{i}>\r\nContent-Length: {size}\r\n\r\nbody\r\n\r\n"

    (tmp_path / "a").mkdir()
    Path(tmp_path / "a" / "one.warc").write_bytes("".join(record(i, 4 if i != 5 else 3) for i in range(10)).encode())
    Path(tmp_path / "a" / "two.warc").write_bytes("".join(record(i, 4) for i in range(20, 30)).encode())
    ids = sorted(r["record_id"] for r in warc.read(spark, str(tmp_path / "a"), split_bytes=200).collect())
    assert ids == sorted(f"<urn:x-tessera-page:{i}>" for i in [*range(5), *range(20, 30)])


def test_an_empty_table(spark, tmp_path):
    assert _read_back(spark, _pages(spark, ROWS).where("false"), str(tmp_path / "a"), None) == []


def test_hadoop_boundaries_of_pieces(spark, tmp_path):
    """Every split size gives the same pieces in the same order."""
    (tmp_path / "a").mkdir()
    data = (INNER * 40 + "WARC/1WARC/1.WARC/1.1\r\n" * 20).encode()
    Path(tmp_path / "a" / "one.warc").write_bytes(data)
    for split in (7, 64, 10_000):
        rows = warc.pieces(spark, str(tmp_path / "a"), split).collect()
        assert [bytes(r["piece"]) for r in sorted(rows, key=lambda r: r["block"])] == [p for p in data.split(warc.MAGIC)]
