import gzip
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import warc

LONG = "é" * 700
ROWS = [(1, "http://a/ b\r\nx", LONG), (2, None, LONG), (5, "http://c", LONG), (5, "http://c", LONG), (3, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "y" * 50_000), (None, "u", LONG), (9, "u", "z" * 1000), (10, "u", "w" * 999), (11, "u", "w" * 999)]


def expected():
    best = {}
    for page, _, html in ROWS:
        if len((html or "").encode()) >= 1000 and page is not None:
            best[html] = max(best.get(html, page), page)
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        keeper = best.get(html)
        revisit = keeper is not None and page != keeper
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def shown(df):
    assert df.filter("error is not null").count() == 0
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment,archive", [(16 * 1024, 4 << 20), (300, 1000)])
def test_round_trip(spark, segment, archive):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(4)
    archives = warc.write_archives(pages, segment=segment, archive=archive).cache()
    rows = warc.read_records(archives).cache()
    assert shown(rows) == expected()
    by_digest = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in ROWS}
    assert all(bytes(r["payload"]) == by_digest[r["payload_digest"]] for r in rows.filter("record_type = 'response'").collect())
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0
    zipped = spark.createDataFrame([(bytearray(gzip.compress(bytes(r["content"]))),) for r in archives.collect()], "content binary")
    assert shown(warc.read_records(zipped)) == expected()


def segments(html, segment=200):
    digest = hashlib.sha1(html.encode()).hexdigest()
    return list(warc.page_records(7, "u", html, digest, "response", None, segment))


def read(spark, records):
    return warc.read_records(spark.createDataFrame([(bytearray(b"".join(records)),)], "content binary")).collect()


def test_damage_is_told(spark):
    parts = segments("abc" * 400)
    assert len(parts) > 3
    assert read(spark, parts[::-1])[0]["error"] is None
    lost = read(spark, parts[:2] + parts[3:])
    assert len(lost) == 1 and "missing" in lost[0]["error"] and lost[0]["payload"] is None and lost[0]["page_id"] == 7
    headless = read(spark, parts[1:])
    assert len(headless) == 1 and "missing" in headless[0]["error"]
    wrong = [*parts[:-1], parts[-1].replace(b"Total-Length: ", b"Total-Length: 9")]
    assert "total length" in read(spark, wrong)[0]["error"]
    whole = segments("abc" * 400, 1 << 20)[0]
    assert "digest" in read(spark, [whole.replace(b"abcabc", b"abcabd", 1)])[0]["error"]
    with pytest.raises(ValueError):
        list(warc.parse_archive(whole[:-10]))


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked(body, size):
    assert warc.dechunked(warc.chunked(body, size)) == body


def test_chunk_extensions_and_damage():
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


@pytest.mark.parametrize("size", [b"-6", b"+3", b"0x3", b"1_0", b"", b"g", b"9" * 40])
def test_bad_chunk_sizes_end(size):
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabc\r\n" + size + b"\r\n")


def test_damaged_archives_are_error_rows(spark):
    one, two = (segments(x * 100, 1 << 20)[0] for x in ("first", "second"))
    both = one + two
    cases = {
        "cut short": (both[:-10], 1, 1),
        "junk between": (one + b"junk\r\n" + two, 2, 1),
        "junk before": (b"\0\1\2", 0, 1),
        "no length": (one.replace(b"Content-Length:", b"X:", 1) + two, 1, 1),
        "long length": (one.replace(b"Content-Length: ", b"Content-Length: 9", 1) + two, 0, 1),
        "huge length": (one.replace(b"Content-Length: ", b"Content-Length: 99999999999999999999", 1), 0, 1),
        "negative chunk": (one.replace(b"chunked\r\n\r\n1f4", b"chunked\r\n\r\n-f4", 1) + two, 1, 1),
        "bad page": (one.replace(b"Page-ID: 7", b"Page-ID: x", 1) + two, 1, 1),
        "bad digest": (one.replace(b"sha1:", b"sha1:!", 1) + two, 1, 1),
        "other digest": (one.replace(b"sha1:", b"md5:", 1) + two, 2, 0),
        "not text": (one.replace(b"WARC-Date: ", b"\xff\xfe: ", 1) + two, 2, 0),
        "gzip cut short": (gzip.compress(one) + gzip.compress(two)[:-20], 1, 1),
        "gzip broken": (gzip.compress(one) + b"\x1f\x8bjunk", 1, 1),
        "empty": (b"", 0, 0),
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, (v, *_) in cases.items()] + [("null", None)], "name string, content binary")
    assert warc.read_records(rows).filter("error is null").count() == sum(n for _, n, _ in cases.values())
    for name, (data, good, bad) in cases.items():
        got = warc._batch([warc._told(*f, True) for f in warc.scan_archive(data)]).to_pylist()
        assert (sum(r["error"] is None for r in got), sum(r["error"] is not None and r["payload"] is None for r in got)) == (good, bad), name


def test_hostile_segments_are_told(spark):
    parts = segments("abc" * 400)
    number = lambda n: [parts[0], parts[1].replace(b"Segment-Number: 2", b"Segment-Number: " + n)]
    for records in (number(b"99999999999999999"), number(b"x"), number(b"-1"), number(b"9" * 30), [parts[1].replace(b"WARC-Segment-Origin-ID", b"X")], [*parts[:-1], parts[-1].replace(b"Total-Length: ", b"Total-Length: x")]):
        rows = read(spark, records)
        assert rows and all(r["error"] and r["payload"] is None for r in rows)


@given(st.binary(max_size=200), st.integers(0, 600))
def test_no_archive_stops_the_reader(junk, at):
    whole = segments("abc" * 100, 1 << 20)[0]
    for data in (junk, whole[:at] + junk + whole[at:], gzip.compress(whole)[:at] + junk):
        assert all(isinstance(warc._told(*found, True), tuple) for found in warc.scan_archive(data))
