import gzip
import hashlib

import pytest

from concord.llm import warc


def test_copies_repeats_and_edges(spark, tmp_path):
    big, odd = "x" * 200, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\né" + "y" * 100
    rows = [(5, "http://a", big), (3, "http://b", big), (3, "http://b", big), (None, "c", big), (9, None, odd), (8, "http://\r\nd", odd), (1, "e", None), (2, "f", ""), (7, "g", "short"), (6, "h", "short"), (10, "i", "z" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["record_type"], r["refers_to"]))
    assert by[5] == [("revisit", 3)] and by[None] == [("revisit", 3)] and sorted(by[3], key=str) == [("response", None), ("revisit", 3)]
    assert by[9] == [("revisit", 8)] and by[8] == [("response", None)]
    assert all(by[i] == [("response", None)] for i in (1, 2, 6, 7, 10))
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html[r["id"]]), hashlib.sha256(html[r["id"]]).hexdigest())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html[r["id"]]
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.gz"))
    assert len(list(warc.records(data))) == len(rows)
    with pytest.raises(ValueError):
        list(warc.records(data[:-5]))
    empty = str(tmp_path / "empty")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0
