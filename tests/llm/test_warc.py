from collections import Counter

import brute

from trefoil.llm.warc import read_archives, write_archives


def test_archives(spark):
    big, small, tricky = "<p>" + "é" * 200, "<p>x", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9
    rows = [
        (5, "http://a/1", big, 1), (3, "http://a/2", big, 2), (3, "http://a/2", big, 3), (None, "http://a/3", big, 4), (9, None, big, None),
        (1, "u", small, 5), (1, "u", small, 5), (2, "u", small, 6), (7, "u\r\nv", None, 7), (8, "", "", 8), (10, "t", tricky, 9), (11, "t2", tricky, 9),
        (None, None, None, None), (12, "z", "\r\n\r\n" * 60, 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path, run = write_archives(pages)
    got = read_archives(spark, path, run).collect()
    want = Counter()
    data = [(p, (h or "").encode()) for p, _, h, _ in rows]
    seen = set()
    for p, b in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        if len(b) < 100 or b not in seen:
            want[p, len(b), brute.sha(b), "response", None] += 1
        else:
            want[p, len(b), brute.sha(b), "revisit", min(q for q, c in data if c == b and q is not None)] += 1
        seen.add(b)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(ids)
    responses = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    for r in got:
        if r["record_type"] == "revisit":
            first = responses[r["refers_to_id"]]
            assert first["page_id"] == r["refers_to"] and first["payload_digest"] == r["payload_digest"] and r["payload"] is None
        else:
            assert brute.sha(r["payload"]) == r["payload_digest"]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(spark, *write_archives(pages)).count() == 0
