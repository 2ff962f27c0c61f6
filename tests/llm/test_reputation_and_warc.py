import hashlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import queries, reputation, warc
from tests.llm.helpers import write

PAGES = "page_id long, url string, html string, host string, digest string"


def test_urls_and_rules(spark):
    cases = {
        "https://A.Example.ORG/en/12?q#x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, None),
        "http://notexample.org/es/x": ("notexample.org", "/es/x", "org/", "allow"),
        "x://c.com/de/1": ("c.com", "/de/1", "com/de/", "block"),
        "x://c.com/fr/#a": ("c.com", "/fr/", "com/fr/", "allow"),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no scheme": ("", "", None, None),
        "ÀB://ÀB/x": ("Àb", "/x", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = reputation.split_url(F.col("url"))
    df = df.select("url", host.alias("host"), path.alias("path"))
    rule, verdict = reputation.rule_columns(F.col("host"), F.col("path"))
    for r in df.select("url", "host", "path", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r


def test_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.example.com:80": ("example.com", "com"), "u@example.com": ("example.com", "com"), "host": ("host", "host"), "": ("", "")}
    d, s = reputation.domain_columns(F.col("h"))
    for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", d.alias("d"), s.alias("s")).collect():
        assert (r.d, r.s) == hosts[r.h]


def test_bad_host_is_blocked_and_small_ones_shrink(spark):
    pages = [(i, f"http://bad.example.net/p{i}", "", "clash", "x") for i in range(40)]
    pages += [(100 + i, f"http://good.example.net/p{i}", "", None, None) for i in range(40)]
    pages += [(200, "http://new.example.net/", None, "", ""), (201, None, None, None, None), (200, "http://new.example.net/", None, "", "")]
    labels = [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)] + [(200, None, None), (None, 0, 1), (100, 0, 0)]
    df, ls = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = reputation.judge(df, ls).collect()
    assert len(rows) == len(pages)
    assert {r.verdict for r in rows if r.host == "bad.example.net"} == {"block"}
    assert {r.verdict for r in rows if r.host != "bad.example.net"} == {"allow"}
    assert {r.verdict for r in reputation.judge(df, ls.limit(0)).collect()} == {"allow"}
    assert reputation.judge(df.limit(0), ls).count() == 0


def expected(rows):
    texts = [(i, h or "") for i, _, h, *_ in rows]
    out = []
    for i, h in texts:
        raw = h.encode()
        same = [j for j, g in texts if g == h and j is not None]
        owner = max(same) if same and len(raw) >= 1000 and sum(g == h for _, g in texts) > 1 else None
        revisit = owner is not None and i != owner
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 500
    rows = [(1, "http://a/\r\nX: y", big, "h", "d"), (5, "u", big, None, None), (3, None, big, "h", "d"), (None, "n", big, "h", "d"), (7, "v", "x" * 999, "h", "d"), (8, "v", "x" * 999, "h", "d"), (9, "w", None, "h", "d"), (10, "w", "", "h", "d"), (5, "u", big, None, None), (11, "z", "y" * 200_000, "h", "d")]
    pages = spark.createDataFrame(rows, PAGES)
    write(pages, tmp_path, "pages")
    got = [tuple(r) for r in queries.op9_warc_archive(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == expected(rows)
    path = str(tmp_path / "archive")
    warc.write_archive(spark, pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc.reconstruct(spark, path).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert block[-4:] == b"\r\n\r\n" and len(block) - 4 == int(fields[b"Content-Length"])
        if fields[b"WARC-Type"] == b"response":
            assert hashlib.sha1(block[:-4]).hexdigest().encode() == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_a_damaged_payload_is_found(spark, tmp_path):
    path = str(tmp_path / "bad")
    warc.write_archive(spark, spark.createDataFrame([(1, "u", "text", "h", "d")], PAGES), path)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc._verified(spark, path).collect()


def test_the_archive_as_plain_files(spark, tmp_path):
    rows = [(1, "http://a/é", "é\r\n\r\nWARC/1.1\r\n" * 100, "h", "d"), (2, "http://b/", "é\r\n\r\nWARC/1.1\r\n" * 100, "h", "d"), (3, "u", None, "h", "d"), (4, "u", "\r\n\r\n", "h", "d")]
    path = str(tmp_path / "archive")
    warc.write_archive(spark, spark.createDataFrame(rows, PAGES), path)
    warc.write_warc(spark, path, str(tmp_path / "files"))
    data, found = b"".join(f.read_bytes() for f in sorted((tmp_path / "files").glob("part-*"))), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        found.append(head + b"\r\n\r\n" + rest[: n + 4])
        data = rest[n + 4 :]
    assert sorted(found) == sorted(bytes(r.record) for r in warc.reconstruct(spark, path).collect())


def test_a_payload_of_very_many_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_DIGESTS", 0)
    hot = "h" * 1200
    rows = [(i if i % 5 else None, f"http://a/{i}", hot if i % 3 else f"page {i}", "h", "d") for i in range(600)]
    rows += [(900 + i, "u", None, "h", "d") for i in range(200)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, PAGES)).collect()
    owner = max(r[0] for r in rows if r[2] == hot and r[0] is not None)
    want = []
    for i, _, html, *_ in rows:
        own = hot if html == hot else html or ""
        revisit = own == hot and i != owner
        want.append((i, len(own), hashlib.sha1(own.encode()).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_host_of_very_many_pages_and_repeated_ids(spark, monkeypatch):
    rows = [(k % 7 if k % 3 else None, f"http://{'hot.example.net' if k % 4 else f'h{k}.example.com'}/p{k}", "x", "h", "d") for k in range(400)]
    pages = spark.createDataFrame(rows, PAGES)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7) for _ in range(2)], "doc_id long, quality int, toxic int")
    seen = []
    for small in (200_000, 0):
        monkeypatch.setattr(reputation, "SMALL_HOSTS", small)
        seen.append(sorted(str(tuple(r)) for r in reputation.judge(pages, labels).collect()))
    assert len(seen[0]) == 400 and seen[0] == seen[1]
    bound = {r.host: r.bad_bound for r in reputation.judge(pages, labels).collect()}
    hot = [r for r in rows if "hot." in r[1] and r[0] is not None]
    assert 0.2 < bound["hot.example.net"] < sum(r[0] % 2 == 0 for r in hot) / len(hot)
