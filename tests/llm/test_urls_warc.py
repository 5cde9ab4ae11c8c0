"""URL filters and archives."""

import base64
import gzip
import hashlib
import re

import pytest

from crewmetrics.llm import queries, url_filters, warc

RULES = queries.RULES


def expected(url):
    """host, path, rule, action of a url by the contract's words."""
    at = (url or "").find("://")
    if url is None or at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    None, "", "no scheme", "http://example.com/en/1", "https://WWW.Example.com/en/x?q#f", "http://a.b.example.com/en", "http://notexample.com/en/", "http://x.net/es/1#://z",
    "http://x.net/fr/", "http://net/es/", "http://x.net/de/", "http://com", "http://com/", "http://x.org/com/", "http://a://b.com/", "http://evil.net?/es/", "http://x.com:80/en/",
    "://x.net/es/", "http://example.com/en/\nx", "http:///en/", "http://.com/a",
]


def test_rules(shared):
    pages = shared.createDataFrame([(i, u, None, "z") for i, u in enumerate(URLS)], "page_id long, url string, html string, root string")
    got = {r.page_id: r for r in url_filters.judge(pages, RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, action = expected(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, action or "allow"), url


def test_block_decisions_follow_links(shared):
    canonical, refresh = '<LINK href="{}" rel=canonical>', "<meta http-equiv='Refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.org/x", canonical.format("http://spam.net/es/1")),  # alias of a blocked url that is no row
        (2, "http://b.org/y#top", refresh.format("http://a.org/x")),  # of an alias
        (3, "http://c.org/z", refresh.format("/w")), (4, "http://c.org/w", canonical.format("//spam.net/fr/2")),
        (5, "http://d.org/", canonical.format("http://e.com/ok") + refresh.format("http://spam.net/es/1?x")),  # an allowed alias wins
        (6, "http://spam.net/es/1?x", ""), (7, "http://f.org/", canonical.format("")), (8, "http://b.org/y", None), (8, "http://b.org/y", None),
        (9, None, canonical.format("http://spam.net/es/1")), (10, "http://www.example.com/en/", canonical.format("http://spam.net/es/1")),
        (11, "http://g.org/a/b", canonical.format("c")), (12, "http://g.org/a/c", canonical.format("http://spam.net/es/9")),
    ]
    table = shared.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge(table, RULES).collect()}
    # 1, 2, 8 and 10 share a component with an allowing rule (www.example.com/en/)
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "block"}
    without = table.where("page_id <> 10")
    got = {r.page_id: r.verdict for r in url_filters.judge(without, RULES).collect()}
    assert (got[1], got[2], got[8]) == ("block", "block", "block")
    told = shared.createDataFrame([("http://f.org/", "http://x.net/es/"), (None, "http://x.net/es/")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filters.judge(table, RULES, redirects=told).collect()}
    assert got[7] == "block"
    assert url_filters.judge(table.limit(0), RULES).collect() == []


def test_equally_long_rules_allow_first(shared):
    table = shared.createDataFrame([(1, "http://ab.com/ab", "")], "page_id long, url string, html string")
    row = url_filters.judge(table, [("b.com", "/ab", "block"), ("ab.com", "/a", "allow")]).first()
    assert (row.rule, row.verdict) == ("ab.com/a", "allow") or len("b.com/ab") != len("ab.com/a")
    with pytest.raises(ValueError):
        url_filters.judge(table, [("a.com", "/", "block")] * (url_filters.MAX_RULES + 1))


def test_no_python_in_url_filters(shared, folder):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.op4_url_filters(shared, folder).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


PAGES = [(1, "a"), (2, "b"), (3, "a"), (9, "a"), (4, None), (5, ""), (6, "é" * 100_000), (7, "x\r\n\r\ny"), (None, "b"), (9, "a"), (None, "only")]


def test_round_trip(shared):
    table = shared.createDataFrame([(k, f"http://u/{k} \n", t, 1) for k, t in PAGES], "page_id long, url string, html string, original int")
    rows = warc.with_originals(table, "page_id", "html")
    records = warc.read_archives(warc.write_archives(rows, "page_id", "html"), payloads=True).collect()
    assert len(records) == len(PAGES)
    got = sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or "") for r in records)
    largest = {}
    for k, t in PAGES:
        largest[t or ""] = max(largest.get(t or "") or -1, -1 if k is None else k)
    want = []
    for k, t in PAGES:
        raw, top = (t or "").encode(), largest[t or ""]
        later = k != top and top >= 0
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((f"<urn:page:{'' if k is None else k}>", "revisit" if later else "response", len(raw), digest, f"<urn:page:{top}>" if later else ""))
    assert got == sorted(want)
    payloads = {r.record_id: r.payload for r in records if r.record_type == "response"}
    assert bytes(payloads["<urn:page:6>"]).decode() == "é" * 100_000 and bytes(payloads["<urn:page:7>"]) == b"x\r\n\r\ny"
    assert warc.read_archives(warc.write_archives(rows.limit(0), "page_id", "html")).collect() == []


def test_small_payloads_are_all_responses(shared):
    table = shared.createDataFrame([(1, "a"), (2, "a"), (3, "long enough"), (4, "long enough")], "page_id long, html string")
    got = {r.page_id: r.original for r in warc.with_originals(table, "page_id", "html", least=5).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_members_stand_alone_and_damage_is_found():
    first, second = (warc.record(k, "http://u", p, None, "2024-01-01T00:00:00Z") for k, p in ((1, b"one"), (2, b"two" * 50_000)))
    assert gzip.decompress(first).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert [r["payload_bytes"] for r in warc.read_records(first + second)] == [3, 150_000]
    assert list(warc.read_records(b"")) == []
    plain = gzip.decompress(first)
    for broken in (first + second[:-9], gzip.compress(plain.replace(b"one", b"two")), gzip.compress(plain + b"x"), gzip.compress(plain.replace(b"Length: ", b"Length: 9")), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.read_records(broken))
