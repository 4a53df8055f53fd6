import math
import re

from fleetpulse.llm.queries import URL_RULES
from fleetpulse.llm.url_filter import filter_urls, viterbi


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return (low(m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_segmentation():
    p = {w: math.log(n / 10) for w, n in (("cheap", 3), ("pills", 3), ("che", 2), ("ap", 2))}
    assert viterbi("cheappills", p, -5.0) == ["cheap", "pills"]
    assert viterbi("", p, -5.0) == []
    assert "".join(viterbi("qqcheapzz", p, -5.0)) == "qqcheapzz"


def test_rules_and_edge_cases(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com/en/2", "http://a.example.com/en", "http://x.net/es/1",
            "http://x.net/de/1", "http://x.org/fr/1", "http://com", "http://notcom/x", "a://b://c.com/x", "http://x.com?y/z", "http://x.net#/es/", "http://" + "ab" * 3000 + ".org/x", "://É.net/fr/\nx"]
    rows = [(i, u, None, "w") for i, u in enumerate(urls)] + [(1, "http://x.net/es/1", "<p>x net</p>", "w"), (None, "http://x.com/", "", "w")]
    got = filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string, tokens string"), URL_RULES).collect()
    want = sorted(str((i, *parts(u), rule(*parts(u))[0])) for i, u, *_ in rows)
    assert sorted(str((r["page_id"], r["host"], r["path"], r["rule"])) for r in got) == want
    for r in got:
        assert r["verdict"] == (rule(r["host"], r["path"])[1] or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in filter_urls(pages, URL_RULES).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        g = got[r["page_id"]]
        assert (g["host"], g["path"]) == parts(r["url"]) and g["rule"] == rule(g["host"], g["path"])[0]
    ruled = [g for g in got.values() if g["rule"]]
    assert sum((g["log_odds"] > 0) == (g["verdict"] == "block") for g in ruled) >= 0.85 * len(ruled)
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
