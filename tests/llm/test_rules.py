"""URL and quality rules: SQL, brute force and odd rows."""

from __future__ import annotations

import re

import pytest

from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import QUERIES, URL_RULES
from tessera.llm.quality import quality_rules
from tessera.llm.urls import url_verdicts
from tests.compare import connect, differences, unwanted_nodes
from tests.llm.conftest import ODD_ROWS

RULES = "host string, path string, verdict string"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    assert differences(QUERIES[name](spark, sf_dir), con, oracle_sql()[name]) == []


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_verdicts_of_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/es/x", "https://a.b.example.org/en/12",
        "https://notexample.org/es/", "ftp://x.com/fr/?a#b", "http://org/", "http://x.com/de/", "http://x.com?/de/",
        "http://x.com#/de/", "a://b.org/?u=http://c.com/de/", "http://.org/", "http://example.org./es/",
        "http://example.org:80/es/", "http://xorg/", "http://com/fr/", "HTTP://WWW.X.COM/DE/", "http://x.com/de",
    ] * 3
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*URL_RULES, ("x.com", "/de/", "block"), ("x.com", "/de/", "allow"), ("a.b.example.org", "/", "allow"), ("", "/", "block")]
    out = url_verdicts(table, spark.createDataFrame([*rules, (None, "/", "block")], RULES)).collect()
    got = {r["page_id"]: tuple(r)[1:] for r in out}
    usable = [r for r in rules if r[0]]
    assert got == {i: brute_verdict(u, usable) for i, u in enumerate(urls)}


def test_verdicts_of_no_rows_and_of_no_rules(spark):
    none = spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (None, None, None)],
                                  "page_id long, url string, key string")
    assert [r["verdict"] for r in url_verdicts(pages, none).collect()] == ["allow"] * 3
    assert url_verdicts(pages.limit(0), none).count() == 0


def test_quality_runs_in_the_engine_only(documents):
    assert [n for n in unwanted_nodes(quality_rules(documents)) if "Python" in n or "Arrow" in n or "Pandas" in n] == []


def brute_base(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows, covered = {}, set()
    for k in range(len(found) - 2):
        windows.setdefault(tuple(found[k : k + 3]), []).append(k)
    for places in windows.values():
        if len(places) > 1:
            covered.update(p + d for p in places for d in range(3))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def test_base_counts_of_odd_rows(odd, empty):
    got = quality_rules(odd).collect()
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((r[0], *brute_base(r[1])) for r in ODD_ROWS), key=key)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules(empty).count() == 0


def test_base_counts_with_repeats(spark):
    texts = ["a b c a b c a b", "a a a a", "x\n\ny\nx\n x\nx", "a b c d a b c", "#a *b $c%|<>&", "é ñ ß\n" * 3]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = sorted(tuple(r)[:7] for r in quality_rules(table).collect())
    assert got == [(i, *brute_base(t)) for i, t in enumerate(texts)]


def test_frequent_lines_are_removed(spark):
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    bar = " ".join(f"menu{k}" for k in range(40))
    rows = [(i, f"{bar.upper()}  \n{body(i, 60)}", "busy") for i in range(20)]
    rows += [(100 + i, f"{bar}\n{body(i + 100, 30)}", "busy") for i in range(5)]  # more menu than text
    rows += [(200, f"{bar}\n{body(200, 60)}", "quiet"), (201, body(201, 60), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality_rules(table, with_text=True).collect()}
    assert all(out[i]["kept"] and out[i]["n_words_removed"] == 40 and out[i]["clean_text"] == body(i, 60) for i in range(20))
    assert not any(out[100 + i]["kept"] for i in range(5))
    assert out[200]["kept"] and out[200]["n_lines_removed"] == 0 and out[201]["kept"]
