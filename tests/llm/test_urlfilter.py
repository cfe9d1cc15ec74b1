"""URL filters against a literal reading of the rules, and their edge cases."""

import random

import numpy as np
import pytest

from panelrisk.llm import urlfilter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def literal(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, keep=("page_id",), **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlfilter.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), list(keep), **more)
    return sorted(tuple(r) for r in out.collect())


def test_rules_of_the_contract(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?x=/en/", "http://inet/", "https://www.Example.NET/en/1",
        "https://example.net/en", "https://example.net/en/#top", "https://notexample.net/en/", "http://example.com/de/5?x", "http://example.com/DE/5", "http://b.org/fr/1",
        "http://a.net:80/", "http://a.net./", "x://y://net/", "http://a\nb.net/", "http://ü.net/é/", "http://" + "a." * 3000 + "net/" + "x/" * 5000, "http://a.net/#/en/", "http://.net/", "http://net/",
    ]
    assert judged(spark, urls, RULES) == [(i, *literal(u, RULES)) for i, u in enumerate(urls)]


def test_many_entries_against_brute_force(spark):
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("ab.") for _ in range(n))
    rules = {(name(rng.randrange(5)), "/" * rng.randrange(2) + "".join(rng.choice("xy/") for _ in range(rng.randrange(4)))): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = [f"http://{name(rng.randrange(9))}/{''.join(rng.choice('xy/?#') for _ in range(rng.randrange(7)))}" for _ in range(400)]
    assert judged(spark, urls, rules, default="unlisted") == [(i, *literal(u, rules, "unlisted")) for i, u in enumerate(urls)]


@pytest.mark.parametrize("blocks", [1, 4])
def test_a_full_filter_changes_nothing(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", blocks)
    rules = [("block", f"h{i}.com", f"/{i}") for i in range(500)]
    urls = [f"http://www.h{i}.com/{j}" for i in range(0, 500, 7) for j in (i, i + 1)]
    assert judged(spark, urls, rules) == [(i, *literal(u, rules)) for i, u in enumerate(urls)]


def test_filter_knows_every_key_and_few_others():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20000).astype(np.uint64)
    table = np.zeros((20000 * urlfilter.BITS // 512, urlfilter.WORDS), np.uint64)
    np.bitwise_or.at(table, urlfilter._blocks_of(keys, len(table)), urlfilter._masks(keys))
    assert urlfilter._known(table, keys).all()
    assert urlfilter._known(table, rng.integers(0, 2**63, 50000).astype(np.uint64)).mean() < 0.005


def test_names_repeats_and_empty_tables(spark):
    rows = [(1, "http://a.net/", "kept", 5, "odd")] * 3 + [(None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, c0 int, `od.d` string")
    listing = spark.createDataFrame([*RULES, ("allow", "net", "/"), (None, "x", "/"), ("block", None, "/"), ("block", "zzz", None)], "verdict string, host string, path string")
    out = urlfilter.judge(pages, listing, pages.columns)
    assert out.columns == ["page_id", "url", "c0", "od.d", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "http://a.net/", 5, "odd", "a.net", "/", "net/", "block")] * 3 + [(None, None, None, None, "", "", None, "allow")]))
    assert urlfilter.judge(pages.limit(0), listing, ["page_id"]).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, listing.limit(0), ["page_id"]).collect()} == {"allow"}
