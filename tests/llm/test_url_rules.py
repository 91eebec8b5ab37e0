"""The URL filter against plain rules and all combinations of tokens."""

from __future__ import annotations

import itertools
import re
from collections import Counter

from conftest import SMALL
from textloom.llm import queries, storage, url_rules

LISTED = dict(queries.HOST_RULES)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_listed(host, path):
    fits = [r for r in LISTED if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def plain_tokens(url):
    host, _ = plain_parts(url)
    rest = re.sub(r"^[^/?#]*", "", url.split("://", 1)[1]) if url and "://" in url else ""
    words = lambda text, kind: [kind + ("0" if re.fullmatch("[0-9]+", w) else w) for w in re.split(r"[\W_]+", text.lower()) if w]
    return sorted({*words(host, "h:"), *words(rest, "p:")})


def plain_mine(rows, min_support, min_count, min_confidence, max_share):
    """All combinations of tokens, counted one by one."""
    n = len(rows)
    often = Counter(t for tokens, _ in rows for t in tokens)
    dull = {t for t, c in often.items() if c > max_share * n}
    both, alone = Counter(), Counter()
    for tokens, bad in rows:
        kept = [t for t in tokens if t not in dull]
        for k in range(1, len(kept) + 1):
            for combination in itertools.combinations(kept, k):
                alone[combination] += 1
                both[combination] += bad
    least = max(min_support, min_count / n) * n
    rules = {c: both[c] / alone[c] for c in both if both[c] >= least - 1e-9 and both[c] / alone[c] >= min_confidence}
    return {c: conf for c, conf in rules.items() if not any(set(o) < set(c) and rules[o] >= conf for o in rules)}


def plain_verdicts(pages, labels, **mining):
    said = {}
    for i, bad in labels:
        if i is not None and bad is not None:
            said[i] = said.get(i, False) or bad
    rules = plain_mine([(plain_tokens(u), said[i]) for i, u in pages if i in said], **mining)
    out = []
    for i, url in pages:
        host, path = plain_parts(url)
        rule = plain_listed(host, path)
        hit = any(set(c) <= set(plain_tokens(url)) for c in rules)
        out.append((i, host, path, rule, LISTED[rule] if rule else "block" if hit else "allow"))
    return out, rules


ODD = [None, "", "no scheme", "://", "http://", "http://net", "http://NET/", "http://x.NET?/", "http://annet/", "http://a.example.net/en/1", "http://example.net/en", "https://ÄB.Example.COM/de/#x", "http://org/fr/?q", "http://a.org/fr", "a://b://c.net/", "http://x.net:80/", "http://n\nl.net/a\nb?x", "http://x.example.com/de/" + "long/" * 200_000]
MINING = {"min_support": 0.02, "min_count": 3, "min_confidence": 0.6, "max_share": 0.9}


def fixture():
    pages = [(i, f"https://{'bad' if i % 3 == 0 else 'good'}-{'shop' if i % 4 else 'farm'}.example.{('com', 'org')[i % 2]}/{('en', 'es', 'it')[i % 3 if i % 5 else 0]}/{i}{('', '.html', '?ref=x')[i % 7 % 3]}") for i in range(120)]
    labels = [(i, i % 3 == 0 and i % 4 == 0) for i in range(0, 120, 2)] + [(4, None), (None, True), (6, True), (6, False), (9999, True)]
    return pages + [(1000 + k, u) for k, u in enumerate(ODD)] + [(5, pages[5][1]), (None, pages[3][1])], labels


def same(got, want):
    key = lambda r: tuple(map(repr, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_verdicts(spark):
    pages, labels = fixture()
    want, rules = plain_verdicts(pages, labels, **MINING)
    assert rules and {w[4] for w in want if w[3] is None} == {"allow", "block"}
    frame = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, host string, verdict int")
    got = url_rules.judge(frame, spark.createDataFrame(labels, "id long, bad boolean"), queries.HOST_RULES, **MINING)
    assert got.columns == ["page_id", "url", "host", "verdict", "_host", "path", "rule", "_verdict", "pattern", "confidence"]
    rows = got.collect()
    same([(r["page_id"], r["_host"], r["path"], r["rule"], r["_verdict"]) for r in rows], want)
    assert {tuple(r["pattern"].split()) for r in rows if r["pattern"]} <= set(rules)


def test_mined_rules(spark):
    pages, labels = fixture()
    said = dict(labels)
    rows = [(plain_tokens(u), said[i]) for i, u in pages if said.get(i) is not None]
    with storage.Scratch(spark) as scratch:
        found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), scratch, **MINING).collect()
    got = {tuple(r["tokens"]): round(r["confidence"], 9) for r in found}
    assert got == {c: round(v, 9) for c, v in plain_mine(rows, **MINING).items()}


def test_query(spark):
    """The registered query with its own parameters."""
    table = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").collect()
    pages = [(r["page_id"], r["url"]) for r in table("pages")]
    labels = [(r["doc_id"], r["toxic"] == 1 or r["quality"] == 0) for r in table("labels")]
    want, _ = plain_verdicts(pages, labels, min_support=0.01, min_count=10, min_confidence=0.5, max_share=0.9)
    same([tuple(r)[:5] for r in queries.QUERIES["op12_association_url_filter"](spark, SMALL).collect()], want)


def test_empty(spark):
    none, pages = spark.createDataFrame([], "id long, bad boolean"), spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_rules.judge(pages.limit(0), none, queries.HOST_RULES).collect() == []
    assert url_rules.judge(pages, none, queries.HOST_RULES).first()["verdict"] == "allow"
