import re

from lattica.llm import url_filter as u

URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://www.example.net/en", "http://example.net/en/", "http://net/", "http://net", "http://anet/x", "http://b.org/fr/2#t", "http://b.org/fr", "http://org/fr/", "http://x.example.com/de/9",
    "http://example.com/de/", "http://myexample.com/de/", "no scheme", "", None, "a://b://c/d", "http://h.com?x=/en/", "http://h.com#://", "ftp://u:p@H.Net:80/p", "http://é.net/ü?x", "http://x.net?y", "://net/z", "http://q.com/a\nb",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in u.HOST_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_parts_and_host_rules(spark):
    df = spark.createDataFrame([(k, x, "v", "h") for k, x in enumerate(URLS)], "page_id long, url string, verdict string, host string")
    got = {r["page_id"]: r for r in u.judge(df).collect()}
    verdicts = dict(u.HOST_RULES)
    for k, x in enumerate(URLS):
        host, path, rule = brute(x)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), x
        assert got[k]["verdict"] == verdicts[rule] if rule else got[k]["verdict"] in ("allow", "block")
    assert got[15]["verdict"] == "allow" and got[13]["by"] == "default"


def test_mined_rules_match_brute_force(spark):
    rows = [(f"http://{'spam' if k % 3 == 0 else 'good'}{k % 5}.com/{'buy' if k % 3 == 0 else 'read'}/{k}", "block" if k % 3 == 0 else "allow") for k in range(90)]
    labels = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)] + [(500, "http://new.com/buy/now"), (501, "http://new.com/read/this"), (502, "ftp://zzz/")] + [(503, rows[0][0])], "page_id long, url string")
    tokens = pages.select("url").distinct().select(u.F.col("url"), u.url_tokens(u.F.col("url"), *u.host_and_path(u.F.col("url"))).alias("tokens"))
    rules = u.mine(labels.join(tokens, "url").select("tokens", "label"))
    kept = rules.collect()
    assert kept and all(r["confidence"] >= 0.8 and r["support"] >= 0.02 and len(r["tokens"]) <= 3 for r in kept)
    decided = {r["key"]: r["verdict"] for r in u.match(tokens.select(u.F.col("url").alias("key"), "tokens"), rules).collect()}
    for row in tokens.collect():
        fired = [r for r in kept if set(r["tokens"]) <= set(row["tokens"])]
        best = max(fired, key=lambda r: (r["confidence"], r["support"], r["verdict"] == "block", r["rule_id"]), default=None)
        assert decided.get(row["url"]) == (best["verdict"] if best else None)
    assert decided["http://new.com/buy/now"] == "block" and decided["http://new.com/read/this"] == "allow"


def test_nothing(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
    one = u.judge(spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")).collect()
    assert one[0]["verdict"] == "allow"


def test_rules_with_tokens_of_all_rows_equal_those_of_plain_mining(spark):
    """Against counting all combinations of up to three tokens, with the same pruning."""
    import itertools
    import random

    rng = random.Random(3)
    rows = []
    for _ in range(60):
        own = {"all", "every"} | {t for t in "abcd" if rng.random() < 0.5}
        rows.append((sorted(own), "block" if "a" in own or rng.random() < 0.7 else "allow"))
    for rows_ in (rows, [(t, "block") for t, _ in rows[:40]] + rows[40:44]):
        n, found = len(rows_), {}
        tokens = sorted({x for t, _ in rows_ for x in t})
        for k in (1, 2, 3):
            for q in itertools.combinations(tokens, k):
                for y in ("allow", "block"):
                    have = [lab for t, lab in rows_ if set(q) <= set(t)]
                    hits = have.count(y)
                    if hits and hits / n >= 0.05 and hits / len(have) >= 0.8:
                        found[q, y] = hits / len(have)
        want = {(q, y): c for (q, y), c in found.items() if not any(set(p) < set(q) and z == y and d >= c for (p, z), d in found.items())}
        got = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in u.mine(spark.createDataFrame(rows_, "tokens array<string>, label string"), 0.05, 0.8).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
