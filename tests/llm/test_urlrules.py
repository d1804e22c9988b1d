"""URL rules against trying every rule on every URL."""

import random

from tilespan.llm import urlrules

SCHEMA = "page_id long, url string, html string, host int, path int, rule int, digest string"
X = ("h", 1, 2, 3, "d")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len((h + p).encode()), len(h.encode()), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def urls(n=400):
    r = random.Random(2)
    hosts = ["com", "example.com", "WWW.Example.com", "wwwexample.com", "a.b.example.com", "x.net", "net", "notnet", "example.com:80", "u@example.com", "exämple.net", "", ".com", "a..com", "com."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/es/é", "/fr/?a", "/fr/#b", "?x=/en/", "#://y", "/a/b/c", "/é/漢", "/en/\n/es/"]
    fixed = [None, "", "no scheme", "://", "://net/es/", "mailto:x", "http:/com/", "http://", "a://b://com/", "http://com/" + "x" * 5000]
    return fixed + [r.choice(["http://", "https://", "HTTP://", "://"]) + r.choice(hosts) + r.choice(paths) for _ in range(n)]


def frame(spark, found):
    return spark.createDataFrame([(None if k == 7 else k, u, *X) for k, u in enumerate(found)], SCHEMA)


def rule_table(spark, rules):
    return spark.createDataFrame([(h, p, v, 1) for h, p, v in rules], "host string, path string, verdict string, digest int")


def answers(found):
    return sorted(((r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)


def test_query_rules(spark):
    rules = {(h, p): v for h, p, v in urlrules.RULES}
    got = urlrules.judge(frame(spark, urls()), urlrules.build(rule_table(spark, urlrules.RULES)))
    assert answers(got) == sorted((brute(u, rules) for u in urls()), key=str)
    assert {r.verdict for r in got.collect()} == {"allow", "block"}


def many_rules():
    r = random.Random(3)
    hosts = ["com", "net", "example.com", "www.example.com", "b.example.com", "x.net", "exämple.net", "org"] + [f"h{k}.org" for k in range(300)]
    return [(r.choice(hosts), r.choice(["", "/", "/en/", "/en/x", "/e", "/é", "/a/b/", "/es/", "/fr/"]), r.choice(["allow", "block"])) for _ in range(500)]


def test_many_rules_in_small_segments_with_colliding_digests(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "SEGMENT", 16)
    monkeypatch.setattr(urlrules, "BITS", 5)
    rules = {}
    for h, p, v in many_rules():
        rules[h, p] = max(v, rules.get((h, p), ""))
    index = urlrules.build(rule_table(spark, many_rules()))
    assert index.count() > 1 and index.agg({"rules": "sum"}).first()[0] == len(rules)
    assert answers(urlrules.judge(frame(spark, urls()), index)) == sorted((brute(u, rules) for u in urls()), key=str)


def test_segments_are_sorted_and_mapped(spark):
    index = urlrules.build(rule_table(spark, many_rules())).orderBy("first").collect()
    for r, after in zip(index, [*index[1:], None], strict=True):
        keys, offsets, strings = urlrules.mapped(r.folder, r.file)
        assert (keys[1:] >= keys[:-1]).all() and (keys[0], keys[-1]) == (r.first, r["last"]) and len(strings) == offsets[-1]
        assert after is None or after.first > r["last"]
        texts = [strings[a:b].tobytes().partition(b"\t")[2] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert urlrules.digests(texts).tolist() == keys.tolist()


def test_odd_rules_and_empty_tables(spark):
    odd = [(None, "/", "block"), ("com", None, "block"), ("", "/", "block"), ("a/b", "/", "block"), ("com", "en", "block"), ("com", "/?x", "block"), ("com", "/", None), ("COM", "/", "block"), ("com", "/", "allow")]
    got = urlrules.judge(frame(spark, urls()), urlrules.build(rule_table(spark, odd)))
    assert answers(got) == sorted((brute(u, {("com", "/"): "block"}) for u in urls()), key=str)
    none = urlrules.build(rule_table(spark, []))
    assert {(r.rule, r.verdict) for r in urlrules.judge(frame(spark, urls()), none).collect()} == {(None, "allow")}
    assert urlrules.judge(frame(spark, []), none).count() == 0


def test_index_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "MOST_BYTES", 10)
    index = urlrules.build(rule_table(spark, urlrules.RULES))
    try:
        urlrules.judge(frame(spark, urls()), index)
    except ValueError as e:
        assert "bytes" in str(e)
    else:
        raise AssertionError
