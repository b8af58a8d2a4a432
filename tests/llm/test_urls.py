import random

from pyspark.sql import functions as F
from tessella.llm import urls

SCHEMA = "page_id long, url string, html string, host string, rule int, score int"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for _, rule in urls.RULES:
        domain, prefix = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_rules_and_parts(spark):
    found = [None, "", "no scheme", "http://", "http://?a=1/b", "https://Example.COM/en/1", "x://www.example.com/en/", "x://a.www.example.com/en/", "x://badexample.com/en/", "x://example.com", "x://example.com/EN/", "x://a.net/es/", "x://net/fr/x?y#z", "x://É.net/fr", "x://a.com#/en/", "x://u:p@h.com:80/a://b", "://com/", "x://example.com/en/" + "a" * 50_000]
    rng = random.Random(4)
    found += [f"http://{rng.choice(['www.', '', 'm.'])}{rng.choice('ab')}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(999)}{rng.choice(['', '?a=1&b=2', '#t'])}" for _ in range(300)] * 2
    frame = spark.createDataFrame([(i, u, "", "", 1, 2) for i, u in enumerate(found)], SCHEMA)
    rows = {r.page_id: r for r in urls.judge(frame).collect()}
    verdicts = {rule: v for v, rule in urls.RULES}
    assert len(rows) == len(found)
    for i, u in enumerate(found):
        r = rows[i]
        assert (r.host, r.path, r.rule) == brute(u), u
        assert 0 <= r.score <= 1 and r.verdict == (verdicts[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")


def test_trees_learn(spark):
    rng = random.Random(6)
    rows = [(float(b), *[rng.random() + (b if i in (2, 5) else 0) for i in range(len(urls.FEATURES))]) for b in (rng.randrange(2) for _ in range(500))]
    frame = spark.createDataFrame(rows, "blocked double, " + ", ".join(f"{f} double" for f in urls.FEATURES))
    model = urls.train(frame, rounds=4)
    binned = frame.select("blocked", *[model.bins(f).alias(f) for f in urls.FEATURES])
    right = binned.where((model.margin() > 0) == (binned["blocked"] == 1)).count()
    assert right > 470


def held_out(frame):
    """(verdict, blocked, score) of labelled urls that were not learned: a quarter, by url."""
    learn = F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 4 != 2
    rows = urls.judge(frame, learn=learn).join(frame.where(~learn).select("page_id"), "page_id").where("rule IS NOT NULL").collect()
    return [(r.score >= 0.5, r.verdict == "block", r.score) for r in rows]


def test_held_out_urls_are_judged_right(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = held_out(pages)
    assert len(rows) > 200 and {truth for _, truth, _ in rows} == {True, False}
    assert sum(said == truth for said, truth, _ in rows) / len(rows) >= 0.95
    pos, neg = ([score for _, truth, score in rows if truth == k] for k in (True, False))
    assert sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) > 0.97
    found = {(r.rule is None, r.verdict): r["count"] for r in urls.judge(pages).groupBy("rule", "verdict").count().collect()}
    assert found[(True, "allow")] > 50 and found[(True, "block")] > 50


def test_statistics_leave_out_the_own_fold(spark):
    rows = [(i, i % 2, i % 3) for i in range(12)]
    frame = spark.createDataFrame(rows, "page_id long, blocked int, fold int").withColumns({k: F.lit(5).cast("long") if k == "suffix" else F.lit(6).cast("long") for k in urls.KINDS})
    got = {r.in_fold: (round(r.share, 9), round(2.718281828459045**r.known - 1)) for r in urls.statistics(frame).where("of = 5").collect()}
    for fold in (0, 1, 2):
        others = [b for _, b, f in rows if f != fold]
        assert got[fold] == (round((sum(others) + 1) / (len(others) + 2), 9), len(others))
    assert got[urls.FOLDS] == (round(7 / 14, 9), 12)


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
