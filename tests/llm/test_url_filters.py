import math
import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import url_filters as u

SF = "/root/testdata/sf0.001"


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [
        (rule, verdict) for verdict, rule in u.RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/"):])
    ]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


URLS = [
    None, "", "nourl", "http://", "http://a.NET/x", "https://example.net/en/1?q", "https://EXAMPLE.com/de/2#f", "x://y://z/w",
    "http://b.org/fr/", "http://b.org/fr", "http://net", "http://net/", "http://xnet/", "http://m.example.net/en/", "http://u@h:80/p?a=1&b=2",
    "http://ÄB.example.com/de/x\ny", "http://" + "a" * 5000 + ".net/" + "b/" * 500,
]


def frame(spark, urls):
    return spark.createDataFrame([(i, x, "<p>", "h", 0.5) for i, x in enumerate(urls)], "page_id long, url string, html string, host string, depth double")


def test_rules_against_brute_force(spark):
    rows = {r.page_id: r for r in u.judge(frame(spark, URLS)).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), url
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")


def test_trees_learn_a_lexical_rule(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"http://{word()}.com/{word()}", 0) for i in range(300)] + [(300 + i, f"http://{word()}.com/{rng.randint(10**8, 10**9)}", 1) for i in range(300)]
    frame = u.with_suffixes(u.lexical(spark.createDataFrame(rows, "page_id long, url string, y int"), ()))
    model = u.fit(frame)
    right = frame.filter((model.probability() >= 0.5).cast("int") == frame.y).count()
    assert right >= 590


def site(rng, bad):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
    return f"http://{word()}.{{}}/{rng.randint(10**7, 10**9) if bad else word()}/{word()}"


def many_suffixes(seed=5, n=1200, domains=40):
    """URLs of domains that a rule blocks (paths of digits) or allows (paths of words)."""
    rng = random.Random(seed)
    names = [("block" if k % 2 else "allow", f"d{k}.com") for k in range(domains)]
    urls = [site(rng, verdict == "block").format(name) for verdict, name in (names[rng.randrange(domains)] for _ in range(n))]
    return [(verdict, f"{name}/") for verdict, name in names], urls


def test_unseen_suffixes(spark):
    """Whole suffixes are held out: only the words of a URL can tell."""
    rules, urls = many_suffixes()
    held = F.crc32(F.col("suffix").cast("binary")) % 3 == 0
    n, right = u.held_out_accuracy(frame(spark, urls), held, rules)
    assert n > 200 and right >= 0.9 * n


def test_no_label_is_read_from_the_suffix_statistics(spark):
    """Labels that a coin decided: a URL alone on its suffix, or one of many, tells nothing of its own."""
    rng = random.Random(11)
    names = [f"s{k}.com" for k in range(30)] * 20 + [f"t{k}.com" for k in range(40)]
    rules = [(rng.choice(["allow", "block"]), f"{name}/") for name in sorted(set(names))]
    judged = u.lexical(frame(spark, [site(rng, False).format(name) for name in names]), rules)
    rows = u.with_suffixes(judged).select("suffix", "fit.verdict", "suffix_blocked").collect()
    lone = [r for r in rows if r.suffix.startswith("t")]
    assert len(lone) == 40 and len({round(r.suffix_blocked, 9) for r in lone}) == 1  # the mean, whatever the label
    assert len(rows) == len(names)


def test_rules_on_one_path_do_not_condemn_the_domain(spark):
    urls = [f"http://a{k}.big.com/{'de' if k % 10 == 0 else 'en'}/x{k}" for k in range(400)] + [f"http://b{k}.bad.com/x" for k in range(40)] + [f"http://c{k}.good.com/x" for k in range(100)]
    rules = (("block", "big.com/de/"), ("block", "bad.com/"), ("allow", "good.com/"))
    rates = {r.suffix: r.m for r in u.with_suffixes(u.lexical(frame(spark, urls), rules)).groupBy("suffix").agg(F.avg("suffix_blocked").alias("m")).collect()}
    assert rates["good.com"] < rates["big.com"] < rates["bad.com"] and rates["big.com"] < 0.6


def brute_margin(model, row):
    def walk(node):
        return node if isinstance(node, float) else walk(node[2] if row[node[0]] <= node[1] else node[3])

    return model.base + sum(map(walk, model.trees))


def test_verdicts_follow_the_trees(spark):
    """Every score recomputed by walking the trees, and the margins that training saw."""
    rules, urls = many_suffixes(7, 300, 10)
    judged = u.with_suffixes(u.lexical(frame(spark, urls + ["http://x.org/1", None]), rules))
    model = u.fit(u.labelled_rows(judged))
    assert len(model.trees) == u.TREES
    for r in judged.withColumn("got", model.probability()).collect():
        assert abs(r.got - 1 / (1 + math.exp(-brute_margin(model, r)))) < 1e-9


def test_repeated_urls_do_not_grow_the_training_rows(spark, monkeypatch):
    rules, urls = many_suffixes(3, 200, 10)
    once = u.labelled_rows(u.with_suffixes(u.lexical(frame(spark, urls), rules)))
    sizes, grow = [], u._grow
    monkeypatch.setattr(u, "_grow", lambda cells, *a: (sizes.append(len(cells)), grow(cells, *a))[1])
    u.fit(once)
    first = max(sizes)
    sizes.clear()
    u.fit(once.crossJoin(spark.range(50).select("id")))
    assert max(sizes) == first
    u.fit(once, max_rows=17)
    assert min(sizes) == 17


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_registered_query_against_brute_force(spark):
    from marginalia.llm import queries

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op5_url_filters(spark, SF).collect()
    assert len(got) == len(pages) == len({r.page_id for r in got})
    for r in got:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))


def test_one_class_and_empty(spark):
    got = u.judge(frame(spark, ["http://a.net/", "http://b.net/"])).collect()
    assert {r.verdict for r in got} == {"block"}
    assert u.judge(frame(spark, [])).count() == 0
    assert u.judge(frame(spark, ["http://a.de/"])).count() == 1
