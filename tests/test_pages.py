from urllib.robotparser import RobotFileParser

import pytest

from pyspark.sql import functions as F

from corpusloom.operators import pages as P

AGENT = P.USER_AGENT
POLICIES = {
    "one.example": "User-agent: *\nAllow: /a/open\nDisallow: /a/\n",
    "two.example": "User-agent: *\nDisallow: /\n\nUser-agent: rag-bot\nDisallow: /x\n",
    "three.example": "User-agent: other\nDisallow: /\n",
    "four.example": "User-agent: *\nDisallow:\n",
    "five.example": "User-agent: *\nDisallow: /\n",
    "port.example:8080": "User-agent: *\nDisallow: /p\n",
    "six.example": "User-agent: webscraper\nDisallow: /w\n\nUser-agent: RAG-Bot\nDisallow: /r\n",
}
PATHS = ["", "/", "/a/", "/a/open", "/a/shut", "/x", "/xy?q=1", "/p", "/w", "/r", "/b#/a/"]


def rules_of(host, text):
    order, agent = 0, None
    for line in text.splitlines():
        if not line:
            continue
        name, value = (part.strip() for part in line.split(":", 1))
        if name == "User-agent":
            agent = value
        else:
            order += 1
            yield (host, agent, order, value, name == "Allow")


def test_robots_decisions_agree_with_the_standard_parser(spark):
    rules = [rule for host, text in POLICIES.items() for rule in rules_of(host, text)]
    urls = [f"http://{host}{path}" for host in [*POLICIES, "none.example"] for path in PATHS]
    expected = {}
    for url in urls:
        host = url.split("/")[2].split("#")[0]
        parser = RobotFileParser()
        parser.parse(POLICIES.get(host, "").splitlines())
        expected[url] = parser.can_fetch(AGENT, url)
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame(rules, "host string, agent string, rule_order int, path_prefix string, allow boolean")
    got = {r["url"]: r["allowed"] for r in P.robots_decisions(pages, table).collect()}
    assert got == expected


def test_join_does_not_multiply_pages(spark):
    pages = spark.createDataFrame([("http://h/a", 1), ("http://h/a", 2)], "url string, page_id bigint")
    rules = spark.createDataFrame(
        [("h", "*", n, "/a", n % 2 == 0) for n in range(20)],
        "host string, agent string, rule_order int, path_prefix string, allow boolean",
    )
    got = P.robots_decisions(pages, rules).collect()
    assert len(got) == 2 and all(r["allowed"] for r in got)


def test_first_seen_with_a_hot_url(spark):
    rows = [("hot", n) for n in range(500)] + [(f"u{n}", n) for n in range(50)]
    got = P.first_seen(spark.createDataFrame(rows, "url string, n bigint").repartition(5), "url", ["n"])
    assert {r["url"]: r["n"] for r in got.collect()} == {"hot": 0, **{f"u{n}": n for n in range(50)}}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_failures_stay_due(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "url string, n bigint")
    done = spark.createDataFrame([("a",)], "url string")
    assert {(r["url"], r["n"]) for r in P.not_yet_done(rows, done, "url", ["n"]).collect()} == {("b", 2), ("c", 4)}


def test_latest_version(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "url string, v int, x string")
    assert {r["url"]: r["x"] for r in P.latest_version(rows, "url", ["v"]).collect()} == {"a": "new", "b": "x"}


@pytest.mark.parametrize("url, ok", [("http://x", True), ("ftp://x", False)])
def test_split_by_scheme(spark, url, ok):
    assert P.split_by_scheme(spark.createDataFrame([(url,)], "url string")).first()["accepted"] is ok


QUOTED = {
    "q.example": "User-agent: *\nDisallow: /a b\nDisallow: /caf%C3%A9/\nAllow: /x%2Fy\nDisallow: /x\nDisallow: /p%ZZ\nDisallow: /q?k=%20\nDisallow: /plus+",
    "r.example": "User-agent: *\nDisallow: /%7Ejoe/\nDisallow: /ü",
}
QUOTED_PATHS = [
    "/a%20b", "/a b/c", "/a+b", "/café/1", "/caf%c3%a9/2", "/cafe", "/x/y", "/x%2fy/z", "/x", "/p%ZZ1", "/p%25ZZ", "/q?k=%20v", "/q?k=v",
    "/plus+", "/plus%2B", "/plus%20", "/~joe/a", "/%7ejoe/a", "/%C3%BCber", "/über", "/100%", "",
]


def test_quoted_paths_agree_with_the_standard_parser(spark):
    rules = [rule for host, text in QUOTED.items() for rule in rules_of(host, text)]
    urls = [f"http://{host}{path}" for host in QUOTED for path in QUOTED_PATHS]
    expected = {}
    for url in urls:
        parser = RobotFileParser()
        parser.parse(QUOTED[url.split("/")[2]].splitlines())
        expected[url] = parser.can_fetch(AGENT, url)
    assert len(set(expected.values())) == 2
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame(rules, "host string, agent string, rule_order int, path_prefix string, allow boolean")
    got = {r["url"]: r["allowed"] for r in P.robots_decisions(pages, table).collect()}
    assert {u: a for u, a in got.items() if a != expected[u]} == {}


def test_a_hot_host_goes_to_many_tasks(spark):
    pages = spark.range(4000).selectExpr("concat('http://hot/', id) AS url", "id")
    rules = spark.createDataFrame([("hot", "*", 1, "/1", False)], "host string, agent string, rule_order int, path_prefix string, allow boolean")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        decided = P.robots_decisions(pages, rules)
        sizes = [r["n"] for r in decided.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 2000
        assert decided.filter("NOT allowed").count() == 1111
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
