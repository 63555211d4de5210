"""Where the URL filter's rejected examples come from."""

import random
import re

from pyspark.sql import functions as F

from ledgerlake.llm import common as C, url_filter


def test_bad_hosts_without_seed_words_rank_last_by_blocked_urls_and_are_blocked_by_labels(spark):
    C.prepare(spark)
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    clean = [f"http://{name()}.{rng.choice(['com', 'org'])}/{name()}/en" for _ in range(800)]
    clean += ["http://alphabets.org/en/a", "http://soundtrack.com/en/b"]
    lure = lambda tld: f"http://jackpotzz-{name()}.{tld}/xwin/{name()}"
    blocked, bad = [lure("net") for _ in range(300)], [lure("com") for _ in range(4)]
    urls = clean + blocked + bad
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    verdict = {u: got[i].verdict for i, u in enumerate(urls)}
    assert all(verdict[u] == "block" for u in blocked)
    assert all(verdict[u] == "allow" for u in clean[-2:]) and sum(verdict[u] == "block" for u in clean) <= 8
    by_score = sorted((got[i].score, u) for i, u in enumerate(urls) if got[i].rule is None)
    assert set(bad) <= {u for _, u in by_score[:8]} and by_score[0][0] < 0.2 * by_score[400][0]
    labelled = spark.createDataFrame([(u, True) for u in bad[:2]], "url string, rejected boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labelled=labelled).collect()}
    verdict = {u: got[i] for i, u in enumerate(urls)}
    assert all(verdict[u] == "block" for u in bad[:2]) and sum(verdict[u] == "block" for u in clean) <= 8


def test_seeds_are_whole_host_parts(spark):
    hosts = {"alphabets.org": False, "soundtrack.com": False, "free-bets.example.com": True, "m.ads-track.org": True, "carefree.net": False, "casino": True, "": False}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("bad", url_filter.seeded(F.col("host")))
    assert {r.host: r.bad for r in df.collect()} == hosts


def test_labelled_urls_of_the_caller_are_examples(spark):
    pages = C.table(spark, "/root/testdata/sf0.1", "pages")
    bad = "casino|cheap|spam|adult|free-|ads-"
    ruled = url_filter.match_rule(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), url_filter.RULES)[0].isNotNull()
    known = pages.where(ruled).select("url", F.rlike(url_filter.host_of(F.col("url")), F.lit(bad)).alias("rejected"))
    got = [r for r in url_filter.judge(pages, seeds=(), labelled=known).collect() if r.rule is None]
    wrong = [r for r in got if (r.verdict == "block") != bool(re.search(bad, r.host))]
    assert len(got) > 1000 and len(wrong) <= 0.02 * len(got)
