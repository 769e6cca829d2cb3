"""The URL model on words that its fit hasn't seen, and on hosts named from outside its table."""

from epochlake.llm import url_filter


def test_words_held_out_whole():
    found = url_filter.held_out()
    bad, good = ([p for p, y in found if y == k] for k in (1, 0))
    wins = sum((p > n) + (p == n) / 2 for p in bad for n in good) / (len(bad) * len(good))
    t = url_filter.chosen_threshold()
    blocked, wrong = sum(p >= t for p in bad) / len(bad), sum(p >= t for p in good) / len(good)
    print(f"by words left out: AUC {wins:.3f}, threshold {t:.2f}, blocked {blocked:.2f}, wrongly {wrong:.3f}")
    assert wins > 0.8 and blocked > 0.4 and wrong <= 0.02


def test_hosts_of_other_words(spark):
    bad = ["http://betfair.com/en", "https://stake.io/", "https://pornhub.com/view/3", "http://thepiratebay.se/", "https://onlyfans.com/a", "http://cheap-meds-4u.biz/cialis", "https://fmovies.to/home"]
    good = ["http://lighthouse-trust.net/visit", "https://riverside-primary.co.uk/term-dates", "http://geology.example.edu/rocks/4", "https://town-orchestra.de/programme", "http://plumbing-smith.com/prices", "https://www.beekeepers.info/honey"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=[]).collect()}
    assert [got[i] for i in range(len(bad))].count("block") >= 5
    assert all(got[i] == "allow" for i in range(len(bad), len(bad) + len(good)))


def test_very_long_urls(spark):
    url = "http://" + "a" * 50_000 + ".net/" + "é" * 50_000
    (row,) = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()
    assert (len(row["host"]), len(row["path"])) == (50_004, 50_001) and row["verdict"] in ("allow", "block")
