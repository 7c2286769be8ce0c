from pyspark.sql import functions as F

from tests.compare import differences
from textquarry.llm import url_templates as X

PAGES = "page_id long, url string, host string, template string"
LABELS = "doc_id long, quality int, toxic int"


def verdicts(spark, urls, labels, **parameters):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], PAGES)
    return {r.page_id: r for r in X.url_verdicts(df, spark.createDataFrame(labels, LABELS), **parameters).collect()}


def test_templates_and_purity(spark):
    urls = [f"http://a.org/good/{k}" for k in range(60)] + [f"https://A.org/bad/{k}?q=1" for k in range(100, 160)] + [f"http://b.org/u{k}/page" for k in range(40)]
    labels = [(k, 1, 0) for k in range(60)] + [(k, 0, 0) for k in range(100, 160)]
    got = verdicts(spark, urls, labels)
    assert {got[k].template for k in range(60)} == {"/good/*"} and {got[k].template for k in range(60, 120)} == {"/bad/*"}
    assert all(not got[k].rejected for k in range(60)) and all(got[k].rejected for k in range(60, 120))
    want = (0 + X.PRIOR * 0.5) / (60 + X.PRIOR)
    assert abs(got[70].purity - want) < 1e-6
    assert {(got[k].template, got[k].purity) for k in range(120, 160)} == {("/*/*", 0.5)}  # unlabelled: the share over all pages


def test_similar_branches_merge(spark):
    urls = [f"http://c.net/{s}/{k}" for s in ("en", "de") for k in range(50)]
    labels = [(k, k % 2, 0) for k in range(50)]
    got = verdicts(spark, urls, labels)
    assert {r.template for r in got.values()} == {"/*/*"}


def test_bad_section_among_many(spark):
    for sections in (20, 21, 60):
        urls = [f"http://d.org/s{k // 40}/{k}" for k in range(40 * sections)] + [f"http://d.org/slug{k}/x" for k in range(3)]
        bad = lambda k: k // 40 == 7 or k % 10 == 0
        got = verdicts(spark, urls, [(k, int(not bad(k)), 0) for k in range(40 * sections)])
        for k in range(40 * sections):
            assert got[k].rejected == (k // 40 == 7) and got[k].template == ("/s7/*" if k // 40 == 7 else "/*/*"), (sections, k)
        assert {got[k].template for k in range(40 * sections, len(urls))} == {"/*/*"}


def test_deep_paths_count_whole(spark):
    deep = "a/b/c/d"
    urls = [f"http://e.org/{deep}/good/{k}" for k in range(40)] + [f"http://e.org/{deep}/x/spam/{k}" for k in range(100, 140)] + [f"http://e.org/{deep}/{k}/7" for k in range(200, 210)]
    got = verdicts(spark, urls, [(k, 1, 0) for k in range(40)] + [(k, 0, 0) for k in range(100, 140)])
    assert {got[k].template for k in range(40)} == {"/*/*/*/*/good/*"} and {got[k].template for k in range(40, 80)} == {"/*/*/*/*/x/spam/*"}
    assert not any(got[k].rejected for k in range(40)) and all(got[k].rejected for k in range(40, 80))
    assert {got[k].template for k in range(80, 90)} == {"/*/*/*/*/**"}


def test_documents_of_a_column(spark):
    df = spark.createDataFrame([(k, f"http://f.org/{'good' if k < 40 else 'bad'}/p{k}", k) for k in range(80)], "page_id long, url string, shows long")
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], LABELS)
    got = {r.page_id: r.rejected for r in X.url_verdicts(df, labels, document=F.col("shows")).collect()}
    assert sorted(k for k in got if got[k]) == list(range(40, 80))
    assert not any(r.rejected for r in X.url_verdicts(df, labels).collect())  # no number in these paths


def test_many_branches_same_as_sql(spark, tmp_path):
    """Nodes of more than ``max_branches`` branches, and paths deeper than the tree."""
    urls = [f"http://d.org/s{k // 40}/{k}" for k in range(1600)] + [f"http://d.org/a/b/c/d/e{k % 30}/{k}/f" for k in range(600)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    bad = lambda k: k // 40 == 7 or k % 30 == 4 and k < 600 or k % 10 == 0
    spark.createDataFrame([(k, int(not bad(k)), 0) for k in range(1600)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    pages, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("pages", "labels"))
    import duckdb

    c = duckdb.connect()
    for name in ("pages", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, X.url_verdicts(pages, labels).collect()))
    assert got == sorted(c.execute(X.ORACLES["op3_url_templates"]).fetchall()) and len({r[3] for r in got}) > 3


def test_edges(spark):
    urls = [None, "", "no url", "http://h.com", "http://h.com/", "http://H.com//1///2.html#x", "http://h.com/a/b/c/d/e/f", "ftp://h.com/1", "http://h.com/a/b/c/d/e/f", "http://h.com/" + "x" * 100_000]
    got = verdicts(spark, urls, [(1, 0, 0), (1, 1, 0), (2, None, None), (None, 0, 1)])
    assert len(got) == len(urls)
    for k in range(3):
        assert got[k].host is None and got[k].template is None and not got[k].rejected
    assert got[3].template == got[4].template == "/" and got[5].host == "h.com" and got[6].template.endswith("/**") and got[6].template == got[8].template
    none = verdicts(spark, ["http://h.com/1"], [])
    assert not none[0].rejected and none[0].purity == 1.0
    assert verdicts(spark, [], []) == {}


def test_query_same_as_sql(spark, sf_dir):
    assert differences(X.op3_url_templates(spark, sf_dir), sf_dir, X.ORACLES["op3_url_templates"]) is None
