"""Queries: duplicates, sampling, sources, streams, relational extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textquarry.functions import text as T
from textquarry.functions.shared import shared_dir
from textquarry.operators import dedup as D, sampling as SA
from textquarry.plans.registry import docs, query, table
from textquarry.sources import readers as R, writers as WR
from textquarry.streaming import streams as ST

_KEYS = {"exact": "trim(regexp_replace(text, '\\s+', ' ', 'g'))", "lowercase": "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))", "normalized": "regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', '', 'g')"}


def _dedup(method, sql):
    @query(f"dedup_{method}", f"SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY {sql} ORDER BY doc_id) = 1")
    def _(spark, d):
        return D.dedup(docs(spark, d), method).select("doc_id", "text")


for _m, _s in _KEYS.items():
    _dedup(_m, _s)


@query("dedup_stats", f"WITH k AS (SELECT count(*) AS n FROM documents GROUP BY {_KEYS['exact']}) SELECT sum(n)::BIGINT AS total, count(*) AS unique_texts, (sum(n) - count(*))::BIGINT AS duplicates_found FROM k")
def _(spark, d):
    return D.dedup_stats(docs(spark, d))


_WS = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))"
_JACCARD = f"""WITH t AS (SELECT doc_id, {_WS} AS w FROM documents WHERE text <> ''),
s AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM t),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM s a JOIN s b ON a.word = b.word AND a.doc_id < b.doc_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM c WHERE k / (na + nb - k) >= 0.7"""


@query("dedup_jaccard_pairs", _JACCARD)
def _(spark, d):
    return D.jaccard_pairs(docs(spark, d), 0.7)


#: All pairs compared exactly: at this similarity 32 bands of 4 rows miss a pair with a probability below 1e-10.
_SIMILAR = f"""WITH t AS (SELECT doc_id, {_WS} AS w FROM documents WHERE text <> ''), k AS (SELECT min(doc_id) AS doc_id, list_sort(w) AS w FROM t WHERE len(w) > 0 GROUP BY 2),
s AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM k),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM s a JOIN s b ON a.word = b.word AND a.doc_id < b.doc_id AND a.n >= 0.85 * b.n AND b.n >= 0.85 * a.n GROUP BY ALL)
SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE len(w) > 0 AND doc_id NOT IN (SELECT doc_id FROM k)) AND doc_id NOT IN (SELECT b FROM c WHERE round(k / (na + nb - k), 6) >= 0.85)"""


@query("dedup_minhash", _SIMILAR)
def _(spark, d):
    return D.drop_similar(docs(spark, d), 0.85).select("doc_id", "text")


@query("dedup_minhash_greedy")
def _(spark, d):
    return D.drop_similar(docs(spark, d), 0.7, exact_greedy=True).select("doc_id", "text")


@query("union_sources", "SELECT 'documents' AS source, doc_id AS id, text, lang FROM documents UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark")
def _(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    return SA.union_sources({"documents": a, "benchmark": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")})


@query("ordered_distinct", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(spark, d):
    return SA.ordered_distinct(docs(spark, d))


@query("subset_range", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def _(spark, d):
    return SA.subset(docs(spark, d).select("doc_id", "text"), 100, 150)


@query("limit_after_filter", "SELECT doc_id, text FROM documents WHERE length(text) >= 500 ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return docs(spark, d).select("doc_id", "text").where(F.length("text") >= 500).orderBy("doc_id").limit(100)


@query("cumulative_offsets", "SELECT source, (sum(count(*)) OVER (ORDER BY source) - count(*))::BIGINT AS start, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    from pyspark.sql import Window as W

    c = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"))
    return c.select("source", (F.sum("n").over(W.orderBy("source")) - F.col("n")).alias("start"), "n")  # a row for each source


_KEY = "md5('42:' || doc_id::VARCHAR)"


@query("split_exact", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r")
def _(spark, d):
    return SA.split(docs(spark, d).select("doc_id"), {"train": 0.8, "valid": 0.1, "test": 0.1})


@query("shuffle_seeded", f"SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS position FROM documents")
def _(spark, d):
    return SA.with_position(docs(spark, d).select("doc_id", SA.shuffle_key(42).alias("k")), ["k", "doc_id"]).drop("k")


def _chance(tag):
    return f"('0x' || substr(md5('42:{tag}:' || draw), 1, 12))::BIGINT / 281474976710656.0"


@query("weighted_sample", f"WITH d AS (SELECT draw, CASE WHEN {_chance('s')} < 0.6 THEN 'src0' WHEN {_chance('s')} < 0.8 THEN 'src1' ELSE 'src2' END AS source, {_chance('r')} AS u FROM range(500) r(draw)), x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2')) SELECT source, doc_id, draw FROM d JOIN x USING (source) WHERE k = floor(u * n)")
def _(spark, d):
    return SA.weighted_sample(docs(spark, d).select("doc_id", "source"), {"src0": 3, "src1": 1, "src2": 1}, 500)


@query("set_operations", "(SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT item_id FROM benchmark")
def _(spark, d):
    return docs(spark, d).select("doc_id").intersect(table(spark, d, "labels").select("doc_id")).exceptAll(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")))


# ---- sources and sinks ----


def _folder(spark):
    return f"{shared_dir(spark)}/tq-{uuid.uuid4().hex}"


@query("jsonl_roundtrip", "SELECT doc_id, text, lang FROM documents WHERE text <> ''")
def _(spark, d):
    path = _folder(spark)
    WR.jsonl(docs(spark, d).select("doc_id", "text", "lang"), path, metadata={"name": "documents"})
    return R.bounded(R.jsonl(spark, path, schema="doc_id long, text string, lang string")).select("doc_id", "text", "lang")


@query("csv_roundtrip", "SELECT doc_id, text, lang FROM documents WHERE text <> ''")
def _(spark, d):
    path = _folder(spark)
    WR.csv(docs(spark, d), path, columns=["doc_id", "text", "lang"])
    return R.bounded(R.csv(spark, path, columns=["doc_id", "lang"], quoted_empty=True)).select(F.col("doc_id").cast("long"), "text", "lang")


@query("txt_roundtrip", "SELECT text FROM documents WHERE text <> ''")
def _(spark, d):
    path = _folder(spark)
    WR.txt(docs(spark, d).where("text <> ''"), path, separator="\x1e")
    return R.text_files(spark, path, by_line=True, separator="\x1e").select("text")


@query("json_path_events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.json_path(F.col("props"), "k").alias("k"))


@query("url_extract_pages", "SELECT page_id, CASE WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE html END AS title FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", R.extract_from_body(F.col("html"), pattern="<title>([^<]*)</title>").alias("title"))


@query("conversation_concat", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id")
def _(spark, d):
    x = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(x["t"], "\n").alias("text"), F.count("*").alias("turns"))


# ---- streams ----


@query("stream_dedup", "SELECT text FROM documents GROUP BY text")
def _(spark, d):
    s = ST.read(spark, f"{d}/documents.parquet", docs(spark, d).schema)
    path, ck = _folder(spark), _folder(spark)
    ST.first_of_key(s.select("text"), "exact").writeStream.format("parquet").option("path", path).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("text string").parquet(path)


@query("stream_word_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY word")
def _(spark, d):
    s = ST.read(spark, f"{d}/documents.parquet", docs(spark, d).schema)
    path, ck = _folder(spark), _folder(spark)
    q = ST.word_counts(s).writeStream.outputMode("complete").option("checkpointLocation", ck).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


@query("stream_event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    s = ST.read(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    path, ck = _folder(spark), _folder(spark)
    counts = ST.windowed_counts(s, "ts", "1 hour", "10 minutes", "event_type").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", ck).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


# ---- a whole corpus from a configuration ----


@query(
    "collect_corpus",
    """WITH t AS (SELECT 'documents' AS source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents UNION ALL SELECT 'benchmark', trim(regexp_replace(text, '\\s+', ' ', 'g')) FROM benchmark),
r AS (SELECT text, source, row_number() OVER (ORDER BY source, text) AS p FROM t WHERE length(text) BETWEEN 50 AND 5000)
SELECT text, source FROM r QUALIFY row_number() OVER (PARTITION BY text ORDER BY p) = 1""",
)
def _(spark, d):
    from textquarry.plans import pipeline as P

    sources = [{"name": n, "kind": "parquet", "path": f"{d}/{n}.parquet"} for n in ("documents", "benchmark")]
    config = P.config_from({"sources": sources, "clean": {"fix_html": False, "fix_unicode": False, "strip_accents": False}, "filter": {"min_length": 50, "max_length": 5000}})
    return P.collect(spark, config).select("text", "source")
