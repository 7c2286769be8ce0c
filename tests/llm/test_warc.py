import gzip
import hashlib
import io
import random

from tests.compare import differences
from textquarry.llm import warc_chunks as X

SCHEMA = "page_id long, url string, html string, uri string, i int"


def brute(payload, size):
    parts = [payload[k : k + size] for k in range(0, len(payload), size)] or [b""]
    return [(k, k * size, len(p), p, hashlib.sha1(payload[: k * size + len(p)]).hexdigest(), k == len(parts) - 1) for k, p in enumerate(parts)]


def chunks_of(data, size=100):
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BufferedReader(io.BytesIO(data))
    return list(X.read_chunks(f, "f", size))


def test_chunks_against_brute_force():
    r = random.Random(1)
    payloads = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 99, 100, 101, 1000)] + [b"\r\n\r\nWARC/1.0\r\n" * 30]
    plain = b"".join(b"".join(X.record(f"urn:{k}", f"http://h/{k}", p)) for k, p in enumerate(payloads))
    zipped = b"".join(gzip.compress(b"".join(X.record(f"urn:{k}", f"http://h/{k}", p))) for k, p in enumerate(payloads))
    for data in (plain, zipped, gzip.compress(plain)):
        rows = chunks_of(data)
        for k, p in enumerate(payloads):
            own = [x for x in rows if x[1] == k]
            assert [(x[5], x[6], x[7], x[8], x[9], x[10]) for x in own] == brute(p, 100)
            assert all(x[2] == f"urn:{k}" and x[4] == f"http://h/{k}" and x[11] for x in own) and own[-1][12] is True


def test_long_urls():
    for n in (65_519 - 1, 65_519, 65_519 + 1, 70_000, 200_000):  # with 65,519 the header's first 65,536 bytes end at its line end
        url = "http://h/" + "x" * (n - 9)
        rows = chunks_of(b"".join(X.record("urn:1", url, b"abc")) + b"".join(X.record("urn:2", "http://h/2", b"de")))
        assert [(x[2], x[4], x[8]) for x in rows] == [("urn:1", url, b"abc"), ("urn:2", "http://h/2", b"de")]


def test_damaged_files():
    whole = b"".join(X.record("urn:1", None, b"x" * 250))
    cut = chunks_of(whole[: whole.index(b"\r\n\r\n") + 4 + 120])
    assert [(x[7], x[10], x[11]) for x in cut] == [(100, False, True), (20, True, False)] and cut[0][4] is None
    wrong = chunks_of(whole.replace(b"xxx", b"xyx", 1))
    assert wrong[-1][12] is False
    assert [(x[5], x[11]) for x in chunks_of(b"nothing of the kind\r\n\r\n")] == [(-1, False)]
    zipped = gzip.compress(b"".join(X.record("urn:2", None, bytes(range(256)) * 40)))
    assert chunks_of(zipped[: len(zipped) // 2])[-1][11] is False or not chunks_of(zipped[: len(zipped) // 2])
    assert chunks_of(b"") == []


def test_table_and_edges(spark, tmp_path):
    long = "ä" * 300_000
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, ""), (3, "u", None), (None, "u", "y"), (1, "http://a/1", "<p>x</p>"), (4, "http://b c/\n", long)]
    df = spark.createDataFrame([(*x, "k", 7) for x in rows], SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/w"
    files = X.write_warc(df, folder).collect()
    assert sum(f.records for f in files) == 4
    got = X.warc_chunks(spark, [f.uri for f in files]).collect()
    by = {}
    for x in got:
        by.setdefault((x.file, x.record_no), []).append(x)
    joined = sorted((v[0].record_id, v[0].target_uri or "", b"".join(bytes(c.payload) for c in sorted(v, key=lambda c: c.chunk_no)).decode()) for v in by.values())
    assert joined == sorted([("urn:page:1", "http://a/1", "<p>x</p>")] * 2 + [("urn:page:2", "", ""), ("urn:page:4", "http://b c/", long)])
    assert all(x.complete and x.n_bytes <= X.CHUNK_BYTES for x in got) and all(x.digest_ok for x in got if x.is_last)
    assert X.warc_chunks(spark, []).count() == 0
    again = X.write_warc(df, folder).collect()
    assert sorted(f.uri for f in again) == sorted(f.uri for f in files)
    assert X.write_warc(spark.createDataFrame([], SCHEMA), f"{folder}/e").where("records > 0").count() == 0


def test_query_same_as_sql(spark, sf_dir):
    assert differences(X.op1_warc_chunks(spark, sf_dir), sf_dir, X.ORACLES["op1_warc_chunks"]) is None
