import random
import string

from textquarry.llm import secret_scan as X
from textquarry.llm._vocab import encoding


def random_string(r, n, alphabet=string.ascii_letters + string.digits):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_planted_secrets_are_found_and_known_strings_are_not():
    r, enc = random.Random(1), encoding()
    found = 0
    for k in range(200):
        s = random_string(r, r.choice([20, 24, 32, 40]))
        text = f"Some words, then api_key = \"{s}\" and more words."
        found += [text[a:b] for a, b, _ in X.find_secrets(text, enc)] == [s]
    assert found >= 190
    hexa = "0123456789abcdef"
    for text in (
        "commit " + random_string(r, 40, hexa), "sha256: " + random_string(r, 64, hexa), "etag " + random_string(r, 32, hexa), random_string(r, 64, hexa), "id 123e4567-e89b-12d3-a456-426614174000",
        "call 12345678901234567890", "see https://example.com/a1b2c3d4e5f6a7b8c9d0e1f2", "write to someone12345678@example.org", "internationalization_and_localization", "", None, "short",
        "Donaudampfschifffahrtsgesellschaft", "file_name_with_many_words_2024.txt",
    ):
        assert X.find_secrets(text, enc) == [], text
    assert X.find_secrets("token=" + random_string(r, 40, hexa), enc)


def brute(text, enc):
    """Every run of secret characters, cut out by hand, under the same rules for its surroundings."""
    allowed = set(string.ascii_letters + string.digits + "+/_.=~@:%&?#-")
    out, i = set(), 0
    while i < len(text):
        if text[i] not in allowed:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        if j - i >= 16:
            for a, b, _ in X.find_secrets(" " * 0 + text[max(0, i - 60) : j + 1], enc):
                a, b = a + max(0, i - 60), b + max(0, i - 60)
                if a >= i:
                    out.add((a, b))
        i = j
    return out


def test_query_against_brute_force(spark, sf_dir):
    enc = encoding()
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = X.op6_secret_scan(spark, sf_dir).collect()
    assert {(x.doc_id, x.start, x.end) for x in got} == {(i, a, b) for i, t in texts.items() for a, b in brute(t, enc)}
    for x in got:
        assert texts[x.doc_id][x.start : x.end] == x.secret and abs(x.chars_per_token - len(x.secret) / len(enc.encode_ordinary(x.secret))) < 1e-5


def test_redaction_and_edges(spark):
    s = random_string(random.Random(4), 32)
    long = "word " * 200_000 + f"password: {s} end"
    rows = [(1, f"a key={s} b key={s}", 99, "x"), (2, None, None, "y"), (3, "", 0, "z"), (4, long, 5, "w"), (None, "nothing", 7, None), (3, "", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, secret string")
    out = X.redact_secrets(df)
    assert out.schema.names == df.columns and out.count() == 6
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert got[1] == ("a key=[SECRET] b key=[SECRET]", 29) and got[2] == (None, None) and got[3] == ("", 0)
    assert got[4][0].endswith("password: [SECRET] end") and got[4][1] == len(got[4][0])
    hits = X.scan_secrets(df).collect()
    assert sorted((x.doc_id, x.secret) for x in hits) == [(1, s), (1, s), (4, s)]
    assert X.scan_secrets(spark.createDataFrame([], df.schema)).count() == 0


def test_secrets_inside_links_and_beside_other_scripts():
    enc, s = encoding(), "hV7kq2Lw9ZpX4mTz8RbN"
    for text in (
        "postgres://admin:%s@db.internal:5432/app", "redis://:%s@cache:6379", "https://%s@github.com/a/b", "admin:%s@db.internal:5432/app", "https://api.example.com/v1?api_key=%s", "https://api.example.com/v1?a=1&key=%s&b=2",
        "https://example.com/cb#access_token=%s", "https://example.com/key=%s/x", "settings.json:token=%s", "url=https://example.com/v1?key=%s", "https://a.com/?next=https://b.com/x&key=%s", "www.example.com/x?key=%s", "someone@example.org:%s",
        "密码%s是", "パスワード%sです", "รหัส%sนะ",
    ):
        want = text % s
        assert [want[a:b] for a, b, _ in X.find_secrets(want, enc)] == [s], text
    for text in (
        "https://example.com/%s", "https://example.com/a/%s?page=2", "http://%s.example.com/", "url=https://example.com/%s", "https://a.com/?next=https://b.com/%s", "https://web.archive.org/web/https://b.com/%s", "www.example.com/%s",
        "%s@example.org", "mailto:%s@example.org", "email=%s@example.org", "from:%s@example.org", "git@github.com:org/%s.git", "%s.example.com/x", "urn:isbn:%s", "é%s", "%sж",
    ):
        assert X.find_secrets(text % s, enc) == [], text


def test_min_length_is_honoured():
    enc = encoding()
    text = "key = x9Qz7Lw2Vb4K and more"
    assert not X.find_secrets(text, enc) and [text[a:b] for a, b, _ in X.find_secrets(text, enc, min_length=10)] == ["x9Qz7Lw2Vb4K"]
    assert not X.find_secrets(text, enc, min_length=13)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token = " + "x9Qz7Lw2Vb4K" * 2, "a", 3)], "doc_id long, text string, secret string, start int")
    assert X.scan_secrets(df).count() == 1 and X.scan_secrets(df.limit(0)).count() == X.redact_secrets(df.limit(0)).count() == 0
    assert [x.secret for x in X.redact_secrets(df).collect()] == ["a"]
