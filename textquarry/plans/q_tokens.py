"""Queries: tokenizers and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import arrow as A, text as T
from textquarry.functions.shared import once
from textquarry.operators import metrics as M, tokenizers as K
from textquarry.plans.registry import docs, query, table

_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: ('0x' || b)::INTEGER)"
#: RE2 has no look-ahead: a mark is put where white space before a word is cut, and matched by nothing.
_PIECES = "regexp_extract_all(regexp_replace(text, '(\\s)(\\s\\S)', '\\1' || chr(1) || '\\2', 'g'), '''(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}\\x01]+|\\s+')"
_PIECE_COUNTS = f"pc AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_PIECES}) AS piece FROM documents) GROUP BY piece), pb AS (SELECT {_BYTES.format('piece')} AS b, n FROM pc)"
_SYMBOLS = "s AS (SELECT symbol, sum(n)::BIGINT AS n FROM (SELECT unnest(b) AS symbol, n FROM pb) GROUP BY symbol)"
_PAIRS = 'p AS (SELECT b[i] AS "left", b[i + 1] AS "right", sum(n)::BIGINT AS n FROM (SELECT b, n, unnest(range(1, len(b))) AS i FROM pb) GROUP BY ALL)'


@query("byte_counts", f"SELECT byte, count(*) AS n FROM (SELECT unnest({_BYTES.format('text')}) AS byte FROM documents) GROUP BY byte")
def _(spark, d):
    return K.byte_counts(docs(spark, d))


@query("pretoken_counts", f"WITH {_PIECE_COUNTS} SELECT piece, n FROM pc")
def _(spark, d):
    return K.pretoken_counts(docs(spark, d))


@query("bpe_symbol_counts", f"WITH {_PIECE_COUNTS}, {_SYMBOLS} SELECT symbol, n FROM s")
def _(spark, d):
    return K.symbol_counts(K.pretoken_counts(docs(spark, d)))


@query("bpe_pair_counts", f'WITH {_PIECE_COUNTS}, {_PAIRS} SELECT "left", "right", n FROM p')
def _(spark, d):
    return K.pair_counts(K.pretoken_counts(docs(spark, d)))


@query("bpe_pair_scores", f'WITH {_PIECE_COUNTS}, {_SYMBOLS}, {_PAIRS} SELECT "left", "right", round(1e6 * p.n / (a.n::DOUBLE * b.n), 6) AS score FROM p JOIN s a ON a.symbol = "left" JOIN s b ON b.symbol = "right"')
def _(spark, d):
    return K.pair_scores(K.pretoken_counts(docs(spark, d))).withColumn("score", F.round(F.col("score") * 1e6, 6))


@query("bpe_train")
def _(spark, d):
    return K.Bpe.train(docs(spark, d), 200).vocabulary(spark)


@query("bpe_train_approx")
def _(spark, d):
    return K.Bpe.train(docs(spark, d), 200, mode="approx").vocabulary(spark)


_WORD = "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY word"


#: Merges of a small model whose ids SQL can follow: symbols are <hex>, and each merge in order of rank is a replacement.
_MERGES = [(a.encode("latin-1"), b.encode("latin-1")) for a, b in (("e", "n"), ("e", "r"), (" ", "d"), ("o", "u"), ("\xc3", "\xa9"), ("en", "t"), (" d", "e"), ("t", "h"), (" ", "th"), (" th", "e"), ("a", "u"), ("e", "au"), ("l", "l"), ("e", "ll"), ("\xc3", "\xbc"), ("er", "e"))]


def _ids_sql(text):
    """A list of the ids of a text under _MERGES."""
    pieces = _PIECES.replace("regexp_replace(text,", f"regexp_replace({text},")
    x = "regexp_replace(hex(encode(p)), '(..)', '<\\1>', 'g')"
    for a, b in _MERGES:
        x = f"replace({x}, '<{a.hex().upper()}><{b.hex().upper()}>', '<{(a + b).hex().upper()}>')"
    known = ", ".join(f"'{(a + b).hex().upper()}'" for a, b in _MERGES)
    one = f"list_transform(regexp_extract_all({x}, '<([0-9A-F]+)>', 1), lambda s: CASE WHEN length(s) = 2 THEN ('0x' || s)::INTEGER ELSE (255 + list_position([{known}], s))::INTEGER END)"
    return f"flatten(list_transform({pieces}, lambda p: {one}))"


def _joined(ids):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


@query("bpe_encode", f"SELECT doc_id, array_to_string({_ids_sql('text')}, ',') AS ids FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", _joined(K.Bpe(_MERGES).encode(F.col("text"))).alias("ids"))


@query("mixed_encode", f"SELECT doc_id, CASE WHEN length(text) <= 500 THEN 'byte' ELSE 'bpe' END AS tokenizer, CASE WHEN length(text) <= 500 THEN array_to_string({_BYTES.format('text')}, ',') ELSE array_to_string({_ids_sql('text')}, ',') END AS ids FROM documents")
def _(spark, d):
    model = K.Mixed({"byte": K.ByteLevel(), "bpe": K.Bpe(_MERGES)}, K.length_router([(500, "byte")], "bpe"), "bpe")
    return model.encode(docs(spark, d).select("doc_id", "text")).select("doc_id", "tokenizer", _joined(F.col("ids")).alias("ids"))


#: Log probabilities of a small Unigram model: of all cuts into these pieces the best is taken, the first start among equals.
_SCORES = {"en": -1.25, "ent": -1.5, "er": -1.75, "ou": -2.0, "the": -1.0, "au": -2.5, "eau": -2.25, "ell": -3.0, "re": -2.75, "tion": -1.125} | {c: -4.0 - k / 64 for k, c in enumerate("eaitnrsoludcmpvhgbfqzjyk")}
_VITERBI = f"""WITH RECURSIVE wc AS ({_WORD}), m AS (SELECT MAP {{{", ".join(f"'{p}': {s}::DOUBLE" for p, s in _SCORES.items())}}} AS m, MAP {{{", ".join(f"'{p}': {k}" for k, p in enumerate(_SCORES, 1))}}} AS n),
f(word, i, best, back) AS (SELECT word, 0, [0.0::DOUBLE], [0] FROM wc UNION ALL
SELECT word, i + 1, list_append(best, CASE WHEN list_max(c) > -1e200 THEN list_max(c) ELSE best[i + 1] - 100 END), list_append(back, CASE WHEN list_max(c) > -1e200 THEN (greatest(0, i - 15) + list_position(c, list_max(c)) - 1)::INTEGER ELSE i END)
FROM (SELECT word, i, best, back, list_transform(range(greatest(0, i - 15), i + 1), lambda s: best[s + 1] + coalesce(m.m[substr(word, s + 1, i + 1 - s)], '-infinity'::DOUBLE)) AS c FROM f, m WHERE i < length(word))),
r(word, e, back, ids) AS (SELECT word, length(word)::INTEGER, back, []::INTEGER[] FROM f WHERE i = length(word) UNION ALL
SELECT word, back[e + 1], back, list_prepend(coalesce(m.n[substr(word, back[e + 1] + 1, e - back[e + 1])], 0)::INTEGER, ids) FROM r, m WHERE e > 0),
sg AS (SELECT word, array_to_string(ids, ',') AS ids FROM r WHERE e = 0),
dw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)),
dt AS (SELECT doc_id, string_agg(ids, ',' ORDER BY pos) AS ids FROM dw JOIN sg USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN dt USING (doc_id)"""


@query("unigram_encode", _VITERBI)
def _(spark, d):
    return docs(spark, d).select("doc_id", _joined(K.Unigram(_SCORES).encode(F.col("text"))).alias("ids"))


_SAME = "SELECT doc_id, text AS decoded FROM documents"


@query("bpe_roundtrip", _SAME)
def _(spark, d):
    x = docs(spark, d)
    model = K.Bpe.train(x, 200)
    return x.select("doc_id", model.encode(F.col("text")).alias("ids")).select("doc_id", model.decode(F.col("ids")).alias("decoded"))


@query("byte_roundtrip", _SAME)
def _(spark, d):
    model = K.ByteLevel()
    return docs(spark, d).select("doc_id", model.decode(model.encode(F.col("text"))).alias("decoded"))


@query("byte_encode", f"SELECT doc_id, array_to_string({_BYTES.format('text')}, ',') AS ids FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.transform(K.ByteLevel().encode(F.col("text")), lambda i: i.cast("string")), ",").alias("ids"))


@query("byte_encode_special", f"SELECT doc_id, array_to_string(list_concat(list_concat([258], {_BYTES.format('text')}), [259]), ',') AS ids FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.transform(K.ByteLevel(300).encode(F.col("text"), add_special=True), lambda i: i.cast("string")), ",").alias("ids"))


@query("byte_vocabulary", "SELECT CASE WHEN b BETWEEN 32 AND 126 THEN chr(b::INTEGER) ELSE '<byte_' || b || '>' END AS token, b::INTEGER AS id FROM range(256) r(b) UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[BOS]', '[EOS]', '[MASK]']), unnest([256, 257, 258, 259, 260])::INTEGER")
def _(spark, d):
    return K.ByteLevel(300).vocabulary(spark)


_WORDPIECE = f"""wc AS ({_WORD}), wx AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS s FROM wc WHERE length(word) <= 100),
wy AS (SELECT word, n, s, unnest(range(1, length(word) - s + 2)) AS k FROM wx),
wt AS (SELECT CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, k) AS token, n FROM wy UNION ALL SELECT unnest(string_split(word, '')), n FROM wc WHERE length(word) <= 100),
wv AS (SELECT token, sum(n)::BIGINT AS n FROM wt WHERE token <> '' GROUP BY token ORDER BY n DESC, length(token), token LIMIT 1000)"""


@query("wordpiece_vocabulary", f"WITH {_WORDPIECE} SELECT token, n FROM wv")
def _(spark, d):
    return K.wordpiece_vocabulary(docs(spark, d), 1000)


_SEGMENTED = f"""WITH RECURSIVE {_WORDPIECE}, wk AS (SELECT token FROM wv UNION SELECT unnest(['[PAD]', '[UNK]', '[BOS]', '[EOS]', '[MASK]'])),
lk AS (SELECT word, s, max(k) AS k FROM wy JOIN wk ON token = CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, k) GROUP BY word, s),
g(word, i, out) AS (SELECT word, 1::BIGINT, []::VARCHAR[] FROM wc WHERE length(word) <= 100 UNION ALL SELECT g.word, g.i + lk.k, list_append(g.out, CASE WHEN g.i > 1 THEN '##' ELSE '' END || substr(g.word, g.i, lk.k)) FROM g JOIN lk ON lk.word = g.word AND lk.s = g.i),
sg AS (SELECT word, array_to_string(out, ' ') AS pieces FROM g WHERE i = length(word) + 1),
dw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)),
dt AS (SELECT doc_id, string_agg(coalesce(pieces, '[UNK]'), ' ' ORDER BY pos) AS tokens FROM dw LEFT JOIN sg USING (word) GROUP BY doc_id)"""


@query("wordpiece_encode", f"{_SEGMENTED} SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN dt USING (doc_id)")
def _(spark, d):
    x = docs(spark, d)
    return x.select("doc_id", F.array_join(K.WordPiece.train(x).tokenize(F.col("text")), " ").alias("tokens"))


@query("wordpiece_roundtrip", f"{_SEGMENTED}, x AS (SELECT doc_id, replace(' ' || coalesce(tokens, ''), ' ##', '') AS x FROM documents LEFT JOIN dt USING (doc_id)) SELECT doc_id, CASE WHEN x LIKE ' %' THEN substr(x, 2) ELSE x END AS decoded FROM x")
def _(spark, d):
    x = docs(spark, d)
    model = K.WordPiece.train(x)
    return x.select("doc_id", model.decode(model.encode(F.col("text"))).alias("decoded"))


@query(
    "unigram_candidates",
    f"""WITH wc AS ({_WORD}), h AS (SELECT substr(word, 1, 16) AS h, substr(word, 17) AS rest, n FROM wc), x AS (SELECT h, n, unnest(range(1, length(h) + 1)) AS s FROM h),
y AS (SELECT h, n, s, unnest(range(1, length(h) - s + 2)) AS k FROM x),
t AS (SELECT substr(h, s, k) AS piece, n FROM y UNION ALL SELECT unnest(string_split(rest, '')), n FROM h WHERE rest <> '')
SELECT piece, sum(n)::BIGINT AS n FROM t WHERE piece <> '' GROUP BY piece""",
)
def _(spark, d):
    return K.unigram_candidates(docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))


@query("unigram_train")
def _(spark, d):
    return K.Unigram.train(docs(spark, d)).vocabulary(spark)


@query("unigram_roundtrip", "SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS decoded FROM documents")
def _(spark, d):
    x = docs(spark, d)
    model = K.Unigram.train(x, iterations=2)
    return x.select("doc_id", model.decode(model.encode(F.col("text"))).alias("decoded"))


# ---- a vocabulary of lexer tokens ----

_LEX = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
_LEXED = f"lx AS (SELECT doc_id, text, regexp_extract_all(text, '{_LEX}') AS ts FROM documents)"
_VOCAB = f"{_LEXED}, fc AS (SELECT token, count(*) AS n FROM (SELECT unnest(ts) AS token FROM lx) GROUP BY token ORDER BY n DESC, token LIMIT 995), fv AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 4)::INTEGER AS id FROM fc)"
_TOKENS = f"""{_VOCAB}, ex AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM lx),
ag AS (SELECT doc_id, list(coalesce(fv.token, '[UNK]') ORDER BY pos) AS tokens FROM ex LEFT JOIN fv USING (token) GROUP BY doc_id),
tok AS (SELECT doc_id, text, lang, coalesce(tokens, []) AS tokens FROM documents LEFT JOIN ag USING (doc_id)),
tt AS (SELECT doc_id, unnest(tokens) AS token FROM tok), tc AS (SELECT token, count(*) AS n FROM tt GROUP BY token)"""


def tokenized(spark, d):
    """(doc_id, text, lang, tokens): lexer tokens, those outside a vocabulary of 1000 as [UNK]."""
    x = docs(spark, d)
    known = [r.token for r in K.frequency_vocabulary(x, 1000, _LEX).collect()]  # 995 at most
    # By a step of its own: filters on the tokens, and those that explode adds, don't split the texts again.
    return once(x.select("doc_id", "text", "lang"), {"tokens": A.known_or(F.regexp_extract_all("text", F.lit(_LEX), 0), known, "[UNK]")})


@query("frequency_vocabulary", f"WITH {_VOCAB} SELECT token, n, id FROM fv")
def _(spark, d):
    return K.frequency_vocabulary(docs(spark, d), 1000, _LEX)


@query("frequency_encode", f"WITH {_VOCAB}, ex AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts)))::INTEGER AS pos FROM lx) SELECT doc_id, pos, token, coalesce(id, 1) AS id FROM ex LEFT JOIN fv USING (token)")
def _(spark, d):
    x = docs(spark, d)
    return K.encode_with_vocabulary(x, K.frequency_vocabulary(x, 1000, _LEX), _LEX)


@query(
    "mixed_vocabulary",
    f"""WITH {_VOCAB}, {_WORDPIECE}, wi AS (SELECT token, row_number() OVER (ORDER BY n DESC, length(token), token) AS id FROM wv),
r AS (SELECT 0 AS c, k AS id, s AS label FROM (SELECT unnest(range(5)) AS k, unnest(['[PAD]', '[UNK]', '[BOS]', '[EOS]', '[MASK]']) AS s) UNION ALL SELECT 1, id, 'words:' || token FROM fv UNION ALL SELECT 2, id, 'pieces:' || token FROM wi)
SELECT label, (row_number() OVER (ORDER BY c, id, label) - 1)::INTEGER AS id FROM r""",
)
def _(spark, d):
    from pyspark.sql import Window as W

    x = docs(spark, d)
    pieces = K.wordpiece_vocabulary(x, 1000).withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), F.length("token"), "token")).cast("int"))  # 1000 rows
    return K.merged_vocabulary({"words": K.frequency_vocabulary(x, 1000, _LEX), "pieces": pieces})


@query("mixed_route", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN 'short' WHEN length(text) <= 2000 THEN 'middle' ELSE 'long' END AS tokenizer FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.length_router([(2000, "middle"), (300, "short")], "long")(F.col("text")).alias("tokenizer"))


@query("mixed_roundtrip", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN 'byte' ELSE 'bpe' END AS tokenizer, text AS decoded FROM documents")
def _(spark, d):
    x = docs(spark, d)
    model = K.Mixed({"byte": K.ByteLevel(), "bpe": K.Bpe.train(x, 100)}, K.length_router([(500, "byte")], "bpe"), "bpe")
    return model.decode(model.encode(x.select("doc_id", "text"))).select("doc_id", "tokenizer", "decoded")


# ---- metrics ----


def _metric(name, sql, f):
    @query(f"metric_{name}", f"WITH {_TOKENS} {sql}")
    def _(spark, d):
        return f(tokenized(spark, d))


@query("metric_vocab_coverage", f"WITH {_TOKENS}, v AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS token FROM documents WHERE lang = 'en') SELECT count(*) AS vocab_size, count(*) FILTER (token IN (SELECT token FROM tt)) AS used, round(count(*) FILTER (token IN (SELECT token FROM tt)) / count(*), 6) AS coverage FROM v WHERE token <> ''")
def _(spark, d):
    v = docs(spark, d).where("lang = 'en'").select(F.explode(T.words(F.col("text"))).alias("token"))
    return M.vocab_coverage(tokenized(spark, d), v)


def _r6(x, name):
    return f"round({x}, 6) AS {name}"


_RATIO = "CASE WHEN len(tokens) > 0 THEN length(text) / len(tokens) ELSE 0 END"
_metric("compression", f"SELECT {_r6('sum(length(text)) / sum(len(tokens))', 'total_ratio')}, " + ", ".join(_r6(f"{f}({_RATIO})", n) for f, n in (("avg", "mean_ratio"), ("median", "median_ratio"), ("stddev_samp", "std_ratio"), ("stddev_pop", "std_pop_ratio"), ("min", "min_ratio"), ("max", "max_ratio"))) + " FROM tok", M.compression)
_metric("token_frequency", 'SELECT sum(n)::BIGINT AS total, count(*) AS "distinct", round(count(*) / sum(n), 6) AS diversity, round(avg(n), 6) AS mean, median(n) AS median, max(n) AS max, min(n) AS min FROM tc', M.token_frequency)
_metric("rare_tokens", 'SELECT count(*) AS "distinct", count(*) FILTER (n <= 2) AS rare, count(*) FILTER (n = 1) AS singletons, round(count(*) FILTER (n <= 2) / count(*), 6) AS rare_ratio, round(count(*) FILTER (n = 1) / count(*), 6) AS singleton_ratio FROM tc', M.rare_tokens)
_metric("token_length", "SELECT round(avg(length(token)), 6) AS mean, median(length(token)) AS median, min(length(token)) AS min, max(length(token)) AS max, round(stddev_samp(length(token)), 6) AS std FROM tt", M.token_length)
_metric("token_length_histogram", "SELECT length(token) AS length, count(*) AS n FROM tt GROUP BY 1", M.token_length_histogram)
_metric("sequence_length", "SELECT round(avg(len(tokens)), 6) AS mean, " + ", ".join(_r6(f"quantile_cont(len(tokens), {q})", n) for q, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))) + ", min(len(tokens)) AS min, max(len(tokens)) AS max, round(stddev_samp(len(tokens)), 6) AS std FROM tok", M.sequence_length)
_metric("special_usage", "SELECT s.token, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM tc), 8) AS rate FROM (SELECT unnest(['[PAD]', '[UNK]', '[BOS]', '[EOS]', '[MASK]']) AS token) s LEFT JOIN tc USING (token)", M.special_usage)
_UNK = "len(list_filter(tokens, lambda t: t = '[UNK]'))"
_metric("unk_analysis", f"SELECT sum({_UNK})::BIGINT AS unk, sum(len(tokens))::BIGINT AS total, round(sum({_UNK}) / sum(len(tokens)), 8) AS unk_rate, count(*) FILTER ({_UNK} > 0) AS texts_with_unk FROM tok", M.unk_analysis)
_metric(
    "coverage",
    f"""SELECT round(1 - sum(u) / sum(n), 6) AS coverage, round(sum(n) / sum(w), 6) AS tokens_per_word, round(avg(n / w), 6) AS mean_per_text, round(min(n / w), 6) AS min_per_text, round(max(n / w), 6) AS max_per_text
FROM (SELECT len(tokens) AS n, {_UNK} AS u, nullif(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 0) AS w FROM tok WHERE length(text) > 0)""",
    M.coverage,
)
_metric("token_distribution", 'SELECT sum(n)::BIGINT AS total, count(*) AS "distinct", min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_pop(n), 5) AS std, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS entropy FROM tc', M.token_distribution)
_metric(
    "token_histogram",
    """, e AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM tc), c AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(49, floor((n - lo) / ((hi - lo) / 50)))::INTEGER END AS bin, count(*) AS n FROM tc, e GROUP BY 1)
SELECT b::INTEGER AS bin, round(lo + b * ((hi - lo) / 50), 6) AS low, round(lo + (b + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0)::BIGINT AS n FROM range(50) r(b) LEFT JOIN c ON c.bin = r.b, e""",
    M.token_histogram,
)
_CATEGORY = "SELECT lang, count(*) AS texts, sum(length(text))::BIGINT AS chars, sum(len(tokens))::BIGINT AS tokens, round(sum(length(text)) / sum(len(tokens)), 6) AS chars_per_token, round(avg(len(tokens)), 6) AS tokens_per_text FROM tok GROUP BY"
_metric("by_category", f"{_CATEGORY} ROLLUP (lang)", lambda t: M.by_category(t, "lang"))
_metric("best_and_worst", f", c AS ({_CATEGORY} lang) SELECT (SELECT lang FROM c ORDER BY chars_per_token DESC, lang DESC LIMIT 1) AS best, (SELECT lang FROM c ORDER BY chars_per_token, lang LIMIT 1) AS worst", lambda t: M.best_and_worst(t, "lang"))


@query(
    "metric_diversity",
    """WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents) GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS total, round(count(*) / sum(n), 6) AS ttr, round(count(*) FILTER (n = 1) / count(*), 6) AS hapax, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) AS entropy,
  round(CASE WHEN sum(n) > 1 THEN 1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) ELSE 0 END, 6) AS simpson FROM w GROUP BY doc_id""",
)
def _(spark, d):
    return M.diversity(docs(spark, d))


@query(
    "metric_consistency",
    f"""WITH e AS (SELECT doc_id, {_ids_sql('substr(text, 1, floor(length(text) * 0.8)::INTEGER)')} AS p, {_ids_sql('text')} AS f FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, len(p) AS prefix_tokens, coalesce(nullif(list_position(list_transform(range(1, len(p) + 1), lambda i: p[i] IS NOT DISTINCT FROM f[i]), false), 0) - 1, len(p)) AS stable FROM e)
SELECT doc_id, prefix_tokens::INTEGER AS prefix_tokens, stable::INTEGER AS stable, round(CASE WHEN prefix_tokens > 0 THEN stable / prefix_tokens ELSE 1 END, 6) AS share FROM s""",
)
def _(spark, d):
    return M.consistency(docs(spark, d), K.Bpe(_MERGES).encode)


#: The turns of the conversations (DuckDB's edit distance counts bytes, so other characters than ASCII are ?), decoded from a vocabulary of 100 words.
_LOSSY = f"""t AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS k, regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS text FROM conversations),
e AS (SELECT k, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT k, regexp_extract_all(text, '{_LEX}') AS ts FROM t)),
v AS (SELECT token FROM e GROUP BY token ORDER BY count(*) DESC, token LIMIT 95),
j AS (SELECT k, string_agg(CASE WHEN token IN (SELECT token FROM v) THEN token ELSE '[UNK]' END, ' ' ORDER BY pos) AS decoded FROM e GROUP BY k),
x AS (SELECT text, coalesce(decoded, '') AS decoded, greatest(length(text), length(coalesce(decoded, ''))) AS n FROM t LEFT JOIN j USING (k) WHERE text IS NOT NULL)"""


def _lossy(spark, d):
    x = table(spark, d, "conversations").where("text is not null").select(F.regexp_replace("text", "[^\\x00-\\x7f]", "?").alias("text"))
    known = [r.token for r in K.frequency_vocabulary(x, 100, _LEX).collect()]  # 95 at most
    return x.select("text", F.array_join(A.known_or(F.regexp_extract_all("text", F.lit(_LEX), 0), known, "[UNK]"), " ").alias("decoded"))


@query("metric_reconstruction", f"WITH {_LOSSY} SELECT count(*) AS texts, count(*) FILTER (text = decoded) AS perfect, sum(levenshtein(text, decoded))::BIGINT AS distance, round(sum(levenshtein(text, decoded)) / sum(length(text)), 6) AS cer FROM x")
def _(spark, d):
    return M.reconstruction(_lossy(spark, d))


@query("metric_reversibility", f"WITH {_LOSSY} SELECT round(avg(CASE WHEN n = 0 THEN 1 ELSE 1 - levenshtein(text, decoded) / n END), 6) AS similarity, round(avg((text = decoded)::INTEGER), 6) AS exact_ratio FROM x")
def _(spark, d):
    return M.reversibility(_lossy(spark, d))


@query("metric_quality", f"WITH {_TOKENS}, w AS (SELECT text, tokens AS a, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS b FROM tok), n AS (SELECT sum(length(text)) AS c, sum(len(a)) AS na, sum(len(b)) AS nb FROM w), "
       "va AS (SELECT count(*) AS v FROM (SELECT DISTINCT unnest(a) FROM w)), vb AS (SELECT count(*) AS v FROM (SELECT DISTINCT unnest(b) FROM w)), sh AS (SELECT count(*) AS v FROM (SELECT DISTINCT unnest(a) AS t FROM w) JOIN (SELECT DISTINCT unnest(b) AS t FROM w) USING (t)) "
       "SELECT round(c / na, 6) AS chars_per_token, round(c / nb, 6) AS reference_chars_per_token, round((c / na) / (c / nb), 6) AS compression_vs_reference, va.v AS distinct_tokens, vb.v AS reference_distinct_tokens, round(sh.v / va.v, 6) AS shared_with_reference, round(na / nb, 6) AS tokens_vs_reference FROM n, va, vb, sh")
def _(spark, d):
    return M.quality(tokenized(spark, d), docs(spark, d).select("text", T.words(F.col("text")).alias("tokens")))


@query("metric_rare_examples", f"SELECT word AS token, n FROM ({_WORD}) WHERE n <= 2 ORDER BY n, word LIMIT 20")
def _(spark, d):
    return M.rare_examples(docs(spark, d).select(T.words(F.col("text")).alias("tokens")))


@query("metric_unk_examples", f"WITH {_TOKENS}, u AS (SELECT doc_id, len(list_filter(tokens, lambda t: t = '[UNK]')) AS unk, len(tokens) AS tokens FROM tok) SELECT doc_id, unk, tokens, round(unk / tokens, 6) AS rate FROM u WHERE unk > 0 ORDER BY unk / tokens DESC, doc_id LIMIT 10")
def _(spark, d):
    return M.unk_examples(tokenized(spark, d))


@query("metric_compare", f"WITH {_TOKENS}, r AS (SELECT round(sum(length(text)) / sum(len(tokens)), 6) AS ratio_a, round(sum(length(text)) / sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))), 6) AS ratio_b FROM tok) SELECT ratio_a, ratio_b, round(ratio_a - ratio_b, 6) AS difference FROM r")
def _(spark, d):
    return M.compare(tokenized(spark, d), docs(spark, d).select("text", T.words(F.col("text")).alias("tokens")))


@query("mixed_route_regex", "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'numbers' WHEN regexp_matches(text, '[äöüßéèêçñó]') THEN 'accents' ELSE 'plain' END AS tokenizer FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", K.regex_router([("[0-9]{4}", "numbers"), ("[äöüßéèêçñó]", "accents")], "plain")(F.col("text")).alias("tokenizer"))
