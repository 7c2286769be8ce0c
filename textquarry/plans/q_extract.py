"""Queries: sentences, keywords, entities, facts, relations, summaries; code."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import code as C, extract as E
from textquarry.plans.registry import docs, query, table

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _sentences(text):
    """RE2 has no look-behind: a mark is put after each sentence end and split at."""
    parts = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


#: The texts of the table hold nothing of some kinds: these rows stand beside it in the queries of those kinds.
ROWS = [
    (-1, "Anna Weber works for Blue River Group. Anna Weber is Mark Stone. It was probably late. Mark Stone has 12/03/2020 and 5 May 2021."),
    (-2, "The patient took 400 mg ibuprofen. Ibuprofen relieves migraine! Insulin treats diabetes. An infection spreads to the heart and lungs."),
    (-3, "In Miller v. Jones the Supreme Court upholds Section 12.4. The plaintiff cites Article 7. A lawsuit about a lease, said the judge."),
    (-4, "Northern Star Bank lends to Alpine Trade Holding. Alpine Trade Holding pays $25.5k and 4.5 percent. The bonds and shares of Alpine Trade Holding pay dividend."),
    (-5, "Orbit Systems stores data.json in a database. The scheduler runs on Orbit Systems. The server exposes an API and replaces export.csv in cache."),
    (-6, "A Lake, a lake, a LAKE by the river; the Cat and the CAT saw a dog and a cAt."),
]


def more(spark, d):
    return docs(spark, d).select("doc_id", "text").unionByName(spark.createDataFrame(ROWS, "doc_id long, text string"))


_MORE = "dx AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in ROWS) + "))"


def _wide(sql):
    """The same SQL over the table and the rows beside it."""
    sql = sql.replace("FROM documents", "FROM dx").replace("FROM en JOIN dx", "FROM en JOIN dx")
    return f"WITH {_MORE}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {_MORE} {sql}"


_S = f"s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss)))::INTEGER AS pos FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents))"
_PLAIN = "ps AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(len(ss)))::INTEGER AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents))"


def _q(s):
    return s.replace("'", "''")


def _entities(patterns, source="documents", key="doc_id", column="text"):
    return " UNION ALL ".join(f"SELECT {key}, '{t}' AS type, unnest(regexp_extract_all({column}, '{_q(p)}')) AS text FROM {source}" for t, p in patterns.items())


@query("sentences", f"WITH {_S} SELECT doc_id, pos, substr(sentence, 1, 200) AS sentence FROM s WHERE length(sentence) >= 10")
def _(spark, d):
    return E.sentences(docs(spark, d), 10, 200)


_STOP = ", ".join(f"'{w}'" for w in E.STOP)


@query(
    "keywords",
    f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM w WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY ALL)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f)::INTEGER AS rank FROM c QUALIFY rank <= 10""",
)
def _(spark, d):
    return E.keywords(docs(spark, d))


@query("paragraphs", "SELECT doc_id, len(string_split(text, chr(10) || chr(10)))::INTEGER AS paragraphs FROM documents")
def _(spark, d):
    return E.paragraphs(docs(spark, d))


@query("remove_citations", f"SELECT doc_id, regexp_replace(text, '{E.CITATION}', '', 'g') AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", E.remove_citations(F.col("text")).alias("text"))


@query("entities", _entities(E.ENTITIES))
def _(spark, d):
    return E.entities(docs(spark, d))


@query("entities_pages", _entities(E.ENTITIES, "pages", "page_id", "html"))
def _(spark, d):
    return E.entities(table(spark, d, "pages"), id_col="page_id", text_col="html")


@query("entity_spans", f"SELECT doc_id, type, text, count(*) AS n FROM ({_entities(E.ENTITIES)}) GROUP BY ALL")
def _(spark, d):
    """Spans come by Arrow; SQL gives no offsets, so they are counted here (tests hold the offsets)."""
    x = E.entity_spans(docs(spark, d)).where(F.col("end") > F.col("start"))
    return x.groupBy("doc_id", "type", "text").agg(F.count("*").alias("n"))


@query("facts", f"WITH {_PLAIN} SELECT doc_id, pos, sentence FROM ps WHERE regexp_matches(sentence, '{E.FACT}')")
def _(spark, d):
    return E.facts(docs(spark, d))


@query("facts_unhedged", f"WITH {_PLAIN} SELECT doc_id, pos, sentence FROM ps WHERE regexp_matches(sentence, '{E.FACT}') AND NOT regexp_matches(sentence, '{E.HEDGE}')")
def _(spark, d):
    return E.facts(docs(spark, d), drop_hedged=True)


_LADDER = " ".join(f"WHEN contains(g, '{v}') THEN '{v}'" for v in E.VERBS)


@query(
    "relations",
    _wide(f"""WITH {_PLAIN}, en AS (SELECT DISTINCT doc_id, text FROM ({_entities(E.ENTITIES)})), m AS (SELECT DISTINCT doc_id, pos, sentence, text FROM ps JOIN en USING (doc_id) WHERE contains(sentence, text)),
p AS (SELECT a.doc_id, a.pos, a.sentence, a.text AS source, b.text AS target, instr(a.sentence, a.text) AS i, instr(a.sentence, b.text) AS j FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.text <> b.text),
b AS (SELECT *, lower(CASE WHEN i < j THEN substr(sentence, i + length(source), greatest(j - i - length(source), 0)) ELSE substr(sentence, j + length(target), greatest(i - j - length(target), 0)) END) AS g FROM p)
SELECT doc_id, pos, source, CASE {_LADDER} END AS relation, target FROM b WHERE relation IS NOT NULL"""),
)
def _(spark, d):
    return E.relations(more(spark, d))


def _domain(name):
    pack = E.DOMAINS[name]
    en = f"en AS (SELECT * FROM ({_entities(pack.entities)}))"

    @query(f"domain_entities_{name}", _wide(_entities(pack.entities)))
    def _(spark, d):
        return E.domain_entities(more(spark, d), name)

    words = " OR ".join(f"contains(lower(sentence), '{w}')" for w in pack.keywords)

    @query(f"domain_facts_{name}", _wide(f"WITH {_PLAIN}, {en} SELECT doc_id, pos, sentence FROM ps WHERE {words} OR EXISTS (SELECT 1 FROM en WHERE en.doc_id = ps.doc_id AND contains(lower(ps.sentence), lower(en.text)))"))
    def _(spark, d):
        return E.domain_facts(more(spark, d), name)

    verbs = ", ".join(f"'{v}'" for v in pack.relations)

    @query(
        f"domain_relations_{name}",
        _wide(f"""WITH {_PLAIN}, {en}, m AS (SELECT doc_id, pos, sentence, type, text FROM ps JOIN (SELECT DISTINCT * FROM en) USING (doc_id) WHERE contains(lower(sentence), lower(text))), v AS (SELECT unnest([{verbs}]) AS relation)
SELECT a.doc_id, a.pos, a.type AS source_type, a.text AS source, relation, b.type AS target_type, b.text AS target FROM m a JOIN v ON contains(lower(a.sentence), relation) JOIN m b ON a.doc_id = b.doc_id AND a.pos = b.pos AND (a.text <> b.text OR a.type <> b.type)"""),
    )
    def _(spark, d):
        return E.domain_relations(more(spark, d), name)


for _name in E.DOMAINS:
    _domain(_name)


_TERMS = {"place": ["river", "lake"], "animal": ["dog", "cat"]}


@query("domain_terms", _wide("SELECT doc_id, 'PLACE' AS type, unnest(regexp_extract_all(text, '(?i)\\b(?:river|lake)\\b')) AS text FROM documents UNION ALL SELECT doc_id, 'ANIMAL', unnest(regexp_extract_all(text, '(?i)\\b(?:dog|cat)\\b')) FROM documents"))
def _(spark, d):
    return E.entities(more(spark, d), E.term_patterns(_TERMS))


def _standard(text, word, standard):
    """A word in capitals, with a capital first, or otherwise: the standard in the same way."""
    for pattern, new in ((word.upper(), standard.upper()), (f"{word[0].upper()}(?i:{word[1:]})", standard.capitalize()), (f"{word[0]}(?i:{word[1:]})", standard)):
        text = f"regexp_replace({text}, '\\b{pattern}\\b', '{new}', 'g')"
    return text


@query("normalize_terms", _wide(f"SELECT doc_id, {_standard(_standard('text', 'lake', 'river'), 'cat', 'dog')} AS text FROM documents"))
def _(spark, d):
    return more(spark, d).select("doc_id", E.normalize_terms(F.col("text"), _TERMS).alias("text"))


@query(
    "summary",
    f"""WITH {_S}, w AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+')) AS word FROM s),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT doc_id, word, n / max(n) OVER (PARTITION BY doc_id) AS weight FROM c),
sc AS (SELECT doc_id, pos, round(sum(weight), 6) AS score FROM w JOIN g USING (doc_id, word) GROUP BY ALL),
r AS (SELECT doc_id, pos, sentence FROM s LEFT JOIN sc USING (doc_id, pos) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, pos) <= 3)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM r GROUP BY doc_id""",
)
def _(spark, d):
    return E.summary(docs(spark, d))


@query(
    "simplify",
    f"SELECT doc_id, array_to_string(list_transform({_sentences('text')}, lambda s: CASE WHEN len(string_split_regex(s, '\\s+')) > 20 THEN array_to_string(list_slice(string_split(regexp_replace(s, '\\s*\\([^)]*\\)', '', 'g'), ','), 1, 2), ',') ELSE s END), ' ') AS text FROM documents",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", E.simplify(F.col("text")).alias("text"))


# ---- code ----

_LINES = "array_to_string(list_transform(string_split({0}, chr(10)), lambda l: regexp_extract(l, '^[ \\t]*') || regexp_replace(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '[ \\t]+', ' ', 'g')), chr(10))"
_HASH = "regexp_replace(regexp_replace({0}, '(?m)^#!.*?$', '', 'g'), '(?m)#.*?$', '', 'g')"
_DOC = "regexp_replace({0}, '(?s)\"\"\".*?\"\"\"|''''''.*?''''''', '', 'g')"


@query("code_clean_python", f"SELECT doc_id, {_LINES.format(_DOC.format(_HASH.format('text')))} AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", C.clean_code(F.col("text"), F.lit("python")).alias("text"))


_SLASHES = "regexp_replace(regexp_replace(regexp_replace(html, '(?m)^#!.*?$', '', 'g'), '(?m)//.*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')"


@query("code_clean_javascript", f"SELECT page_id, {_LINES.format(_SLASHES)} AS html FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", C.clean_code(F.col("html"), F.lit("javascript")).alias("html"))


@query("code_flat", "SELECT doc_id, trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", C.squeeze_code(F.col("text"), keep_indentation=False).alias("text"))


@query("code_php_html", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^?].*?>|</.*?>', '', 'g'), '[ \\t]+', ' ', 'g'), '^ | $', '', 'g')) AS html FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^?].*?>|</.*?>', '', 'g'), '<\\?php|<\\?=|\\?>', '', 'g'), '(?m)(?://|#).*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS html FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", C.clean_php(F.col("html"), remove_html=True, config=C.CodeConfig(keep_indentation=False)).alias("html"))


@query("code_strip_decorators", "SELECT doc_id, regexp_replace(text, '(?m)^[ \\t]*@[^\\n]*\\n?', '', 'g') AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", C.strip_decorators(F.col("text")).alias("text"))


#: The tables hold no code, so each document gets a program made of its columns; SQL states what must come out of it.
_LETTERS = "regexp_replace(lang || '_' || source, '[^A-Za-z0-9_]', '', 'g')"


def _programs(spark, d, template):
    """(doc_id, code): {id}, {name} and {n} of the template are the document's id, a name from language and source, and its length."""
    x = docs(spark, d).select("doc_id", F.regexp_replace(F.concat("lang", F.lit("_"), "source"), "[^A-Za-z0-9_]", "").alias("name"), F.length("text").cast("string").alias("n"))
    code = F.lit(template)
    for k, v in (("{id}", F.col("doc_id").cast("string")), ("{name}", F.col("name")), ("{n}", F.col("n"))):
        code = F.replace(code, F.lit(k), v)
    return x.select("doc_id", code.alias("code"))


def _said(template):
    """The same template in SQL."""
    parts = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"replace(replace(replace({parts}, '{{id}}', doc_id::VARCHAR), '{{name}}', {_LETTERS}), '{{n}}', length(text)::VARCHAR)"


PYTHON = '@cached\n@retry(3)\ndef area_{id}(width: int, height: float = {n}.5, *rest: str, **more) -> float:\n    """Area."""\n    total: int = width * {n}\n    return total\n\nclass {name}(Shape, Sized, metaclass=Meta):\n    """A box."""\n    async def size(self, unit):\n        self.unit_{id} = unit\n'
BROKEN = "def f_{id}(:\n  {name}"
PHP = "<?php\nnamespace App\\{name};\nuse Lib\\Base as Root;\nclass Car{id} extends Root implements Movable, Named {\n  public function drive($speed, $far = {n}) { return $this->go($speed); } // go\n  function all() { yield from $this->{name}; }\n}\nfunction start_{id}($car) { $t = <<<EOT\n{n}\nEOT;\n return $car; }\n"


@query("code_python_tokens", f"SELECT doc_id, {_said('@ cached @ retry ( 3 ) def area_{id} ( width : int , height : float = {n}.5 , * rest : str , ** more ) -> float : %Area.% total : int = width * {n} return total class {name} ( Shape , Sized , metaclass = Meta ) : %A box.% async def size ( self , unit ) : self . unit_{id} = unit'.replace('%', chr(34) * 3))} AS tokens FROM documents")
def _(spark, d):
    return _programs(spark, d, PYTHON).select("doc_id", F.array_join(C.python_tokens(F.col("code")), " ").alias("tokens"))


@query("code_python_tokens_broken", f"SELECT doc_id, {_said('def f_{id} ( : {name}')} AS tokens FROM documents")
def _(spark, d):
    return _programs(spark, d, BROKEN).select("doc_id", F.array_join(C.python_tokens(F.col("code")), " ").alias("tokens"))


@query("code_python_identifiers", f"SELECT doc_id, array_to_string(list_sort([{_said('{name}')}, {_said('area_{id}')}, 'height', 'more', 'rest', 'self', 'size', 'total', 'unit', {_said('unit_{id}')}, 'width']), ' ') AS names FROM documents")
def _(spark, d):
    return _programs(spark, d, PYTHON).select("doc_id", F.array_join(C.python_identifiers(F.col("code")), " ").alias("names"))


@query("code_python_valid", "SELECT doc_id, true AS valid, false AS broken FROM documents")
def _(spark, d):
    both = _programs(spark, d, PYTHON).join(_programs(spark, d, BROKEN).withColumnRenamed("code", "other"), "doc_id")
    return both.select("doc_id", C.python_valid(F.col("code")).alias("valid"), C.python_valid(F.col("other")).alias("broken"))


_UNTYPED = PYTHON.replace("width: int, height: float =", "width, height =").replace("*rest: str", "*rest").replace(" -> float", "").replace("total: int", "total")


@query("code_strip_type_hints", f"SELECT doc_id, {_said(_UNTYPED)} AS code FROM documents")
def _(spark, d):
    return _programs(spark, d, PYTHON).select("doc_id", C.strip_type_hints(F.col("code")).alias("code"))


def _symbol_rows(df, language):
    return C.symbols(df, language).select("doc_id", "kind", "name", "parent", *(F.array_join(c, " ").alias(c) for c in ("params", "bases", "interfaces", "methods", "decorators")), "docstring", "is_method", "is_async", "line")


def _symbols_said(*rows):
    return " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {_said(name)} AS name, {'NULL' if parent is None else _said(parent)} AS parent, '{params}' AS params, '{bases}' AS bases, '{interfaces}' AS interfaces, '{methods}' AS methods, '{decorators}' AS decorators, {'NULL' if doc is None else _said(doc)} AS docstring, {is_method} AS is_method, {is_async} AS is_async, {line} AS line FROM documents"
        for kind, name, parent, params, bases, interfaces, methods, decorators, doc, is_method, is_async, line in rows
    )


@query("code_python_symbols", _symbols_said(("function", "area_{id}", None, "width height rest more", "", "", "", "cached retry(3)", "Area.", "false", "false", 3), ("class", "{name}", "Shape", "", "Shape Sized", "Sized", "size", "", "A box.", "false", "false", 8), ("function", "size", None, "self unit", "", "", "", "", None, "true", "true", 10)))
def _(spark, d):
    return _symbol_rows(_programs(spark, d, PYTHON), "python")


@query("code_php_symbols", _symbols_said(("function", "drive", None, "speed far", "", "", "", "", None, "true", "false", 5), ("function", "all", None, "", "", "", "", "", None, "true", "false", 6), ("function", "start_{id}", None, "car", "", "", "", "", None, "false", "false", 8), ("class", "Car{id}", "Root", "", "Root", "Movable Named", "drive all", "", None, "false", "false", 4)))
def _(spark, d):
    return _symbol_rows(_programs(spark, d, PHP), "php")


_PHP_TOKENS = "<?php namespace App \\ {name} ; use Lib \\ Base as Root ; class Car{id} extends Root implements Movable , Named { public function drive ( $speed , $far = {n} ) { return $this -> go ( $speed ) ; } function all ( ) { yield from $this -> {name} ; } } function start_{id} ( $car ) { $t = << < EOT {n} EOT ; return $car ; }"


@query("code_php_tokens", f"SELECT doc_id, {_said(_PHP_TOKENS)} AS tokens FROM documents")
def _(spark, d):
    return _programs(spark, d, PHP).select("doc_id", F.array_join(C.php_tokens(F.col("code")), " ").alias("tokens"))


@query("code_php_clean", f"SELECT doc_id, {_said('namespace App\\{name};')} AS first, false AS heredoc FROM documents")
def _(spark, d):
    """The line after the tag, and whether the text between the marks is still there."""
    clean = C.clean_php(F.col("code"))
    return _programs(spark, d, PHP).select("doc_id", F.split(clean, "\n")[1].alias("first"), clean.contains("EOT").alias("heredoc"))


@query("code_php_identifiers", f"SELECT doc_id, array_to_string(list_sort(['App', 'Base', {_said('Car{id}')}, 'Lib', {_said('{name}')}, 'Root', 'all', 'car', 'drive', 'far', 'go', 'speed', {_said('start_{id}')}, 't', 'this']), ' ') AS names FROM documents")
def _(spark, d):
    return _programs(spark, d, PHP).select("doc_id", F.array_join(C.php_identifiers(F.col("code")), " ").alias("names"))


@query("code_php_valid", "SELECT doc_id, true AS valid, false AS broken, true AS quoted FROM documents")
def _(spark, d):
    x = _programs(spark, d, PHP).withColumn("open", F.concat("code", F.lit(" f(1;"))).withColumn("quoted", F.concat(F.lit("<?php $a = ')"), "doc_id", F.lit("'; ?>")))
    return x.select("doc_id", *(C.php_valid(F.col(c)).alias(n) for c, n in (("code", "valid"), ("open", "broken"), ("quoted", "quoted"))))
