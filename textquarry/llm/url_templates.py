"""URL filters by a tree of path templates.

For each host, the tree of path segments is generalised level by level from the root. A segment that looks variable (a number, a
hexadecimal string, a UUID, a date) becomes ``*``. Of the branches left, whatever their number, those whose labelled share of bad pages doesn't differ
significantly from the share of all of the node's (a two-sided z test, ``merge_z``) are merged into ``*`` too; a branch that differs keeps its name. At a
node of k > ``max_branches`` branches the limit allows for the many tests: sqrt(merge_z**2 + 2 ln(k / max_branches)), which makes a chance result at least
k / max_branches times rarer. Below ``depth`` levels all that is left of a path, with ``*`` for its variable segments, is one branch more, tested as the
others are, and ``**`` where it is merged: paths count whole, however deep. A leaf is a template; its purity is the smoothed share of good pages among
its labelled ones, (good + prior * base) / (labelled + prior), where base is the share over all pages, and a template is
rejected when its purity is below ``min_purity``.

Labels belong to documents; which document a page shows is told by ``document`` (a column of the pages, or an expression over them), and otherwise is
the first whole-number segment of its path (``document_number``). A page is
bad if its document has quality 0 or is toxic. A document with several labels is bad if any is.

Each level is one aggregation over (host, template so far): a node's branches never come together on the driver or in one task of
Python, and pages are counted once, as distinct paths.

Defined results: null URLs, and URLs without scheme and host, have null host and template, base purity, and pass. Query and fragment don't matter; empty segments
are skipped, so the path may be "/" alone; letters of the host are lowered. Repeated rows count each. Rows with null
page_id get a verdict as any other. Without labels nothing is rejected. Branches that tie need no rule: each is tested against its node.
URLs of any length are read whole. Empty tables give empty results. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textquarry.llm._util import checkpoint, table

DEPTH, MAX_BRANCHES, MERGE_Z, PRIOR, MIN_PURITY = 4, 20, 1.96, 4.0, 0.6
_HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)"
_PATH = "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)"
_VARIABLE = "^([0-9]+([.][a-zA-Z0-9]{1,5})?|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?)$"


def parsed(pages: DataFrame, id_col: str, url_col: str, document: Column | None = None) -> DataFrame:
    """(page_id, url, host, segs, doc)."""
    own = F.lit(None).cast("long") if document is None else document.cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), own.alias("doc"))
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    segs = F.filter(F.split(F.regexp_extract("url", _PATH, 1), "/"), lambda s: s != "")
    rows = rows.select("page_id", "url", F.when(host != "", host).alias("host"), F.when(host != "", segs).alias("segs"), "doc")
    return rows if document is not None else rows.withColumn("doc", document_number(F.col("segs")))


def document_number(segs):
    """The number in the first segment that is a whole number, with or without an ending."""
    first = F.filter(segs, lambda s: s.rlike("^[0-9]{1,18}([.][a-zA-Z]+)?$"))
    return F.regexp_extract(F.try_element_at(first, F.lit(1)), "^([0-9]+)", 1).try_cast("long")


def url_verdicts(pages: DataFrame, labels: DataFrame, depth: int = DEPTH, max_branches: int = MAX_BRANCHES, merge_z: float = MERGE_Z, prior: float = PRIOR, min_purity: float = MIN_PURITY, id_col: str = "page_id", url_col: str = "url", document: Column | None = None) -> DataFrame:
    """(page_id, url, host, template, purity, rejected) of every page."""
    p = parsed(pages, id_col, url_col, document)
    bad_docs = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("doc is not null and bad is not null")
    seen = p.where("host is not null").select("host", "segs", "doc")
    p = p.drop("doc")
    paths = seen.join(bad_docs, "doc", "left").groupBy("host", "segs").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).withColumn("template", F.lit(""))
    seg = lambda i: F.try_element_at("segs", F.lit(i + 1))
    rest = F.array_join(F.transform(F.slice("segs", depth + 1, F.greatest(F.size("segs") - depth, F.lit(0))), lambda s: F.when(s.rlike(_VARIABLE), "*").otherwise(s)), "/")
    for i in range(depth + 1):
        any_ = "*" if i < depth else "**"
        branch = F.when(seg(i).isNull(), F.lit("")).when(seg(i).rlike(_VARIABLE), F.lit("*")).otherwise(seg(i)) if i < depth else rest
        # Written once for each level: it is read twice, and the levels would else be computed anew 2**depth times.
        level = checkpoint(paths.withColumn("branch", branch))
        branches = level.groupBy("host", "template", "branch").agg(F.sum("n").alias("bn"), F.sum("b").alias("bb"))
        node = branches.where("branch <> ''").groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("bn").alias("nn"), F.sum("bb").alias("nb"))
        both = branches.join(node, ["host", "template"], "left")
        share = F.col("nb") / F.col("nn")
        many = F.col("k") / F.lit(float(max(max_branches, 1)))
        z = F.when(many <= 1, F.lit(float(merge_z))).otherwise(F.sqrt(F.lit(float(merge_z) ** 2) + 2 * F.ln(many)))
        differs = (F.col("bn") > 0) & (F.abs(F.col("bb") / F.col("bn") - share) > z * F.sqrt(share * (1 - share) / F.col("bn")))
        name = F.when(F.col("branch") == "", "").when(F.col("branch") == "*", "*").when(differs, F.col("branch")).otherwise(any_)
        named = both.select("host", "template", "branch", name.alias("name"))
        level = level.join(named, ["host", "template", "branch"])
        paths = level.select("host", "segs", "n", "b", F.when(F.col("name") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"))
    paths = checkpoint(paths).withColumn("template", F.when(F.size("segs") == 0, "/").otherwise(F.col("template")))
    total = paths.agg(F.sum("n").alias("tn"), F.sum("b").alias("tb")).select(F.when(F.col("tn") > 0, 1 - F.col("tb") / F.col("tn")).otherwise(1.0).alias("base"))
    leaves = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    scored = leaves.crossJoin(total).select("host", "template", ((F.col("n") - F.col("b") + prior * F.col("base")) / (F.col("n") + prior)).alias("purity"))
    verdict = paths.select("host", "segs", "template").join(scored, ["host", "template"])
    out = p.join(verdict, ["host", "segs"], "left").crossJoin(total)
    purity = F.round(F.coalesce("purity", "base"), 6)
    return out.select("page_id", "url", "host", "template", purity.alias("purity"), (F.col("template").isNotNull() & (purity < min_purity)).alias("rejected"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def oracle(depth: int = DEPTH, max_branches: int = MAX_BRANCHES, merge_z: float = MERGE_Z, prior: float = PRIOR, min_purity: float = MIN_PURITY) -> str:
    q = lambda s: s.replace("'", "''")
    ctes = [
        f"p0 AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '{q(_HOST)}', 1)), '') AS host, list_filter(string_split(regexp_extract(url, '{q(_PATH)}', 1), '/'), lambda s: s <> '') AS sl FROM pages)",
        "p AS (SELECT page_id, url, host, CASE WHEN host IS NOT NULL THEN sl END AS segs FROM p0)",
        "lab AS (SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)",
        "seen AS (SELECT host, segs, try_cast(regexp_extract(list_filter(segs, lambda s: regexp_full_match(s, '[0-9]{1,18}([.][a-zA-Z]+)?'))[1], '^([0-9]+)', 1) AS BIGINT) AS doc FROM p WHERE host IS NOT NULL)",
        "l0 AS (SELECT host, segs, count(bad) AS n, coalesce(sum(bad), 0) AS b, '' AS template FROM seen LEFT JOIN lab USING (doc) GROUP BY host, segs)",
    ]
    for i in range(depth + 1):
        any_ = "*" if i < depth else "**"
        one = f"CASE WHEN segs[{i + 1}] IS NULL THEN '' WHEN regexp_matches(segs[{i + 1}], '{q(_VARIABLE)}') THEN '*' ELSE segs[{i + 1}] END"
        rest = f"array_to_string(list_transform(segs[{depth + 1}:], lambda s: CASE WHEN regexp_matches(s, '{q(_VARIABLE)}') THEN '*' ELSE s END), '/')"
        z = f"(CASE WHEN k <= {max_branches} THEN {merge_z} ELSE sqrt({merge_z}::DOUBLE * {merge_z} + 2 * ln(k / {float(max_branches)}::DOUBLE)) END)"
        ctes += [
            f"a{i} AS (SELECT *, {one if i < depth else rest} AS branch FROM l{i})",
            f"b{i} AS (SELECT host, template, branch, sum(n) AS bn, sum(b) AS bb FROM a{i} GROUP BY ALL)",
            f"c{i} AS (SELECT host, template, count(*) AS k, sum(bn) AS nn, sum(bb) AS nb FROM b{i} WHERE branch <> '' GROUP BY ALL)",
            f"d{i} AS (SELECT host, template, branch, CASE WHEN branch = '' THEN '' WHEN branch = '*' THEN '*' WHEN bn > 0 AND abs(bb / bn - nb / nn) > {z} * sqrt((nb / nn) * (1 - nb / nn) / bn) THEN branch ELSE '{any_}' END AS name FROM b{i} LEFT JOIN c{i} USING (host, template))",
            f"l{i + 1} AS (SELECT host, segs, n, b, CASE WHEN name = '' THEN template ELSE template || '/' || name END AS template FROM a{i} JOIN d{i} USING (host, template, branch))",
        ]
    ctes += [
        f"t AS (SELECT host, segs, n, b, CASE WHEN len(segs) = 0 THEN '/' ELSE template END AS template FROM l{depth + 1})",
        "base AS (SELECT CASE WHEN sum(n) > 0 THEN 1 - sum(b) / sum(n) ELSE 1.0 END AS base FROM t)",
        f"s AS (SELECT host, template, (sum(n) - sum(b) + {prior} * any_value(base)) / (sum(n) + {prior}) AS purity FROM t, base GROUP BY ALL)",
        "v AS (SELECT host, segs, template, purity FROM t JOIN s USING (host, template))",
    ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, url, host, template, round(coalesce(purity, base), 6) AS purity, template IS NOT NULL AND round(coalesce(purity, base), 6) < {min_purity} AS rejected FROM p LEFT JOIN v USING (host, segs), base"


QUERIES = {"op3_url_templates": op3_url_templates}
ORACLES = {"op3_url_templates": oracle()}
