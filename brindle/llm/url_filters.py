"""URL verdicts by a tree of path templates, in DataFrame functions only.

The paths of a host form a tree of segments. Runs of digits are wildcards from the start (``/en/17.html``
is ``/en/*.html``). Level by level, each branch is compared with its siblings: branches whose share of
bad labels differs from that of the others by less than ``z`` standard errors are merged into one
wildcard branch, so a literal segment stays only where it matters. What lies deeper than ``depth``
segments is one wildcard. A template is rejected when its share of bad labels, smoothed towards its
host's share (and that towards all hosts', which is a tenth where nothing is labelled), reaches ``threshold``.

Pages are summed up by (host, digit-free path) in each task before anything is shuffled, so a host
with a third of all pages is one row a path and task; each level works on those sums. Only the
small columns of a page travel: id, host, path.

Defined results: a null url or one without ``://`` has an empty host and path and belongs to the
template of that empty host; unlabelled templates take the host's share; repeated rows get the
same verdict; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, UPPER, ascii_lower, join_hot, materialize, salts

#: (verdict, host, path) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path, as the docstring of the module defines them."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("_rest", rest).select(
        *[c for c in pages.columns if c not in ("host", "path")],
        ascii_lower(F.regexp_extract("_rest", "^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_for(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _segments(path: Column, depth: int) -> Column:
    """Non-empty segments with digits as wildcards; those beyond depth are one ``**``."""
    all_of = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/", -1), lambda s: s != "")
    return F.when(F.size(all_of) > depth, F.concat(F.slice(all_of, 1, depth), F.array(F.lit("**")))).otherwise(all_of)


def templates(labelled: DataFrame, depth: int = 4, z: float = 1.96, prior: float = 8.0, threshold: float = 0.5) -> DataFrame:
    """host, shape (a digit-free path), _salts, template, n_pages, n_labelled, n_bad, badness, rejected.

    labelled: page_id, host, path and bad (1 or 0; null where there is no label).
    """
    leaf = (
        labelled.select("host", F.array_join(_segments(F.col("path"), depth), "/").alias("shape"), "bad", "page_id")
        .groupBy("host", "shape")
        .agg(salts("page_id"), F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    )
    leaf = materialize(leaf, "url-shapes").withColumn("template", F.lit(""))
    counts = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    for level in range(depth + 1):
        leaf = leaf.withColumn("seg", F.coalesce(F.get(F.split("shape", "/", -1), F.lit(level)), F.lit("")))
        child = leaf.groupBy("host", "template", "seg").agg(*counts)
        total = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("lab", "bad")])
        p = (F.col("bad") + 1.0) / (F.col("lab") + 2.0)
        others = F.col("all_lab") - F.col("lab") + 2.0
        q = (F.col("all_bad") - F.col("bad") + 1.0) / others
        pool = (F.col("all_bad") + 2.0) / (F.col("all_lab") + 4.0)
        spread = F.sqrt(pool * (1 - pool) * (1 / (F.col("lab") + 2.0) + 1 / others))
        differs = F.abs(p - q) > z * spread
        name = F.when(F.col("seg") == "", F.lit("")).when(differs, F.concat(F.lit("/"), "seg")).otherwise(F.lit("/*"))
        child = child.join(total, ["host", "template"]).select("host", "template", "seg", F.concat("template", name).alias("deeper"))
        leaf = leaf.join(child, ["host", "template", "seg"]).drop("template", "seg").withColumnRenamed("deeper", "template")
        leaf = materialize(leaf, "url-tree")  # else each level would be planned twice in the next
    by_template = leaf.groupBy("host", "template").agg(*counts)
    by_host = by_template.groupBy("host").agg(F.sum("lab").alias("host_lab"), F.sum("bad").alias("host_bad"))
    everywhere = by_host.agg(F.coalesce(F.sum("host_lab"), F.lit(0)).alias("l"), F.coalesce(F.sum("host_bad"), F.lit(0)).alias("b"))
    share = everywhere.select(((F.col("b") + 0.1) / (F.col("l") + 1.0)).alias("share"))
    host_share = (F.col("host_bad") + prior * F.col("share")) / (F.col("host_lab") + prior)
    judged = (
        by_template.join(by_host, "host")
        .crossJoin(F.broadcast(share))  # one row
        .withColumn("badness", (F.col("bad") + prior * host_share) / (F.col("lab") + prior))
        .select("host", "template", F.col("n").alias("n_pages"), F.col("lab").alias("n_labelled"), F.col("bad").alias("n_bad"), "badness")
        .withColumn("rejected", F.col("badness") >= threshold)
    )
    return leaf.select("host", "shape", "_salts", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = 4, **how) -> DataFrame:
    """page_id, host, path, rule, verdict and the template's figures, of pages with page_id, url and bad."""
    pages = materialize(with_host_and_path(pages.select("page_id", "url", "bad")).drop("url"), "url-pages")
    known = templates(pages, depth, **how)
    shape = F.array_join(_segments(F.col("path"), depth), "/")
    rule, said = rule_for(rules)
    own = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        join_hot(pages.withColumn("shape", shape), known, ["host", "shape"], "page_id")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "template", "n_pages", "n_labelled", "n_bad")
    )


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """All pages. A page shows the document that its url's number names, and takes that document's label: bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), "/([0-9]{1,18})(?:[./?#]|$)", 1)
    pages = pages.withColumn("_doc", F.when(number != "", number.cast("long")))
    labels = (
        spark.read.parquet(f"{sf_dir}/labels.parquet")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    )
    # Urls without a number have no label; in the join they would all be one key.
    without = pages.where(F.col("_doc").isNull()).withColumn("bad", F.lit(None).cast("int"))
    return judge(pages.where(F.col("_doc").isNotNull()).join(labels, "_doc", "left").unionByName(without))


def _oracle(depth: int = 4, z: float = 1.96, prior: float = 8.0, threshold: float = 0.5) -> str:
    rule = "NULL", "NULL"
    for what, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"
        rule = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule[0]} END", f"CASE WHEN {fits} THEN '{what}' ELSE {rule[1]} END"
    sql = f"""
WITH b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, bad, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u LEFT JOIN b ON b.doc_id = TRY_CAST(regexp_extract(url, '/([0-9]{{1,18}})(?:[./?#]|$)', 1) AS BIGINT)),
g AS (SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda s: s <> '') AS segs FROM p),
s AS (SELECT *, CASE WHEN len(segs) > {depth} THEN list_append(segs[1:{depth}], '**') ELSE segs END AS sg FROM g),
leaf0 AS (SELECT host, sg, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad, '' AS template FROM s GROUP BY host, sg)"""
    for k in range(depth + 1):
        sql += f""",
l{k} AS (SELECT *, coalesce(sg[{k + 1}], '') AS seg FROM leaf{k}),
c{k} AS (SELECT host, template, seg, sum(lab) AS lab, sum(bad) AS bad FROM l{k} GROUP BY ALL),
t{k} AS (SELECT *, sum(lab) OVER w AS all_lab, sum(bad) OVER w AS all_bad FROM c{k} WINDOW w AS (PARTITION BY host, template)),
d{k} AS (SELECT host, template, seg, abs((bad + 1.0) / (lab + 2.0) - (all_bad - bad + 1.0) / (all_lab - lab + 2.0)) > {z} *
  sqrt((all_bad + 2.0) / (all_lab + 4.0) * (1 - (all_bad + 2.0) / (all_lab + 4.0)) * (1 / (lab + 2.0) + 1 / (all_lab - lab + 2.0))) AS differs FROM t{k}),
leaf{k + 1} AS (SELECT host, sg, n, lab, bad, template || CASE WHEN seg = '' THEN '' WHEN differs THEN '/' || seg ELSE '/*' END AS template
  FROM l{k} JOIN d{k} USING (host, template, seg))"""
    return (
        sql
        + f""",
bt AS (SELECT host, template, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM leaf{depth + 1} GROUP BY ALL),
bh AS (SELECT host, sum(lab) AS hl, sum(bad) AS hb FROM bt GROUP BY host),
ev AS (SELECT (coalesce(sum(hb), 0) + 0.1) / (coalesce(sum(hl), 0) + 1.0) AS share FROM bh),
j AS (SELECT host, template, n, lab, bad, (bad + {prior} * (hb + {prior} * share) / (hl + {prior})) / (lab + {prior}) >= {threshold} AS rejected
  FROM bt JOIN bh USING (host), ev),
x AS (SELECT page_id, s.host, path, f.template, j.n, j.lab, j.bad, rejected FROM s JOIN leaf{depth + 1} f ON f.host = s.host AND f.sg = s.sg
  JOIN j ON j.host = f.host AND j.template = f.template)
SELECT page_id, host, path, CAST({rule[0]} AS VARCHAR) AS rule,
  coalesce({rule[1]}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template,
  CAST(n AS BIGINT) AS n_pages, CAST(lab AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad
FROM x
"""
    )


ORACLE = _oracle()
