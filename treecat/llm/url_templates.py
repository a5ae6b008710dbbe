"""URL filter with a path-template tree per host.

The tree is grown level by level from counts, as deep as the paths go: a node
with enough URLs is split, one with fewer is a leaf. Below a node, a path
segment that is frequent enough stays literal, all others become the wildcard
``*``; literal siblings whose labelled block rates do not differ significantly
are merged into one branch. A template's impurity is its smoothed share of
blocked among labelled URLs, drawn towards its parent's; templates that pass
``reject`` are blocked. Labels are the URLs that the host and path rules decide.

All steps are joins and partially aggregated counts over distinct paths. What a
path meets at a level are the lists of its node's literal branches and of the
nodes' wildcards, broadcast up to a checked size, so a host with a third of the
URLs is dealt over all tasks. Each level writes its paths once; those that are
done are not touched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._shared import cut, new_folder, spread_join, table

#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/ ? #`` (A-Z folded), and from there up to ``? #``; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def template_verdicts(
    urls: DataFrame, min_rows: int = 20, min_share: float = 0.02, z: float = 1.96, strength: float = 5.0, reject: float = 0.5, most_broadcast: int = 200_000
) -> DataFrame:
    """``urls(host, path, labelled verdict or null in says)`` -> per distinct (host, path) ``n, template, impurity, template_verdict``.

    A node of fewer than ``min_rows`` URLs is a leaf: what is deeper in its
    paths is ``**``. A node keeps at most 1 / ``min_share`` literal branches.
    Without any label the impurity is 0.5, which ``reject`` 0.5 blocks only
    above, so such URLs are allowed.
    """
    spark = urls.sparkSession
    paths = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("says").alias("k"), F.count(F.when(F.col("says") == "block", 1)).alias("bad")
    )
    paths = cut(paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")), "paths")
    total = paths.agg(F.sum("bad").alias("bad"), F.sum("k").alias("k")).first()
    overall = ((total["bad"] or 0) + strength * 0.5) / ((total["k"] or 0) + strength)
    smooth = lambda prior: (F.col("bad") + F.lit(strength) * prior) / (F.col("k") + F.lit(strength))
    sums = [F.sum(c).alias(c) for c in ("n", "k", "bad")]
    few = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df
    folder, level = new_folder(spark, "templates"), 0

    def settled(grown: DataFrame) -> DataFrame:
        """``grown(..., template, node_n, impurity)`` written as this level, open where the node is split further."""
        more = F.size("segments") > level
        state = F.when(more & (F.col("node_n") >= min_rows), "open").otherwise("done")
        template = F.when(more & (F.col("node_n") < min_rows), F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
        grown = grown.select("host", "path", "n", "k", "bad", "segments", template.alias("template"), "node_n", "impurity", state.alias("state"))
        grown.write.partitionBy("state").parquet(f"{folder}/level={level}")
        return spark.read.schema(grown.schema).parquet(f"{folder}/level={level}").where("state = 'open'").drop("state")

    hosts = cut(paths.groupBy("host").agg(*sums).select("host", F.col("n").alias("node_n"), smooth(F.lit(overall)).alias("impurity")), "hosts")
    paths = settled(paths.join(few(hosts), "host").withColumn("template", F.lit("")))
    while paths.limit(1).count():
        at = paths.withColumn("segment", F.get("segments", F.lit(level)))
        children = at.groupBy("host", "template", "segment").agg(*sums, F.max("node_n").alias("all_n"), F.max("impurity").alias("prior"))
        children = cut(children.withColumn("literal", (F.col("n") >= min_rows) & (F.col("n") >= min_share * F.col("all_n"))), "children")
        # siblings in order of block rate; a new branch starts where two neighbours differ significantly
        literal = children.where("literal").withColumn("rate", F.col("bad") / F.greatest("k", F.lit(1)))
        siblings = Window.partitionBy("host", "template", F.col("k") > 0).orderBy("rate", "segment")
        before = lambda c: F.lag(c).over(siblings)
        pooled = (F.col("bad") + before("bad") + 1) / (F.col("k") + before("k") + 2)
        apart = F.abs(F.col("rate") - before("rate")) > z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("k") + 1 / before("k")))
        literal = literal.withColumn("starts", F.when(F.col("k") > 0, F.coalesce(apart, F.lit(True)).cast("int")).otherwise(1))
        literal = literal.withColumn("branch", F.sum("starts").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
        together = Window.partitionBy("host", "template", F.col("k") > 0, "branch")
        names = F.array_sort(F.collect_list("segment").over(together))
        name = F.when(F.size(names) > 1, F.concat(F.lit("{"), F.concat_ws("|", names), F.lit("}"))).otherwise(F.col("segment"))
        named = literal.select("host", "template", "segment", name.alias("name"), "prior", *(F.sum(c).over(together).alias(c) for c in ("n", "k", "bad")))
        named = named.select("host", "template", "segment", "name", F.col("n").alias("named_n"), smooth(F.col("prior")).alias("named_impurity"))
        rest = children.where("not literal").groupBy("host", "template").agg(*sums, F.max("prior").alias("prior"))
        rest = rest.select("host", "template", F.col("n").alias("rest_n"), smooth(F.col("prior")).alias("rest_impurity"))
        grown = at.join(few(named), ["host", "template", "segment"], "left").join(few(rest), ["host", "template"], "left")
        grown = grown.withColumns(
            {
                "template": F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*"))),
                "node_n": F.coalesce("named_n", "rest_n"),
                "impurity": F.when(F.col("name").isNotNull(), F.col("named_impurity")).otherwise(F.col("rest_impurity")),
            }
        )
        level += 1
        paths = settled(grown)
    schema = "host string, path string, n long, template string, impurity double, level int, state string"
    judged = spark.read.schema(schema).parquet(folder).where("state = 'done'")
    return judged.select("host", "path", "n", "template", "impurity", F.when(F.col("impurity") > reject, "block").otherwise("allow").alias("template_verdict"))


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, **tree) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, impurity)``, one row per row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and is
    judged as such. Repeated rows stay, other columns are not read, no rows
    give no rows.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "says": says})
    found = spread_join(urls, template_verdicts(urls.select("host", "path", "says"), **tree), ["host", "path"])
    return found.select("page_id", "host", "path", "rule", F.coalesce("says", "template_verdict").alias("verdict"), "template", "impurity")


def op10_url_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged, as ``judge_urls`` has it."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _url_sql(depth: int = 8) -> str:
    """The same tree in DuckDB with default parameters, its levels unrolled: for paths of up to ``depth`` segments."""
    fold = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    cases = sorted(RULES, key=lambda r: -len(r[0]))
    fits = [f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')" for t, _ in cases]
    when = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    smooth = "(sum(bad) + 5.0::DOUBLE * {}) / (sum(k) + 5.0::DOUBLE)"
    steps = [
        "r AS MATERIALIZED (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS MATERIALIZED (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r)",
        f"hp AS MATERIALIZED (SELECT page_id, {fold('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"u AS MATERIALIZED (SELECT *, {when([t for t, _ in cases])} AS rule, {when([v for _, v in cases])} AS says FROM hp)",
        "q AS MATERIALIZED (SELECT host, path, count(*) AS n, count(says) AS k, count(*) FILTER (says = 'block') AS bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM u GROUP BY host, path)",
        "o AS MATERIALIZED (SELECT (coalesce(sum(bad), 0) + 5.0::DOUBLE * 0.5::DOUBLE) / (coalesce(sum(k), 0) + 5.0::DOUBLE) AS overall FROM q)",
        f"hs AS MATERIALIZED (SELECT host, sum(n) AS node_n, {smooth.format('(SELECT overall FROM o)')} AS impurity FROM q GROUP BY host)",
        "p0 AS MATERIALIZED (SELECT q.*, CASE WHEN len(seg) > 0 AND node_n < 20 THEN '/**' ELSE '' END AS template, node_n, impurity, len(seg) > 0 AND node_n >= 20 AS more FROM q JOIN hs ON hs.host = q.host)",
    ]
    for i in range(depth):
        steps += [
            f"c{i} AS MATERIALIZED (SELECT host, template, seg[{i + 1}] AS s, sum(n) AS n, sum(k) AS k, sum(bad) AS bad, max(node_n) AS all_n, max(impurity) AS prior FROM p{i} WHERE more GROUP BY 1, 2, 3)",
            f"l{i} AS MATERIALIZED (SELECT *, k > 0 AS known, bad::DOUBLE / greatest(k, 1) AS rate FROM c{i} WHERE n >= 20 AND n >= 0.02::DOUBLE * all_n)",
            f"m{i} AS MATERIALIZED (SELECT *, lag(rate) OVER w AS r0, lag(bad) OVER w AS b0, lag(k) OVER w AS k0 FROM l{i} WINDOW w AS (PARTITION BY host, template, known ORDER BY rate, s))",
            f"t{i} AS MATERIALIZED (SELECT *, CASE WHEN known AND r0 IS NOT NULL AND abs(rate - r0) <= 1.96::DOUBLE * sqrt(q * (1 - q) * (1::DOUBLE / k + 1::DOUBLE / k0)) THEN 0 ELSE 1 END AS starts FROM (SELECT *, (bad + b0 + 1)::DOUBLE / (k + k0 + 2) AS q FROM m{i}))",
            f"b{i} AS MATERIALIZED (SELECT *, sum(starts) OVER (PARTITION BY host, template, known ORDER BY rate, s ROWS UNBOUNDED PRECEDING) AS branch FROM t{i})",
            f"g{i} AS MATERIALIZED (SELECT host, template, known, branch, count(*) AS c, string_agg(s, '|' ORDER BY s) AS names, sum(n) AS n, {smooth.format('max(prior)')} AS impurity FROM b{i} GROUP BY host, template, known, branch)",
            f"x{i} AS MATERIALIZED (SELECT b.host, b.template, b.s, CASE WHEN g.c > 1 THEN '{{' || g.names || '}}' ELSE b.s END AS name, g.n AS n, g.impurity FROM b{i} b JOIN g{i} g ON b.host = g.host AND b.template = g.template AND b.known = g.known AND b.branch = g.branch)",
            f"r{i} AS MATERIALIZED (SELECT host, template, sum(n) AS n, {smooth.format('max(prior)')} AS impurity FROM c{i} WHERE NOT (n >= 20 AND n >= 0.02::DOUBLE * all_n) GROUP BY 1, 2)",
            f"j{i} AS MATERIALIZED (SELECT p.*, x.name, CASE WHEN x.name IS NULL THEN r.n ELSE x.n END AS new_n, CASE WHEN x.name IS NULL THEN r.impurity ELSE x.impurity END AS new_impurity, len(seg) > {i + 1} AS deeper FROM p{i} p LEFT JOIN x{i} x ON x.host = p.host AND x.template = p.template AND x.s = p.seg[{i + 1}] LEFT JOIN r{i} r ON r.host = p.host AND r.template = p.template)",
            f"p{i + 1} AS MATERIALIZED (SELECT host, path, n, k, bad, seg, CASE WHEN more THEN template || '/' || coalesce(name, '*') || CASE WHEN deeper AND new_n < 20 THEN '/**' ELSE '' END ELSE template END AS template, CASE WHEN more THEN new_n ELSE node_n END AS node_n, CASE WHEN more THEN new_impurity ELSE impurity END AS impurity, more AND deeper AND new_n >= 20 AS more FROM j{i})",
        ]
    out = f"""SELECT page_id, u.host, u.path, rule, coalesce(says, CASE WHEN impurity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, p.template, impurity
FROM u JOIN p{depth} p ON u.host = p.host AND u.path = p.path"""
    return "WITH " + ",\n".join(steps) + "\n" + out


URL_SQL = _url_sql()
