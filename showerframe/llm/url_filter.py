"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes.

Rules are rows (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's; the
longest rule wins, then the one with the longer host, then block before allow, then the rule's text. Each distinct site
(host, path) is expanded once, into the expressions that can equal a rule: for every shape of rule (labels of the host,
length of the path) one. Expressions and rules meet on the first digits of their SHA-256; the full digest confirms.

Everything is DataFrame code. No host is a join key with rules unless it is an expression of few rules, and the many pages of
one site are joined back as an ordinary equi-join, which adaptive execution can split."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import table

#: Hex digits of the digest that are joined on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """A few rules as a DataFrame; large rule sets are better kept as a table."""
    rows = [F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "verdict"), r))) for r in rules]
    kind = "array<struct<host:string,path:string,verdict:string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind) if rows else F.lit(None).cast(kind)))


def _labels(host):
    return F.size(F.split(host, r"\."))


def _digest(text):
    return F.sha2(text.cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to ``?``, ``#`` or
    the end. A null url or one without ``://`` has both empty and fits no rule. ``verdict`` is the rule's, else ``default``.
    Repeated rows are judged alike, one row each; null keys are carried; no rules or an empty table are allowed; rules with
    a null are ignored; other columns of either table are not read."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise(F.lit(""))
    split = pages.select(F.col(key).alias("key"), F.coalesce(rest, F.lit("")).alias("rest")).select(
        "key", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    ruled = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("verdict")
                         ).dropna().withColumn("rule", F.concat("r_host", "r_path"))
    # the shapes are few whatever the number of rules: labels and path lengths of urls are short numbers
    shapes = [F.struct(F.lit(r[0]).alias("k"), F.lit(r[1]).alias("n"))
              for r in ruled.select(_labels(F.col("r_host")), F.length("r_path")).distinct().collect()]
    sites = split.select("host", "path").distinct()
    if shapes:
        expressions = sites.select("host", "path", F.explode(F.array(*shapes)).alias("s")).filter(
            (_labels(F.col("host")) >= F.col("s.k")) & (F.length("path") >= F.col("s.n")))
        expressions = expressions.select(
            "host", "path", F.expr("substring_index(host, '.', -s.k)").alias("x_host"),
            F.expr("substring(path, 1, s.n)").alias("x_path"))
    else:
        expressions = sites.filter(F.lit(False)).select("host", "path", F.col("host").alias("x_host"), F.col("path").alias("x_path"))
    # a separator that no host contains keeps (host, path) apart
    named = expressions.withColumn("digest", _digest(F.concat("x_host", F.lit("\u0000"), "x_path"))).select(
        "host", "path", "digest", F.substring("digest", 1, SHORT).alias("short"))
    keyed = ruled.withColumn("r_digest", _digest(F.concat("r_host", F.lit("\u0000"), "r_path"))).withColumn(
        "short", F.substring("r_digest", 1, SHORT))
    rank = F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), (F.col("verdict") == "block").alias("b"),
                    F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    won = (named.join(keyed, "short").filter(F.col("digest") == F.col("r_digest"))
           .groupBy("host", "path").agg(F.max(rank).alias("won"))
           .select("host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict")))
    out = split.join(won, ["host", "path"], "left")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_BEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
           FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _BEST)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _BEST)} ELSE 'allow' END AS verdict
FROM b"""
