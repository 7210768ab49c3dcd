"""A deterministic corpus of Markdown lines and documents, the same expression in Spark SQL and DuckDB.

Real pages hold few of the constructs that line operators look for; here every row of ``lineitem`` becomes
one line, and an order key modulo 5000 becomes one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

P, Q, D = "CAST(l_partkey AS {s})", "CAST(l_suppkey AS {s})", "CAST(l_partkey % 28 + 1 AS {s})"
#: Line templates by (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 30, as SQL.
TEMPLATES = (
    "''",
    "''",
    f"concat('[Home ', {P}, '](https://ex.com/', {Q}, ')')",
    "'[Next](/p2) [Prev](/p1)'",
    "'[1](/p1) [2](/p2) [older](/p3)'",
    f"{P}",
    "'Add a comment'",
    "'Follow'",
    "'[Share](/share)'",
    "'[timeline](/t)'",
    "'```'",
    f"concat('# Heading ', {D})",
    f"concat('[Heading ', {D}, '](/h/', {P}, ')')",
    f"concat('Heading ', {D})",
    f"concat('- [item ', {P}, '](/i/', {Q}, ')')",
    "'- [broken metric'",
    f"concat('Plain **bold** text _', {P}, '_ with a `code` and [link](/l/', {Q}, ') in it.')",
    f"concat('![card ', {D}, '](/c.png)')",
    f"concat('[![card ', {D}, '](/c.png) Title](/card)')",
    f"concat('EngineeringJan ', {D}, ', 2024 news')",
    "'[Skip to content](#main)'",
    "'## Filter'",
    "'Sort  '",
    f"concat('| a | ', {P}, ' | c |')",
    "'| --- | --- | --- |'",
    f"concat('> quote ', {P}, ' and search the blog, search docs')",
    f"concat('Étude numéro ', {D}, ' naïve café')",
    "'Loading notifications   '",
    f"concat('[a](/b)[![img](/i', {D}, '.png)](/j)')",
    f"concat('[owner](/o)/ **[repo', {D}, '](/r)** Public')",
)


def line_sql(string: str) -> str:
    """A CASE expression over lineitem; ``string``: the engine's text type."""
    cases = " ".join(f"WHEN {k} THEN {t.format(s=string)}" for k, t in enumerate(TEMPLATES))
    return f"CASE (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % {len(TEMPLATES)} {cases} END"


#: CTEs for DuckDB: corpus_lines (doc, ord, pos from 1, line) and corpus (doc, md).
DUCK = f"""corpus_lines AS (
  SELECT l_orderkey % 5000 AS doc, row_number() OVER (PARTITION BY l_orderkey % 5000 ORDER BY l_orderkey, l_linenumber, {line_sql('VARCHAR')}) AS pos, {line_sql('VARCHAR')} AS line FROM lineitem
), corpus AS (SELECT doc, string_agg(line, chr(10) ORDER BY pos) AS md FROM corpus_lines GROUP BY doc)"""


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, k, n, line): lines with their order (k, n, line) inside a document."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select((F.col("l_orderkey") % 5000).alias("doc"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.expr(line_sql("STRING")).alias("line"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, md)."""
    lines = F.sort_array(F.collect_list(F.struct("k", "n", "line")))
    return corpus_lines(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("md"))
