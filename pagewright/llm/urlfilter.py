"""URL filter: host/path rules, and block decisions propagated over redirect equivalence.

Two URLs are aliases if a chain of redirects and canonical links joins them. Rules decide first; an
alias without a rule takes the decision of its component, where an explicit allow outweighs any block.
All but the reading of markup is DataFrame code. A node is host + path + query (scheme and fragment do not tell pages apart).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.dom.tree import parse
from pagewright.dom.urls import Unparsable, base_of, join, parse_url
from pagewright.llm.components import connected_components
from pagewright.llm.words import lower_ascii
from pagewright.plans.staging import cleaned, stage

#: Rule lists up to this length become literals of the plan; longer ones are joined on host suffixes.
LITERAL_RULES = 512
#: Content of a meta refresh: seconds, then the target, quoted or not.
REFRESH = re.compile(r"""\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"(?P<double>[^"]*)|'(?P<single>[^']*)|(?P<bare>[^"'].*))""", re.I | re.S)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; empty for null or no ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """Alias identity; null where there is no host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(_rest(url), r"\A[^/?#]*([^#]*)", 1)))


def match_rules(df: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Equal lengths: the
    rule that allows. One row out per row in.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict, r.text))
    if len(ranked) <= LITERAL_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(ranked):
            fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
            rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return df.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = df.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict, i) for i, r in enumerate(ranked)], "r_host string, r_path string, r_text string, r_verdict string, r_rank int")
    places = df.select(F.col(host).alias("p_host"), F.col(path).alias("p_path")).distinct()
    labels = F.split("p_host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        places.withColumn("r_host", F.explode(suffix))
        .join(table, "r_host")
        .where(F.col("p_path").startswith(F.col("r_path")))
        .groupBy("p_host", "p_path")
        .agg(F.min(F.struct("r_rank", "r_text", "r_verdict")).alias("best"))
    )
    kept = df.columns
    return df.join(best, (F.col(host) == F.col("p_host")) & (F.col(path) == F.col("p_path")), "left").select(
        *[df[c] for c in kept], F.col("best.r_text").alias("rule"), F.col("best.r_verdict").alias("rule_verdict")
    )


def alias_targets(html: str, url: str) -> list[str]:
    """Absolute targets of a page's canonical links and meta refreshes, against its url or base element, without fragments."""
    found, head = [], None
    for e in parse(html).elements():
        value = None
        if e.tag == "base" and head is None:
            head = e.attrs.get("href")
        elif e.tag == "link" and "canonical" in (e.attrs.get("rel") or "").lower().split():
            value = e.attrs.get("href")
        elif e.tag == "meta" and (e.attrs.get("http-equiv") or "").strip().lower() == "refresh" and (m := REFRESH.match(e.attrs.get("content") or "")):
            value = m["double"] or m["single"] or m["bare"]
        if value and value.strip():
            found.append(value.strip())
    base, out = base_of(url, head), []
    for value in found:
        try:
            to = join(base, parse_url(value)) if base else parse_url(value)
        except Unparsable:
            out.append(value)
            continue
        if to.authority:
            # as written, not percent-encoded: nodes are compared with page urls as they are
            out.append(f"{to.scheme}://{to.authority}{to.path}" + ("" if to.query is None else "?" + to.query))
    return out


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes from canonical links and meta refreshes; references of any form are resolved. Only pages that name either are parsed."""

    def run(html: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([alias_targets(h, u) for h, u in zip(html.to_pylist(), url.to_pylist())], pa.list_(pa.string()))

    run.__annotations__ = {"html": pa.Array, "url": pa.Array, "return": pa.Array}
    named = pages.select(F.col(html).alias("html"), F.col(url).alias("from")).where(F.col("html").rlike("(?i)canonical|refresh") & F.col("from").isNotNull())
    return (
        named.select("from", F.explode(F.arrow_udf(run, "array<string>")(F.col("html"), F.col("from"))).alias("to"))
        .select(url_node(F.col("from")).alias("src"), url_node(F.col("to")).alias("dst"))
        .where("src is not null and dst is not null and src != dst")
    )


@cleaned
def filter_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame, url: str = "url") -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict`` (existing columns of these names are replaced).

    ``edges``: (src, dst) alias links between nodes, from redirects and canonical links.
    verdict: the rule's; without a rule, allow if any alias has an allow rule, else block if any alias
    has a block rule, else allow. Null or host-less urls have empty host and path and are allowed. Rows that
    repeat stay as often as they come; an empty table gives no rows.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    judged = match_rules(pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")), rules)
    edges = stage(edges.select("src", "dst").distinct(), "aliases")
    if edges.isEmpty():
        return judged.select(*keep, "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    nodes = connected_components(edges, "src", "dst")
    ruled = match_rules(
        nodes.select("node", "component", F.regexp_extract("node", r"\A[^/?#]*", 0).alias("host"), F.regexp_extract("node", r"\A[^/?#]*([^?#]*)", 1).alias("path")), rules
    )
    spoken = ruled.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allows"), F.max(F.col("rule_verdict") == "block").alias("blocks"))
    taken = nodes.join(spoken.where("blocks and not coalesce(allows, false)"), "component", "left_semi").select(F.col("node").alias("blocked_node"))
    alias = F.when(F.col("blocked_node").isNotNull(), "block").otherwise("allow")
    return judged.withColumn("node_of_url", url_node(F.col(url))).join(taken, F.col("node_of_url") == F.col("blocked_node"), "left").select(
        *keep, "host", "path", "rule", F.coalesce("rule_verdict", alias).alias("verdict")
    )
