"""URL filtering with redirect equivalence.

Rules (host, path, verdict) fit a host and its subdomains if the path begins with the rule's; the longest
rule wins. Addresses are equivalent when a redirect or canonical link joins them: ``<link
rel=canonical>`` and ``<meta http-equiv=refresh>`` of a page, and the plain form of its own address (https,
no fragment), to which servers redirect. Connected components of these links carry decisions to
addresses that no rule fits: an allow by rule anywhere in a component wins over a block by rule, a block
over nothing; with neither the address is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import docs_of, salted_join
from netsift.llm.components import connected_components
from netsift.session import materialize

#: The rules in use.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _plain(url: Column) -> Column:
    """https and no fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    low = F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.length(bare)))
    return F.regexp_replace(low, "^http://", "https://")


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` parts."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        # the first part is the empty one before the first slash
        lambda got, p: F.when(p == ".", got).when(p == "..", F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(1))))
        .otherwise(F.array_append(got, p)),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def _resolved(to: Column, base: Column) -> Column:
    """``to`` as an address when it stands in the page ``base``. A base without ``://`` leaves it as it is."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own_path = F.regexp_extract(to, r"(?s)^[^?#]*", 0)
    rest = F.substring(to, F.length(own_path) + 1, F.length(to))
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    return (
        F.when((site == "") | (to == "") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("#"), F.concat(site, path, query, to))
        .when(to.startswith("?"), F.concat(site, path, to))
        .when(to.startswith("/"), F.concat(site, _without_dots(own_path), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own_path)), rest))
    )


def _links(pages: DataFrame) -> DataFrame:
    """(a, b) addresses joined by a canonical link, a refresh or the plain form of the address."""
    tag = r"(?is)<link\b[^>]*>|<meta\b[^>]*>"
    tags = F.when(
        F.lower("html").contains("canonical") | F.lower("html").contains("refresh"), F.regexp_extract_all("html", F.lit(tag), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    href = lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    goes = lambda t: F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*["']?\s*\d*\s*;\s*url\s*=\s*["']?([^"'\s>]+)""", 1)
    target = lambda t: F.when(t.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b"""), href(t)).when(
        t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), goes(t)
    )
    told = F.transform(tags, lambda t: _resolved(F.regexp_replace(target(t), r"(?i)&amp;", "&"), F.col("url")))
    plain = _plain(F.col("url"))
    found = pages.where("url IS NOT NULL").select(F.col("url").alias("a"), F.explode(F.array_append(F.coalesce(told, F.array().cast("array<string>")), plain)).alias("b"))
    found = found.where("b IS NOT NULL AND b <> ''")
    # a target has a plain form too, whether it is a page or not
    return found.unionByName(found.select(F.col("b").alias("a"), _plain(F.col("b")).alias("b"))).where("a <> b")


def fitted_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the longest rule that fits each distinct url. Of equally long ones allow
    wins. Each host meets the rules on its suffixes, an equi join whatever the number of rules."""
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = parts.where("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host"))
    one = rules.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    per_host = one.groupBy("rule_host").agg(F.collect_list(F.struct("rule_path", "rule_verdict")).alias("of_host"))
    met = salted_join(spread, per_host, ["rule_host"], "url").select("url", "path", "rule_host", F.explode("of_host").alias("r"))
    met = met.select("url", "path", "rule_host", "r.rule_path", "r.rule_verdict")
    text = F.concat("rule_host", "rule_path")
    fit = met.where(F.col("path").startswith(F.col("rule_path"))).groupBy("url").agg(
        F.max(F.struct(F.length(text).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), text.alias("rule"))).alias("best")
    )
    return fit.select("url", "best.rule", F.when(F.col("best.allow"), F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path; no rule fits it, and a null one has
    no equivalents. Null html has no links. Repeated rows are judged alike. Extra columns are ignored;
    an empty table gives an empty result. A rule with a null part fits nothing."""
    rows = docs_of(pages, "page_id", "url", "html")
    links = materialize(_links(rows).distinct(), "url-links")
    groups = materialize(connected_components(links), "url-groups")
    urls = rows.select("url").where("url IS NOT NULL").unionByName(links.select(F.col("b").alias("url"))).distinct()
    usable = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND rule_verdict IS NOT NULL")
    fitted = materialize(fitted_rules(urls, usable), "url-rules")
    decided = salted_join(groups.withColumnRenamed("node", "url"), fitted.select("url", "verdict"), ["url"], "component").groupBy("component").agg(
        F.bool_or(F.col("verdict") == "allow").alias("allows")
    )
    spoken = salted_join(groups, decided, ["component"], "node").select(
        F.col("node").alias("url"), F.when(F.col("allows"), F.lit("allow")).otherwise(F.lit("block")).alias("by_alias")
    )
    known = materialize(fitted.join(spoken, "url", "full"), "url-decisions")
    slim = rows.select("page_id", "url")
    return salted_join(slim, known, ["url"], "page_id", "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", "by_alias", F.lit("allow")).alias("verdict"),
    )
