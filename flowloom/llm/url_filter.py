"""URL filters with redirect equivalence (DataFrame functions only).

Rules name a host, a path prefix and an action. A rule fits its host and all subdomains where the url's path starts with its
path; the longest (host and path together, ties by text) decides. Hosts are judged once each: a host's suffixes, no longer in labels than the
longest rule, meet the rules, and each host keeps its rules as a list, longest first, in which paths are looked up.

Urls without a rule take the verdict of their aliases. Aliases are connected components over edges between addresses (host,
path, and query without tracking parameters):

* an address and its plain form (without a leading www. or m., a trailing slash, index.html or .html), to which sites redirect;
* a page and the absolute, scheme-relative or root-relative target of its rel=canonical link and of its refresh redirect;
* pairs that the caller gives (`redirects`).

Addresses that no page has, such as targets of links, are judged and pass decisions on as well. If any address of a component has an
allow rule, its members without a rule are allowed; else they are blocked if any has a block rule; else allowed.

Edge cases: a null url or one without :// has an empty host and path; with an empty host there is no rule and no alias, and it is allowed. Repeated rows each give a
row. Null html has no links; links to relative paths or without a host are ignored. Rules without a host or action are ignored, a null path
fits every path. An empty table gives an empty table, no rules allow everything. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.minhash import components
from flowloom.llm.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only say how a visitor came.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|\\z)"
#: The first link or refresh tag of a page that names another address; a tag ends before the next < at the latest.
CANONICAL_TAG = r"(?i)<link\s[^<>]*rel\s*=\s*[\"']?canonical[^<>]*>"
REFRESH_TAG = r"(?i)<meta\s[^<>]*http-equiv\s*=\s*[\"']?refresh[^<>]*>"
HREF, REFRESH_URL = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)", r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)"


def host_and_rest(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and what follows it; both empty without ://."""
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.substring(after, F.length(host) + 1, F.length(after))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^?#]*", 0)


def query_of(rest: Column) -> Column:
    """The query with its question mark, without tracking parameters; empty if nothing else is in it."""
    asked = F.regexp_extract(rest, r"^[^?#]*[?]([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    return F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))


def _parts(url: Column) -> Column:
    """struct(host, path, query); null without ://."""
    host, rest = host_and_rest(url)
    return F.when(F.contains(url, F.lit("://")), F.struct(host.alias("host"), path_of(rest).alias("path"), query_of(rest).alias("query")))


def _plain(at: Column) -> Column:
    """Where an address usually redirects to."""
    host = F.regexp_replace(at["host"], r"^(www|m)\.", "")
    path = F.regexp_replace(at["path"], r"(/index\.html?|\.html?|/)\z", "")
    return F.struct(host.alias("host"), path.alias("path"), at["query"].alias("query"))


def _absolute(link: Column, scheme: Column, host: Column) -> Column:
    """A link's target as an absolute url; null for relative paths."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
    )


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host (a column) that rules (action, host, path) fit: __host and __rules, its rules as structs (size, rule, path, action), longest first."""
    rules = rules.where("host IS NOT NULL AND action IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("__rule_host"), F.coalesce("path", F.lit("")).alias("path"), "action").distinct()
    labels = rules.agg(F.max(F.size(F.split("__rule_host", r"\.")))).first()[0] or 0
    own = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(own), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(own, -n, n), "."))
    met = hosts.select(F.col("host").alias("__host"), F.explode(suffixes).alias("__rule_host")).join(rules, "__rule_host")
    text = F.concat("__rule_host", "path")
    each = F.struct((-F.length(text)).alias("size"), text.alias("rule"), F.col("path"), F.col("action"))
    return met.groupBy("__host").agg(F.array_sort(F.collect_list(each)).alias("__rules"))


def _judged(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes (with at.host, at.path) and __rule: the struct of the longest fitting rule, or null."""
    hosts = nodes.select(F.col("at.host").alias("host")).distinct()
    by_host = materialize(rules_by_host(hosts, rules), "url-rules")
    fitting = F.filter("__rules", lambda r: F.startswith(F.col("at.path"), r["path"]))
    return nodes.join(by_host, F.col("at.host") == F.col("__host"), "left").select(*nodes.columns, F.get(fitting, 0).alias("__rule"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Per page: id, host, path, rule (host and path of the longest fitting one), verdict, via (its aliases' common name, where there are any).

    rules: action ('block' or 'allow'), host, path. redirects: from_url, to_url. html_col: None where pages have none.
    """
    at = _parts(F.col(url_col))
    found = [F.lit(None).cast("string")] * 2
    if html_col is not None:
        html = F.col(html_col)
        tags = [(CANONICAL_TAG, HREF), (REFRESH_TAG, REFRESH_URL)]
        found = [F.nullif(F.regexp_extract(F.regexp_extract(html, tag, 0), link, 1), F.lit("")) for tag, link in tags]
    scheme = F.substring_index(url_col, "://", 1)
    links = [_parts(_absolute(link, scheme, at["host"])) for link in found]
    rows = materialize(pages.select(F.col(id_col).alias("__id"), at.alias("at"), *(x.alias(f"__to{i}") for i, x in enumerate(links))), "url-pages")

    pairs = [rows.where("at IS NOT NULL").select(F.col("at").alias("a"), _plain(F.col("at")).alias("b"))]
    pairs += [rows.where(f"at IS NOT NULL AND __to{i} IS NOT NULL").select(F.col("at").alias("a"), F.col(f"__to{i}").alias("b")) for i in range(2)]
    if redirects is not None:
        given = redirects.select(_parts(F.col("from_url")).alias("a"), _parts(F.col("to_url")).alias("b"))
        pairs.append(given.where("a IS NOT NULL AND b IS NOT NULL"))
    edges = pairs[0]
    for more in pairs[1:]:
        edges = edges.union(more)
    # Targets of links redirect to their plain forms as addresses of pages do.
    edges = edges.union(edges.select(F.col("b").alias("a"), _plain(F.col("b")).alias("b")))
    edges = materialize(edges.where("a.host != '' AND b.host != ''").distinct(), "url-edges")

    nodes = edges.select(F.explode(F.array("a", "b")).alias("at")).distinct()
    nodes = materialize(_judged(nodes, rules), "url-nodes")
    labels = components(edges.where("a != b")).select(F.col("id").alias("__at"), "label")
    nodes = nodes.join(labels, F.col("at") == F.col("__at"), "left").select("at", "__rule", F.coalesce("label", "at").alias("label"), F.col("label").isNotNull().alias("__aliased"))
    nodes = materialize(nodes, "url-aliases")
    ruled = nodes.where("__rule IS NOT NULL").groupBy("label").agg(F.max(F.col("__rule.action") == "allow").alias("__allows"))
    nodes = nodes.join(ruled.withColumnRenamed("label", "__of"), F.col("label") == F.col("__of"), "left").select(
        F.col("at").alias("__at"), F.col("__rule.rule").alias("rule"),
        F.when(F.col("__rule").isNotNull(), F.col("__rule.action")).when(F.col("__allows") | F.col("__allows").isNull(), "allow").otherwise("block").alias("verdict"),
        F.when(F.col("__aliased"), F.concat("label.host", "label.path", "label.query")).alias("via"),
    )
    nodes = materialize(nodes, "url-verdicts")
    out = rows.join(nodes, F.col("at") == F.col("__at"), "left")
    return out.select(
        F.col("__id").alias(id_col), F.coalesce("at.host", F.lit("")).alias("host"), F.coalesce("at.path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "via",
    )
