"""URL filtering with redirect equivalence.

Rules on hosts and path prefixes decide the URLs they fit. URLs that redirect to one another or
name one another as canonical are aliases: the connected components of those edges. An alias that
no rule fits takes its component's decision: allow if a rule allows any of its URLs, else block
if a rule blocks one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import let, stored, text_of
from emberlog.llm.graph import components

#: A tag that can carry an edge or the base of its address, its quoted values taken whole.
TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# Steps within a path, and named references for characters that URLs are made of.
HERE, UP = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
NAMED = {"amp": "&", "AMP": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "colon": ":", "sol": "/", "period": ".", "quest": "?",
         "num": "#", "equals": "=", "percnt": "%", "lowbar": "_", "comma": ",", "semi": ";", "plus": "+", "commat": "@", "excl": "!",
         "ast": "*", "lpar": "(", "rpar": ")", "bsol": "\\", "Tab": "\t", "NewLine": "\n"}
REFERENCE = r"&(?:#[0-9]{1,12};?|#[xX][0-9A-Fa-f]{1,12};?|(?:amp|AMP|lt|gt|quot)(?![A-Za-z0-9=]);?|[A-Za-z]+;)"

#: What is no markup of the page itself.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty for a null URL or one without it."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The resource that a URL names: host, path (its dot steps taken) and query, without scheme and
    fragment; null if it has no host."""
    def resource(u: Column) -> Column:
        query = F.regexp_extract(rest_of(u), r"^[^/?#]*[^?#]*(\?[^#]*)?", 1)
        return F.named_struct(F.lit("host"), host_of(u), F.lit("path"), path_of(u), F.lit("query"), query)
    return let(let(url, resource), lambda u: F.when(
        u["host"] != "", F.concat(u["host"], F.when(u["path"] == "", "/").otherwise(without_dots(u["path"])), u["query"])))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path prefix) that fits, as a struct ``rule, verdict``;
    null if none does. A rule fits its host and all hosts below it. Of rules equally long, allow wins."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))

    def first(u: Column) -> Column:
        found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
        for verdict, on, prefix in longest_first:
            fits = ((u["host"] == on) | u["host"].endswith("." + on)) & u["path"].startswith(prefix)
            found = found.when(fits, F.struct(F.lit(on + prefix).alias("rule"), F.lit(verdict).alias("verdict")))
        return found
    return let(F.struct(host.alias("host"), path.alias("path")), first)


def _character(number: Column) -> Column:
    """The character of a reference's number; what is none stays out."""
    return F.when((number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("")


def _unescaped(value: Column) -> Column:
    """A value with its character references decoded, once: by number, and those names that stand
    for characters of URLs."""
    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&([A-Za-z]+);?$", 1)
        found = F.regexp_extract(piece, r"^&#0*([0-9]{1,7});?$", 1)
        in_hex = F.regexp_extract(piece, r"^&#[xX]0*([0-9A-Fa-f]{1,6});?$", 1)
        known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
        return (F.when(~piece.startswith("&"), piece).when(found != "", _character(found.cast("bigint")))
                .when(in_hex != "", _character(F.conv(in_hex, 16, 10).cast("bigint")))
                .otherwise(F.coalesce(known[name], piece)))
    def joined(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"(?s){REFERENCE}|&|[^&]+"), F.lit(0))
        return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)
    return let(value, joined)


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def _address(href: Column) -> Column:
    """A link as browsers read it: no spaces around it, no line ends or tabs within, ``\\`` of its path as ``/``."""
    plain = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
    return let(plain, lambda u: F.concat(F.translate(F.regexp_extract(u, r"^[^?#]*", 0), "\\", "/"), F.regexp_extract(u, r"^[^?#]*(.*)$", 1)))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken; those above the root are dropped."""
    def step(done: Column, part: Column) -> Column:
        up, here = F.lower(part).isin(*UP), F.lower(part).isin(*HERE)
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(here, done).otherwise(F.array_append(done, part))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.lower(F.element_at(parts, -1))
    ends = F.when(last.isin(*UP, *HERE) & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).otherwise(path)


def _resolved(href: Column, base: Column) -> Column:
    """A link as a full URL, seen from a page or its base; null if it is none of the web."""
    def parts(u: Column) -> Column:
        query = F.regexp_extract(rest_of(u["base"]), r"^[^?#]*(\?[^#]*)?", 1)
        return F.named_struct(F.lit("href"), u["href"], F.lit("site"), F.concat(F.lit("x://"), host_of(u["base"])),
                              F.lit("path"), path_of(u["base"]), F.lit("query"), query)

    def against(u: Column) -> Column:
        site, path, query, link = u["site"], u["path"], u["query"], u["href"]
        folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
        return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
                .when(link.startswith("//"), F.concat(F.lit("x:"), link))
                .when((link == "") | link.startswith("#"), F.concat(site, path, query))
                .when(link.startswith("/"), F.concat(site, link))
                .when(link.startswith("?"), F.concat(site, path, link))
                .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
                .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link)))
    return let(let(F.named_struct(F.lit("href"), href, F.lit("base"), base), parts), against)


def edges(pages: DataFrame) -> DataFrame:
    """``a, b``: the resource of a page, and the one that its canonical link or its refresh leads to.

    Links are seen from the page's first ``base`` that has an ``href``, or else from its URL, after their character references are
    decoded. Links in comments, scripts and styles do not count; nor do pages without a host or with null html."""
    html = text_of("html")
    own = pages.where(F.lower(html).rlike("canonical|refresh") | html.contains("&#")).select("url", F.regexp_replace(html, HIDDEN, " ").alias("html"))
    tags = own.select("url", F.regexp_extract_all("html", F.lit(TAG), F.lit(0)).alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: F.lower(t).startswith("<base")), lambda t: _attribute(t, "href")), lambda h: h != "")
    base = F.when(F.size(bases) > 0, _resolved(_address(_unescaped(F.get(bases, F.lit(0)))), F.col("url")))
    tags = tags.select("url", F.coalesce(base, "url").alias("base"), F.explode(F.filter("tags", lambda t: ~F.lower(t).startswith("<base"))).alias("tag"))
    tag = F.col("tag")
    kinds = F.split(F.lower(_unescaped(_attribute(tag, "rel"))), r"\s+")
    canonical = F.lower(tag).startswith("<link") & F.array_contains(kinds, "canonical")
    refresh = F.lower(tag).startswith("<meta") & (F.lower(F.trim(_unescaped(_attribute(tag, "http-equiv")))) == "refresh")
    target = F.regexp_extract(_unescaped(_attribute(tag, "content")), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    href = F.when(canonical, _unescaped(_attribute(tag, "href"))).when(refresh, target)
    links = tags.where(canonical | refresh).select(
        node_of(F.col("url")).alias("a"), node_of(_resolved(_address(href), F.col("base"))).alias("b"))
    return links.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url, html, ...)``.

    A URL that a rule fits has the rule's verdict. Another takes its component's, or ``default`` if
    the component has none or there is no component. Null URLs have an empty host and path."""
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    aliases = components(stored(edges(pages), "url-edges"))
    resource = F.concat(F.lit("x://"), F.col("node"))
    ruled = aliases.withColumn("verdict", rule_of(host_of(resource), path_of(resource), rules)["verdict"])
    decided = ruled.groupBy("component").agg(F.min("verdict").alias("shared")).where("shared is not null")  # allow sorts before block
    shared = aliases.join(decided, "component").select("node", "shared")
    return own.join(shared, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "shared", F.lit(default)).alias("verdict"))
