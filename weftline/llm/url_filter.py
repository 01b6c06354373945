"""URL rules that also reach what redirects and canonical links make the same page; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import components
from weftline.llm.store import cut

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(at_host: Column, at_path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does. Of equally long ones, allow wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((at_host == h) | at_host.endswith(f".{h}")) & at_path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _undotted(p: Column) -> Column:
    """A path without its segments ``.`` and ``..`` (or ``%2e`` for a dot): the latter take the segment before them away, and none from an empty path.
    Paths with such segments alone are folded, at a cost that grows with the square of their segments."""
    dots = lambda s, n: F.regexp_like(s, F.lit(rf"(?i)^(\.|%2e){{{n}}}$"))
    parts = F.split(F.concat(p, F.when(p.rlike(r"(?i)/(\.|%2e){1,2}$"), F.lit("/")).otherwise(F.lit(""))), "/")
    step = lambda kept, s: F.when(dots(s, 1), kept).when(dots(s, 2), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(s)))
    folded = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), folded).otherwise(p)


def node(url: Column) -> Column:
    """What counts as one address: scheme and host in lower case, the path without dot segments, the query; no fragment; null without ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(url), _undotted(path(url)), query))


#: The named references that addresses need, with what they stand for.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(value: Column) -> Column:
    """An attribute's value with numeric references and those of ``NAMED`` decoded once; numbers of no character become U+FFFD.

    A named one needs its semicolon if a letter, digit or ``=`` follows, as in any attribute.
    """
    names = "|".join(NAMED)
    tokens = F.regexp_extract_all(value, F.lit(rf"&(?:#[xX][0-9A-Fa-f]+;?|#[0-9]+;?|(?:{names})(?:;|(?![=A-Za-z0-9])))|[^&]+|&"), F.lit(0))

    def shown(t: Column) -> Column:
        ten, sixteen = F.regexp_extract(t, r"^&#0*([0-9]{1,7});?$", 1), F.regexp_extract(t, r"^&#[xX]0*([0-9A-Fa-f]{1,6});?$", 1)
        code = F.coalesce(ten.try_cast("int"), F.conv(sixteen, 16, 10).try_cast("int"), F.lit(0))
        code = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code).otherwise(0xFFFD)
        out = F.when(t.startswith("&#") & (F.length(t) > 2), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, sign in NAMED.items():
            out = out.when(t.isin(f"&{name};", f"&{name}"), F.lit(sign))
        return out.otherwise(t)

    return F.array_join(F.transform(tokens, shown), "")


def resolved(base: Column, to: Column) -> Column:
    """The address that ``to`` names on a page of address ``base`` (as ``node`` gives it), dot segments and fragment still there; null for schemes
    without ``://``, such as mailto."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path(base), r"(?s)^.*/", 0), F.lit("")), F.lit("/")))
    return (F.when(to.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), to).when(to.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(site, to)).when((to == "") | to.startswith("#"), base)
            .when(to.startswith("?"), F.concat(site, path(base), to)).otherwise(F.concat(folder, to)))


def _attribute(tag: Column, name: str) -> Column:
    """A tag's attribute without quotes, references decoded, blanks about it and line breaks in it taken away; empty if it isn't there."""
    found = F.regexp_extract(tag, rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", 0)
    bare = F.regexp_replace(F.regexp_replace(found, r"(?is)^[\w-]+\s*=\s*", ""), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.trim(F.regexp_replace(decoded(bare), r"[\t\n\r]", ""))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): address of a page and the address that its canonical link or refresh names, relative ones resolved against the page's first base tag
    with an address, else against the page. Comments, scripts and styles hold no tags."""
    shown = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    tags = F.regexp_extract_all(shown, F.lit(r"(?i)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    rows = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(node(F.col(url)).alias("a"), F.explode(F.array(tags)).alias("tags")).where("a is not null")
    bases = F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)^<base\b")), lambda t: _attribute(t, "href"))
    # each explode of one value keeps Spark from writing the expression out wherever the next one names it
    rows = rows.select("a", "tags", F.explode(F.array(F.try_element_at(F.filter(bases, lambda h: h != ""), F.lit(1)))).alias("base"))
    rows = rows.select("a", F.coalesce(node(resolved(F.col("a"), F.col("base"))), "a").alias("base"), F.explode("tags").alias("t"))
    to = F.when(F.col("t").rlike(r"(?i)^<link\b") & F.lower(_attribute(F.col("t"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("t"), "href"))
    refresh = F.regexp_extract(_attribute(F.col("t"), "content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    to = to.when(F.col("t").rlike(r"(?i)^<meta\b") & (F.lower(_attribute(F.col("t"), "http-equiv")) == "refresh"), F.trim(refresh))
    rows = rows.select("a", "base", F.explode(F.array(to)).alias("to")).where("to <> ''")
    rows = rows.select("a", F.explode(F.array(resolved(F.col("base"), F.col("to")))).alias("b"))
    return rows.select("a", node(F.col("b")).alias("b")).where("b is not null and a <> b").distinct()


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict (which replace columns of these names; any other column stays as it is).

    An address is one with all that redirects (refresh) and canonical links tie it to. A page that a rule fits gets the
    rule's verdict. Any other is blocked if a rule blocks an address of its component and no rule allows one; else it is
    allowed. Null urls, and urls without ``://``, have empty host and path, no rule and the verdict allow; null html has no
    links; no pages give no rows. A repeated row is judged again. Hot addresses are the skewed side of a join that Spark may split.
    """
    same = components(links(pages, url, html))
    fit = rule(host(F.col("node")), path(F.col("node")), rules)["verdict"]
    ruled = same.groupBy("component").agg(F.max(F.coalesce(fit == "block", F.lit(False))).alias("b"), F.max(F.coalesce(fit == "allow", F.lit(False))).alias("a"))
    spread = cut(same.join(ruled.where("b and not a"), "component").select("node", F.lit("block").alias("spread")))
    judged = pages.select(F.struct("*").alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), node(F.col(url)).alias("node"))
    judged = judged.withColumn("fit", rule(F.col("host"), F.col("path"), rules)).join(spread, "node", "left")
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("fit.rule"), "verdict": F.coalesce("fit.verdict", "spread", F.lit("allow"))}
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c.lower() not in made]
    return judged.select(*kept, *(v.alias(k) for k, v in made.items()))
