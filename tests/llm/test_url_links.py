import html
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from weftline.llm import url_filter


class Plain(HTMLParser):
    """First base address and all canonical links and refreshes of a page, by the standard library."""

    def __init__(self, page):
        super().__init__()
        self.base, self.to = None, []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and a.get("href") and self.base is None:
            self.base = a["href"].strip()
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            self.to.append(a["href"])
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            found = re.match(r"""(?is)\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", a.get("content", ""))
            self.to += [found[1]] if found and found[1] else []


def address(url):
    """Scheme and host in lower case, no dot segments, no fragment."""
    scheme, rest = url.split("://", 1)
    host, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)(\?[^#]*)?", rest).groups()
    kept = []
    parts = path.split("/")
    for k, s in enumerate(parts):
        s = s.replace("%2e", ".").replace("%2E", ".") if s.lower() in ("%2e", ".%2e", "%2e.", "%2e%2e") else s
        if s == "..":
            del kept[max(len(kept) - 1, 1) :]
        elif s != ".":
            kept.append(s)
        if s in (".", "..") and k == len(parts) - 1:
            kept.append("")
    return f"{scheme.lower()}://{host.lower()}{'/'.join(kept)}{query or ''}"


def plain(rows):
    out = set()
    for url, page in rows:
        seen = Plain(page)
        base = urljoin(url, seen.base) if seen.base else url
        for to in seen.to:
            b = urljoin(base, to.strip())
            if "://" in b and address(url) != address(b):
                out.add((address(url), address(b)))
    return out


def test_links_as_the_standard_library_resolves_them(spark):
    r = random.Random(3)
    pages = ["http://q.org/a/b/c?x=1#f", "HTTP://Q.org/", "http://q.org", "https://s.net/d/./e/../f/", "http://q.org/a%2Fb/x.html"]
    to = ["../../../x", "../y", "./", ".", "..", "/en/../fr/1", "//T.com/p/./q", "p?a=1&b=2", "?q", "#top", "http://x.net/fr/9#z", "mailto:a@b.c", "z/../../w/..", "é/ü", "a;b", "x?next=/a/../b", "%2e%2E/k", "/.../m", "..n/.o"]
    bases = [None, None, "/base/", "http://b.com/u/v", "../up/", "sub/dir/"]
    hide = [html.escape, lambda u: u.replace("&", "&#38;"), lambda u: u.replace("&", "&#x26;").replace(".", "&#0046;"), lambda u: "".join(f"&#{ord(c)};" for c in u)]
    rows = []
    for k in range(400):
        u = r.choice(hide)(r.choice(to))
        link = r.choice([f'<link rel=canonical href="{u}">', f"<LINK HREF='{u}' data-href=no REL='x Canonical'>", f'<link rel="canonical" href=" {u}\n">', f"<meta http-equiv=refresh content='0; URL={u}'>", f'<meta content="5;url={u}" http-equiv="Refresh">', f'<link rel="next" href="{u}">'])
        base = r.choice(bases)
        head = "".join(f'<base target="_self" {f"href={chr(34)}{b}{chr(34)}"}>' for b in (base, "/second/") if base and b)
        rows.append((r.choice(pages), "<!-- <base href=/no/> canonical -->" + r.choice([head + link, link + head])))
    got = url_filter.links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert {tuple(x) for x in got} == plain(rows) and len(got) == len(plain(rows)) > 100


def test_references_are_decoded_once(spark):
    cases = {"a&amp;b": "a&b", "&#38;amp;": "&amp;", "&amp;#38;": "&#38;", "&amp=1&ampx": "&amp=1&ampx", "&lt&gt;&quot;&apos;&": "<>\"'&", "&#128512;&#x1F600": "😀😀", "&#0;&#xD800;&#99999999999;&#x110000;": "�" * 4, "&#;&#x;&bogus;": "&#;&#x;&bogus;", "": "", "é&#233;": "éé"}
    rows = spark.createDataFrame([*cases.items(), (None, None)], "v string, w string").select("w", url_filter.decoded(url_filter.F.col("v")).alias("x")).collect()
    assert all(x.w == x.x for x in rows), rows


def test_aliases_over_relative_links_and_columns_of_any_name(spark):
    rows = [
        (1, "http://x.net/fr/1", "", "n", "s", "f"), (2, "http://q.org/a/b/c", '<base href="http://x.net/u/v/"><link rel=canonical href="../../fr/1">', None, None, None),
        (3, "http://q.org/a/../d", "", "n", "s", "f"), (4, "http://q.org/d", "<link rel=canonical href='http://x.net/fr/1?a=1&#38;b=2'>", "n", "s", "f"), (5, None, None, None, None, None), (5, None, None, None, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _node string, spread string, Rule string")
    got = sorted(map(tuple, url_filter.judge(pages).select("page_id", "_node", "spread", "rule", "verdict").collect()), key=str)
    assert got == sorted([(1, "n", "s", "net/fr/", "block"), (2, None, None, None, "block"), (3, "n", "s", None, "block"), (4, "n", "s", None, "block"), (5, None, None, None, "allow"), (5, None, None, None, "allow")], key=str)
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_very_long_paths_and_pages(spark):
    page = "<p>" * 300_000 + '<link rel="canonical" href="' + "a/" * 2_000 + "../" * 2_000 + 'end">'
    got = url_filter.links(spark.createDataFrame([("http://q.org/x/y", page)], "url string, html string")).collect()
    assert [tuple(x) for x in got] == [("http://q.org/x/y", "http://q.org/x/end")]
