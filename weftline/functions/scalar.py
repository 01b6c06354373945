"""Column functions: dates, templates' building blocks, hashes, redaction, names and contexts of scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def biz_date(text: Column) -> Column:
    """yyyy-MM-dd or yyyyMMdd as a date; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def formatted(date: Column, pattern: str) -> Column:
    """A pattern of y, m and d runs: yy has two digits, m and d two at least; other signs stand for themselves."""
    out, i = [], 0
    while i < len(pattern):
        c, j = pattern[i], i
        while j < len(pattern) and pattern[j] == c:
            j += 1
        n = j - i
        if c == "y":
            out.append(F.date_format(date, "yy") if n == 2 else F.lpad(F.year(date).cast("string"), max(n, 4), "0"))
        elif c in "md":
            out.append(F.lpad((F.month(date) if c == "m" else F.dayofmonth(date)).cast("string"), max(n, 2), "0"))
        else:
            out.append(F.lit(pattern[i:j]))
        i = j
    return F.concat(*out)


def shifted(date: Column, pattern: str, n: int) -> Column:
    """A date moved by n of the smallest unit that the pattern shows."""
    return F.date_add(date, n) if "d" in pattern else F.add_months(date, n if "m" in pattern else 12 * n)


def biz_month(date: Column, today: Column) -> Column:
    """First day of the month, of the month before if it is the current one."""
    month = F.trunc(date, "MM")
    return F.when(month == F.trunc(today, "MM"), F.add_months(month, -1)).otherwise(month)


def cross_cycle(date: Column, offset: Column, back: bool = False) -> Column:
    """The day before for LAST_DAY (or after, backwards), else the same; what is no date stays as it is."""
    moved = F.date_add(biz_date(date), 1 if back else -1)
    return F.when((offset == "LAST_DAY") & moved.isNotNull(), moved.cast("string")).otherwise(date)


def masked_url(url: Column) -> Column:
    """Without the password of a connection string."""
    return F.regexp_replace(F.regexp_replace(url, r"(?i)(password=)[^&;]*", "$1***"), r"(://[^:/@]+:)[^@/]+@", "$1***@")


#: What is redacted, in this order; fixed patterns: an address after -h, passwords, tokens and keys, the authority of an address, IPv4.
SECRETS = (
    r"-h\s+\d+\.\d+\.\d+\.\d+",
    r"(?i)\w*password[=:\s]+\S+",
    r"(?i)\b(?:token|apikey|api_key|secret)[=:]\s*\S+",
    r"(?i)://(?:[^/\s\"'@]+@)?[a-z0-9][a-z0-9_.\-]*(?::\d+)?",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
)


def redacted(text: Column) -> Column:
    """Secrets, hosts and addresses become <redacted>."""
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "<redacted>")
    return text


def dedup_key(text: Column) -> Column:
    """16 hex digits of a hash that neither case nor white space changes."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256), 1, 16)


def content_hash(text: Column) -> Column:
    """Hash that line ends and white space don't change, but case does."""
    return F.sha2(F.trim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\s+", " ")), 256)


#: Licences that allow redistribution; fixed values.
LICENCES = ("apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "isc")


def allowed_licence(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*LICENCES), F.lit(False))


TABLE_AFTER = r"(?i)\b(?:from|join|into|table|overwrite)\s+([a-z_][\w.]*)"


def named_tables(text: Column) -> Column:
    """Distinct names that stand where SQL has tables."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TABLE_AFTER), F.lit(1)), F.lower))


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def dynamic(name: Column) -> Column:
    return name.rlike(r"[${}%]")


def canonical_columns(columns: Column) -> Column:
    """Lower-case last parts; a star or blank one makes the whole set unknown."""
    clean = F.transform(columns, lambda c: leaf(F.lower(F.trim(c))))
    return F.when(F.exists(clean, lambda c: c.isNull() | (c == "") | (c == "*")), None).otherwise(F.array_sort(F.array_distinct(clean)))


def thinned(key: Column, keep: float) -> Column:
    """Whether a key is kept: a share of all, the same in every run."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 10000) < int(keep * 10000)


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), F.lit("-"))


def rerooted(path: Column, old: str, new: str) -> Column:
    """A materialised path with the prefix of a moved subtree replaced."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def trend(json: Column) -> Column:
    """A JSON array of numbers; what is no number is 0."""
    parts = F.split(F.regexp_replace(json, r"[\[\]\s]", ""), ",")
    return F.when(F.coalesce(json, F.lit("")).rlike(r"\d"), F.transform(parts, lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))).otherwise(F.array().cast("array<int>"))


def longest_names(names: Column) -> Column:
    """Without bare names that are the last part of a qualified one in the set."""
    return F.filter(names, lambda x: ~F.exists(names, lambda y: y.endswith(F.concat(F.lit("."), x))))


def same_table(a: Column, b: Column) -> Column:
    """Equal, or one is the other's dotted end."""
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it: within higher-order functions Spark computes it anew each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Contexts of a name in a line of a script, by the first pattern that fits; NAME stands for the name.
CONTEXTS = (
    ("comment", r"^\s*(#|--|//).*\bNAME\b"), ("temp_view", r"(?i)(createOrReplaceTempView|registerTempTable)\(\s*['\"]NAME['\"]|\bwith\s+NAME\s+as\b"), ("import", r"^(?=.*\bNAME\b)\s*(from\s+\S+\s+)?import\b"),
    ("path", r"[/\\]NAME\b|\bNAME[/\\]"), ("table_ref", r"(?i)\b(from|join|into|table|overwrite)\s+([\w.]+\.)?NAME\b"), ("param", r"(--|\$\{?)NAME\b"), ("attribute", r"\.NAME\b"), ("var_decl", r"^\s*NAME\s*="),
)


def contexts(line: Column, name: Column) -> Column:
    """All contexts of a name in a line, in the order of CONTEXTS; ``other`` alone if none fits, null if the line doesn't hold the name."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    fits = []
    for label, pattern in CONTEXTS:
        parts = pattern.split("NAME")
        full = F.lit(parts[0])
        for p in parts[1:]:
            full = F.concat(full, quoted, F.lit(p))
        fits.append(F.when(F.rlike(line, full), label))
    found = F.array_compact(F.array(*fits))
    return F.when(line.contains(name), once(found, lambda x: F.when(F.size(x) == 0, F.array(F.lit("other"))).otherwise(x)))


def context(line: Column, name: Column) -> Column:
    """The first of a name's contexts in a line."""
    return F.get(contexts(line, name), F.lit(0))


#: Contexts in which a name is none of a table.
EXCLUDED = ("comment", "import", "path", "temp_view")


def kept_name(name: Column, text: Column) -> Column:
    """Whether a table's name stands in a script as one: neither dynamic nor a glob, and its last part, in any case, is a word of its own in some
    line whose context isn't excluded. False for nulls and empty last parts.
    """
    last = F.lower(leaf(name))
    word = F.concat(F.lit(r"(?<![0-9A-Za-z_])\Q"), last, F.lit(r"\E(?![0-9A-Za-z_])"))
    stands = F.exists(F.split(F.lower(text), "\n"), lambda line: F.rlike(line, word) & ~context(line, last).isin(*EXCLUDED))
    return F.coalesce(~dynamic(name) & (last != "") & ~last.contains("*") & stands, F.lit(False))


def script_subset(kind: Column, text: Column) -> Column:
    """python, shell or sql: by declared kind, else by the look of the text; sql if nothing tells."""
    return F.coalesce(F.when(F.lower(kind).isin("python", "pyspark"), "python").when(F.lower(kind).isin("shell", "bash"), "shell"), F.when(text.rlike(r"(?m)^\s*(import|from|def)\s"), "python").when(text.rlike(r"(?m)^#!.*sh|^\s*(echo|export)\s"), "shell"), F.lit("sql"))


def job_kind(path: Column, text: Column) -> Column:
    """job or library: by path, then by what a script does at its top level."""
    return F.when(path.rlike(r"(?i)(^|/)(tests?|lib|utils?|setup)(/|\.|$)"), "library").when(text.rlike(r"(?m)^\s*if __name__|spark\.|\.write"), "job").otherwise("library")


def legal_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*){0,2}$"), F.lit(False))


def literal_reject(name: Column, text: Column) -> Column:
    """Why a name is no table that a script names literally: blank, dynamic, path, absent, or view; null if it is."""
    last = leaf(name)
    view = F.concat(F.lit(r"(?i)(createOrReplaceTempView\(\s*['\"]|\bwith\s+|,\s*)\Q"), last, F.lit(r"\E(['\"]|\s+as\s*\()"))
    return (F.when(F.coalesce(F.trim(name), F.lit("")) == "", "blank").when(dynamic(name), "dynamic").when(name.rlike(r"[/\\]"), "path")
            .when(~F.lower(text).contains(F.lower(last)), "absent").when(F.rlike(text, view), "view"))
