"""Tables that SQL inside scripts reads and writes: strings that a script executes, found by scope instead of by words alone.

All of it is column functions: a script is cut into comments, literals, here documents and code by one pattern, so that the parts in a row are the script, and is
walked through once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalar import once

#: One part of a script: a comment, a literal (to its own quote; over several lines if it is double or a command's), a here document, or code up to the next of these.
PART = (
    r"(?s)#[^\n]*+|--[^\n]*+|//[^\n]*+|/\*.*?\*/"
    r"|\"{3}.*?\"{3}|'{3}.*?'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
    r"|\"(?:[^\"\\]|\\.)*+\"|(?<=-[efc] )'(?:[^'\\]|\\.)*+'"
    r"|<<[-~]?\s*+['\"]?(\w+)['\"]?[^\n]*+\n.*?\n\s*+\1\b"
    r"|.(?:(?!<<)[^#\"'/-])*+"
)
#: Calls and commands whose argument is executed, and names that SQL is bound to; fixed values.
CALLS = r"\.\s*(?:sql|execute|executemany|executescript|query|run_query|run|read_sql|read_sql_query|sql_query)\s*\(|\b(?:read_sql|read_sql_query)\s*\("
COMMANDS = r"\b(?:hive|beeline|impala-shell|spark-sql|presto|trino|sqlplus|bq|psql|mysql)\b[^\n]{0,120}?[\s-](?:e|f|c|query)\b"
BOUND = r"\b(?:sql|query|_sql|stmt|statement|ddl|dml)\s*="
#: First words of statements; fixed values.
STATEMENT = (
    r"\b(?:insert\s+overwrite\s+table|insert\s+(?:into|overwrite\s+into)|create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:external\s+)?(?:table|view)|merge\s+into|update\s+\w+\s+set\b|delete\s+from|replace\s+into"
    r"|copy\s+(?:into\s+\w|\w+\s+from\b)|load\s+data\s+(?:local\s+)?(?:inpath|infile)|select\b[^;'\"]{0,400}?\bfrom\b)"
)
#: What marks a text as a template; such texts are left out. Fixed values.
TEMPLATE = r"\{\{|\{%|\$\{|\$CONDITIONS|<[?%]"
#: Schemas of engines' own tables; fixed values.
SYSTEM = ("information_schema", "pg_catalog", "sys", "sys_catalog", "__tables__", "mysql", "performance_schema")
#: Characters of a fragment that words alone find, and of a text that is looked at.
FRAGMENT, LONGEST = 800, 2000

_SINK = rf"(?is)(?:{CALLS}|{COMMANDS}|{BOUND})\s*(?:f|r|rf|fr|b|br)?$"
_NAMED = r"(?is)([A-Za-z_]\w*)\s*=\s*(?:f|r|rf|fr|b|br)?$"
_JOINS = r"(?is)^[\s\\]*\+?[\s\\]*(?:f|r|rf|fr|b|br)?$"
_ARGUMENT = rf"(?is)(?:{CALLS})\s*([A-Za-z_]\w*)\s*[,)]"


def _body(part: Column) -> Column:
    """What a literal or here document holds; null for code and comments."""
    here = F.regexp_extract(part, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1)
    triple = part.startswith('"""') | part.startswith("'''")
    single = (part.startswith('"') & part.endswith('"')) | (part.startswith("'") & part.endswith("'"))
    return F.when(part.startswith("<<"), here).when(triple, F.substr(part, F.lit(4), F.length(part) - 6)).when(single & (F.length(part) >= 2), F.substr(part, F.lit(2), F.length(part) - 2))


def _skipped(part: Column) -> Column:
    """Comments stand for nothing, so what they part goes on."""
    return _holds(part, "#", "--", "//", "/*", by="startswith")


def _holds(text: Column, *words: str, by: str = "contains") -> Column:
    """Whether one of the words is there; far cheaper than a pattern, which then needs to look at few texts."""
    return reduce(lambda a, b: a | b, (getattr(text, by)(w) for w in words))


def executed(text: Column) -> Column:
    """Texts that a script executes: literals that stand in a call, after a command or under a name for SQL, here documents, and literals under any name that a later
    call is given. Literals that are added, or only follow each other, are one text. A null script has none.

    State of the walk: the code just before, the text that is growing and what it grows for, names with their latest texts, and what was found.
    """
    kind = "struct<code:string,growing:string,sink:boolean,name:string,bound:map<string,string>,found:array<string>>"
    start = F.from_json(F.lit('{"code":"","bound":{},"found":[]}'), kind)

    def closed(s: Column) -> tuple[Column, Column]:
        """Names and findings once the growing text is whole."""
        bound = F.when(s["name"].isNotNull() & s["growing"].isNotNull(), F.map_concat(F.map_filter(s["bound"], lambda k, v: k != s["name"]), F.create_map(s["name"], s["growing"]))).otherwise(s["bound"])
        found = F.when(s["sink"] & s["growing"].isNotNull(), F.array_append(s["found"], s["growing"])).otherwise(s["found"])
        return bound, found

    def coded(s: Column, part: Column) -> Column:
        def ended(x: Column) -> Column:
            given = F.when(part.contains("("), F.regexp_extract_all(part, F.lit(_ARGUMENT), F.lit(1))).otherwise(F.array().cast("array<string>"))
            used = F.filter(F.transform(given, lambda g: x["bound"][g]), lambda v: v.isNotNull())
            return made(F.concat(F.when(s["growing"].isNull(), s["code"]).otherwise(""), part), none, F.lit(False), none, x["bound"], F.concat(x["found"], used))

        bound, found = closed(s)
        goes_on = s["growing"].isNotNull() & F.concat(s["code"], part).rlike(_JOINS)
        return F.when(goes_on, made(F.concat(s["code"], part), s["growing"], s["sink"], s["name"], s["bound"], s["found"])).otherwise(once(F.struct(bound.alias("bound"), found.alias("found")), ended))

    def step(s: Column, x: Column) -> Column:
        part, body = x["part"], x["body"]
        adds = s["growing"].isNotNull() & s["code"].rlike(_JOINS)
        bound, found = closed(s)
        name = F.nullif(F.regexp_extract(s["code"], _NAMED, 1), F.lit(""))
        more = made(empty, F.concat(s["growing"], body), s["sink"], s["name"], s["bound"], s["found"])
        fresh = made(empty, body, s["code"].rlike(_SINK), name, bound, found)
        here = made(empty, none, F.lit(False), none, bound, F.array_append(found, body))
        return F.when(x["skipped"], s).when(part.startswith("<<") & body.isNotNull(), here).when(body.isNotNull() & adds, more).when(body.isNotNull(), fresh).otherwise(coded(s, part)).cast(kind)

    made = lambda code, growing, sink, named, b, f: F.struct(code.alias("code"), growing.alias("growing"), sink.alias("sink"), named.alias("name"), b.alias("bound"), f.alias("found"))
    empty, none = F.lit(""), F.lit(None).cast("string")
    parts = F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda p: F.struct(p.alias("part"), _body(p).alias("body"), _skipped(p).alias("skipped")))
    return F.aggregate(parts, start, step, lambda s: closed(s)[1])


def fragments(text: Column) -> Column:
    """What looks like a statement anywhere in a text: from its first words to a semicolon or the quote that closes it, FRAGMENT characters at most."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)(?=({STATEMENT}[^;]{{0,{FRAGMENT}}}))\b"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.substr(x, F.lit(1), F.lit(FRAGMENT)), r"(?s)(?:[\"'`]\s*\)|[\"']\s*(?:\.(?:show|collect|count)|(?:\n|$))).*$", ""))


_PLAIN = r"[`\"]?[a-z_$][\w$]*+[`\"]?"
_TABLE = rf"{_PLAIN}(?:\s*\.\s*{_PLAIN})*+"
_ALIAS = r"(?:\s+(?:as\s+)?(?!(?:where|join|inner|left|right|full|cross|outer|on|using|group|order|having|limit|union|when|set|lateral|natural|window|tablesample|as)\b)[a-z_]\w*+)?"
_READS = rf"\b(?:from|join|using)\s+(?:only\s+)?({_TABLE}(?!\s*\(){_ALIAS}(?:\s*,\s*{_TABLE}(?!\s*\(){_ALIAS})*+)"
_WRITES = rf"(?:\b(?:insert\s+(?:overwrite\s+into|into|overwrite)(?:\s+table)?|create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:external\s+)?table(?:\s+if\s+not\s+exists)?|merge\s+into|replace\s+into|delete\s+from|copy\s+into)|(?<!for\s)(?<!then\s)\bupdate)\s+(?!set\b)({_TABLE})"
_VIEW = rf"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(?:if\s+not\s+exists\s+)?({_TABLE})"
_CTE = rf"(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)({_PLAIN})(?:\s*\([^()]*\))?\s+as\s+(?:not\s+)?(?:materialized\s+)?\("


def _name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"\s*\.\s*", "."), "[`\"]", "")


def _statement(sql: Column) -> Column:
    """reads and writes of one lower-case statement without comments."""
    quoted = F.when(sql.contains("'"), F.regexp_replace(sql, r"'(?:[^'\\]|\\.|'')*+'", "''")).otherwise(sql)
    called = lambda x: F.when(x.contains("("), F.regexp_replace(x, r"\b(?:extract|substring|trim|overlay|position)\s*\([^()]*\)", "0")).otherwise(x)
    return once(once(quoted, called), _named_tables)


def _named_tables(sql: Column) -> Column:
    lists = F.flatten(F.transform(F.regexp_extract_all(sql, F.lit(_READS), F.lit(1)), lambda x: F.split(x, ",")))
    seen = F.transform(lists, lambda x: _name(F.regexp_extract(x, rf"^\s*({_TABLE})", 1)))
    target = F.when(_holds(sql, "into", "overwrite", "table", "delete", "update"), _name(F.regexp_extract(sql, _WRITES, 1))).otherwise("")
    ctes = F.when(_holds(sql, "with", ")") & sql.contains("("), F.transform(F.regexp_extract_all(sql, F.lit(_CTE), F.lit(1)), _name)).otherwise(F.array().cast("array<string>"))
    own = F.concat(ctes, F.array(F.when(sql.contains("view"), _name(F.regexp_extract(sql, _VIEW, 1))).otherwise("")))
    kept = lambda x: (x != "") & ~x.startswith("$") & ~F.exists(F.split(x, r"\."), lambda p: p.isin(*SYSTEM))
    return F.struct(F.filter(F.array_except(seen, own), kept).alias("reads"), F.filter(F.array(target), kept).alias("writes"))


def tables(sqls: Column) -> Column:
    """reads and writes (sorted, each once; what is written isn't read) of texts with statements: no templates, LONGEST characters at most, names of common table
    expressions and of views left out, and so are engines' own tables, variables and function calls."""
    fit = F.filter(sqls, lambda x: (F.length(x) <= LONGEST) & ~(_holds(x, "{", "$", "<") & x.rlike(TEMPLATE)) & x.rlike(f"(?is){STATEMENT}"))
    bare = F.transform(fit, lambda x: F.when(_holds(x, "--", "/*"), F.regexp_replace(F.lower(x), r"(?s)--[^\n]*|/\*.*?\*/", " ")).otherwise(F.lower(x)))
    each = F.transform(F.flatten(F.transform(bare, lambda x: F.split(x, ";"))), _statement)
    both = lambda x: F.struct(F.array_distinct(F.flatten(x["reads"])).alias("reads"), F.array_sort(F.array_distinct(F.flatten(x["writes"]))).alias("writes"))
    return once(once(each, both), lambda x: F.struct(F.array_sort(F.array_except(x["reads"], x["writes"])).alias("reads"), x["writes"].alias("writes")))


def script_lineage(scripts: DataFrame, key: str, text: str = "text", gated: bool = True) -> DataFrame:
    """(key, reads, writes) of each script: of what it executes, or, not ``gated``, of all that looks like a statement and of here documents. Null and empty scripts have none of either."""
    code = F.coalesce(text, F.lit(""))
    here = F.filter(F.transform(F.regexp_extract_all(code, F.lit(PART), F.lit(0)), lambda p: F.when(p.startswith("<<"), _body(p))), lambda x: x.isNotNull())
    found = tables(executed(code) if gated else F.concat(here, fragments(code)))
    return scripts.select(key, found.alias("_found")).select(key, "_found.reads", "_found.writes")
