"""Table and column lineage of SQL text, read off Spark's own plans; nothing is executed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

#: Words that a read-only statement may not hold; fixed values.
FORBIDDEN = ("insert", "update", "delete", "merge", "drop", "alter", "create", "truncate", "grant", "revoke", "replace", "call")


def rejected(sql: str | None) -> str | None:
    """Why a text is no single read-only statement; None if it is one."""
    text = (sql or "").strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if not text:
        return "blank"
    if ";" in text:
        return "several statements"
    if not re.match(r"(?i)(select|with)\b", text):
        return "not a query"
    word = next((w for w in FORBIDDEN if re.search(rf"(?i)\b{w}\b", text)), None)
    return f"holds {word}" if word else None


def rejection(sql: Column) -> Column:
    """``rejected`` for a column of texts: the reason, or null for a single read-only statement."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), r"(?s)^\s+|\s+$", ""), r"(?s)\s*;$", "")
    held = F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda w: F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), w, F.lit(r"\b"))))
    out = F.when(text == "", "blank").when(text.contains(";"), "several statements").when(~text.rlike(r"(?i)^(select|with)\b"), "not a query")
    return out.when(F.size(held) > 0, F.concat(F.lit("holds "), held[0]))


def statements(sql: str) -> list[str]:
    """Statements of a script: split at semicolons outside quotes and comments."""
    parts = re.findall(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", sql, re.S)
    out, held = [], []
    for p in [*parts, ";"]:
        if p == ";":
            text = "".join(held).strip()
            if text:
                out.append(text)
            held = []
        elif not p.startswith(("--", "/*")):
            held.append(p)
    return out


def run_script(spark: SparkSession, sql: str) -> DataFrame | None:
    """Run statement after statement; the result of the last."""
    last = None
    for s in statements(sql):
        last = spark.sql(s)
    return last


def preview(df: DataFrame, rows: int = 200, width: int = 100) -> tuple[list[dict], bool]:
    """Rows cut in number and width, and whether there are more."""
    got = df.limit(rows + 1).collect()
    return [{k: None if v is None else str(v)[:width] for k, v in r.asDict().items()} for r in got[:rows]], len(got) > rows


def scalar(df: DataFrame) -> object:
    """First column of the first row, None without rows."""
    row = df.limit(1).collect()
    return row[0][0] if row else None


def _relations(plan) -> list[str]:
    """Names of relations that a parsed plan reads, common table expressions left out; sub-queries of expressions too."""
    text = plan.treeString()
    names = re.findall(r"UnresolvedRelation \[([^\]]*)\]", text)
    ctes = set(re.findall(r"(?m)CTE \[([^\]]*)\]", text))
    ctes = {c.strip().lower() for x in ctes for c in x.split(",")}
    return [n for n in (".".join(p.strip() for p in x.split(",")).lower() for x in names) if n not in ctes]


def tables(spark: SparkSession, sql: str) -> dict:
    """{parsed, reads, writes} of a script; a statement that can't be parsed makes parsed False."""
    reads, writes, parsed = [], [], True
    for s in statements(sql):
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(s)
        except ParseException:
            parsed = False
            continue
        found = _relations(plan)
        head = re.match(r"(?is)\s*(?:with\b.*?\)\s*)?(insert\s+(?:into|overwrite)(?:\s+table)?|merge\s+into)\s+([\w.`]+)", s)
        target = head[2].replace("`", "").lower() if head else None
        if target:
            writes.append(target)
            found = [n for i, n in enumerate(found) if not (n == target and n in found[:1] and i == 0)]
        reads += found
    keep = lambda x: list(dict.fromkeys(x))
    return {"parsed": parsed, "reads": keep(reads), "writes": keep(writes)}


def columns(spark: SparkSession, query: str, target: list[str] | None = None) -> list[dict]:
    """(target, source columns, transform) of each output column of a query over known tables and views.

    Origins are followed through the analysed plan by expression ids: joins, unions, sub-queries and common table
    expressions are transparent. AGGREGATE if the output is an aggregate call, DIRECT if it is a column, else EXPRESSION; constants have no
    source and no edge.
    """
    df = spark.sql(query)
    lines = df._jdf.queryExecution().analyzed().treeString().splitlines()
    ids = lambda s: re.findall(r"(?<![\w#])([\w`.]+)#(\d+)", s)
    origin: dict[str, set[str]] = {}
    kind: dict[str, str] = {}
    alias = re.compile(r"(.*) AS ([^#\s]+)#(\d+)L?$", re.S)
    bodies = [line.lstrip(" :+-") for line in lines]
    named: dict[str, dict[str, str]] = {}
    for at, body in enumerate(bodies):
        if m := re.match(r"CTERelationDef (\d+)", body):
            top = next((x for x in bodies[at + 1 :] if re.match(r"(?:Project|Aggregate)\s", x)), "")
            named[m[1]] = {n: i for item in _split(top) for n, i in ids(item)[-1:]} | {a[2]: a[3] for item in _split(top) if (a := alias.match(item.strip()))}
    same = {i: named.get(m[1], {}).get(n) for body in bodies if (m := re.match(r"CTERelationRef (\d+)", body)) for n, i in ids(body)}
    for _ in range(1 + len(named)):  # references stand above or below what they refer to
        for body in reversed(bodies):
            if body.startswith("CTERelationRef"):
                for _, i in ids(body):
                    origin[i], kind[i] = origin.get(same.get(i), set()), kind.get(same.get(i), "DIRECT")
            if body.startswith(("Relation ", "LocalRelation", "LogicalRDD", "Range")):
                table = re.search(r"Relation ([\w.]+)\[", body)
                for c, i in ids(body):
                    origin.setdefault(i, {f"{table[1].split('.')[-1]}.{c}" if table else c})
            if not re.match(r"(?:Project|Aggregate|Window)\s", body):
                continue
            for item in _split(body):
                if a := alias.match(item.strip()):
                    origin[a[3]] = set().union(*(origin.get(i, set()) for _, i in ids(a[1])), set())
                    inner = {kind.get(i) for _, i in ids(a[1])}
                    plain = re.fullmatch(r"[\w`.]+#\d+L?", a[1].strip())
                    call = re.fullmatch(r"(sum|count|min|max|avg|first|last|collect_list|collect_set)\(.*\)", a[1].strip(), re.S)
                    kind[a[3]] = "AGGREGATE" if call or plain and "AGGREGATE" in inner else "DIRECT" if plain and not inner - {None, "DIRECT"} else "EXPRESSION"
    out = []
    for k, a in enumerate(df._jdf.queryExecution().analyzed().output().mkString("\u0001").split("\u0001")):
        name, i = re.match(r"(.*)#(\d+)L?$", a).groups()
        if origin.get(i):
            out.append({"target": target[k] if target and k < len(target) else name, "sources": sorted(origin[i]), "transform": kind.get(i, "DIRECT")})
    return out


def _split(body: str) -> list[str]:
    """Items of the last bracketed list of a plan line."""
    start = body.rfind(", [") + 2 if body.startswith("Aggregate") else body.find("[")
    depth, item, out = 0, "", []
    for c in body[start + 1 :]:
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                break
        if c == "," and depth == 0:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


def try_columns(spark: SparkSession, query: str) -> tuple[list[dict], bool]:
    """Column lineage, or none and True where the query can't be analysed."""
    try:
        return columns(spark, query), False
    except (AnalysisException, ParseException):
        return [], True


def cross_checked(parsed: DataFrame, declared: DataFrame) -> DataFrame:
    """(dst, src, confidence): edges that both have are CONFIRMED, parsed alone keep theirs, or CONFLICT where other sources are declared; declared alone are DECLARED."""
    a = parsed.select("dst", "src", F.col("confidence").alias("_p"))
    b = declared.select("dst", "src", F.lit(True).alias("_d"))
    told = declared.select("dst").distinct().withColumn("_told", F.lit(True))
    both = a.join(b, ["dst", "src"], "full").join(told, "dst", "left")
    c = F.when(F.col("_p").isNotNull() & F.col("_d"), "CONFIRMED").when(F.col("_p").isNull(), "DECLARED").when(F.col("_told"), "CONFLICT").otherwise(F.col("_p"))
    return both.select("dst", "src", c.alias("confidence"))


def grounded(edges: DataFrame, existence: DataFrame, system: tuple[str, ...] = ("information_schema", "pg_catalog", "sys", "mysql")) -> DataFrame:
    """Edges checked with a catalog (table, exists: PRESENT, ABSENT or UNKNOWN): inferred ones to system or absent tables go, present ones turn UNVERIFIED into CONFIRMED."""
    rows = edges.join(existence.withColumnRenamed("table", "dst"), "dst", "left")
    gone = (F.col("exists") == "ABSENT") | F.lower(F.substring_index("dst", ".", 1)).isin(*system)
    keep = rows.where(~(F.coalesce(gone, F.lit(False)) & (F.col("confidence") == "UNVERIFIED")))
    return keep.withColumn("confidence", F.when((F.col("exists") == "PRESENT") & (F.col("confidence") == "UNVERIFIED"), "CONFIRMED").otherwise(F.col("confidence"))).drop("exists")


#: Calls of scripts that read or write tables, and whether they write; fixed patterns.
CALLS = ((r"(?:saveAsTable|insertInto|to_sql)\(\s*['\"]([\w.]+)", True), (r"(?:read\.table|spark\.table|read_sql_table)\(\s*['\"]([\w.]+)", False), (r"sqoop\s+import\b.*?--table\s+([\w.]+)", False), (r"sqoop\s+export\b.*?--table\s+([\w.]+)", True))


def script_tables(text: Column) -> tuple[Column, Column]:
    """(reads, writes) that a script's calls name."""
    both = []
    for write in (False, True):
        found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p, w in CALLS if w == write)))
        both.append(F.array_distinct(F.transform(found, F.lower)))
    return both[0], both[1]


#: Comments of scripts, here documents and literals; the first that begins at a place takes all its text.
LITERALS = r"""(?s:(?:(?<=\s)|^)#[^\n]*|<<-?[ ]*['"]?(\w+)['"]?[^\n]*\n.*?\n\s*\1\b|[a-zA-Z]{0,2}(?:'{3}.*?'{3}|"{3}.*?"{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'))"""
SQL_START = r"(?is)^\s*(?:select|insert|with|merge|create\s+table|update|delete\s+from)\b"
#: Calls that execute SQL, given a name and no literal.
EXECUTED = r"\b(?:sql|execute|executemany|read_sql|read_sql_query)\(\s*[A-Za-z_]\w*\s*[,)]"
DYNAMIC_TABLE = r"(?i)\b(?:from|join|into|table|update|overwrite)\s+[\w.]*__dyn__"


def _inner(token: Column) -> Column:
    """What a literal or here document holds; null for a comment."""
    quoted = F.regexp_replace(token, r"^[a-zA-Z]{1,2}(?=['\"])", "")
    width = F.when(quoted.rlike(r"^('{3}|\"{3})"), 3).otherwise(1)
    here = F.regexp_extract(token, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1)
    body = F.when(token.startswith("<<"), here).otherwise(F.substr(quoted, width + 1, F.length(quoted) - 2 * width))
    return F.when(~token.startswith("#"), body)


def _filled(sql: Column) -> Column:
    """Places for values as NULL, variables as __dyn__."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(sql, r"^\s+|\s+$", "")), r"%s|\?", "NULL"), r"\$?\{[^}]*\}|\$\w+", "__dyn__")


def embedded_sql(text: Column) -> Column:
    """SQL texts within a script, whole literals and here documents, with their variables as NULL or __dyn__."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LITERALS), F.lit(0)), _inner)
    return F.transform(F.filter(found, lambda x: x.rlike(SQL_START)), _filled)


def _lines(text: Column) -> Column:
    """Line ends in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def embedded_statements(scripts: DataFrame, key: str = "script", text: str = "text") -> DataFrame:
    """(key, line, sql, hint) of SQL within scripts: the line, from 1, on which its literal begins.

    hint: DYNAMIC_TABLE where a variable is, or is part of, a table's name, else null. A call that executes a name instead of a literal is a row
    without SQL, hint DYNAMIC_SQL. Comments hold none; null and empty texts have no rows.
    """
    found = F.regexp_extract_all("_text", F.lit(f"{LITERALS}|{EXECUTED}"), F.lit(0))
    rows = scripts.select(key, F.col(text).alias("_text")).withColumn("_found", found)
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("line"), F.expr("cast(array() as array<struct<token:string,line:int>>)").alias("out"))

    def step(held: Column, token: Column) -> Column:
        at = F.position(token, F.col("_text"), held["at"])
        line = held["line"] + _lines(F.substr(F.col("_text"), held["at"], at - held["at"]))
        out = F.array_append(held["out"], F.struct(token.alias("token"), line.alias("line")))
        return F.struct((at + F.length(token)).alias("at"), (line + _lines(token)).alias("line"), out.alias("out"))

    each = rows.select(key, F.explode(F.aggregate("_found", start, step)["out"]).alias("x")).select(key, "x.line", F.col("x.token").alias("_token"))
    call = F.col("_token").rlike(f"^{EXECUTED}$")
    each = each.withColumn("_sql", F.when(~call, _inner(F.col("_token")))).where(call | F.col("_sql").rlike(SQL_START)).withColumn("sql", _filled(F.col("_sql")))
    return each.select(key, "line", "sql", F.when(call, "DYNAMIC_SQL").when(F.col("sql").rlike(DYNAMIC_TABLE), "DYNAMIC_TABLE").alias("hint"))


def declared_columns(text: Column) -> Column:
    """(table, column) of a declared table.column: the last point splits; null for a malformed one."""
    ok = text.rlike(r"^[\w]+(\.[\w]+)*\.[\w]+$")
    return F.when(ok, F.struct(F.regexp_extract(text, r"^(.*)\.[^.]+$", 1).alias("table"), F.regexp_extract(text, r"\.([^.]+)$", 1).alias("column")))


def column_edges(statements: DataFrame) -> DataFrame:
    """(statement, dst, src) of statements (statement, targets, catalog, sources), each edge once.

    The i-th target is fed by the i-th list of sources: targets are those that the statement lists, else the table's columns in catalog order; what one
    side has more is left out. Blank names and constants (no sources) have no edge.
    """
    fed = F.slice(F.arrays_zip(_targets().alias("dst"), F.col("sources").alias("src")), F.lit(1), F.least(F.size(_targets()), F.size("sources")))
    pairs = statements.select("statement", F.explode(fed).alias("x")).select("statement", F.trim("x.dst").alias("dst"), F.explode("x.src").alias("src"))
    return pairs.withColumn("src", F.trim("src")).where("dst <> '' and src <> ''").distinct()


def _targets() -> Column:
    return F.when(F.size("targets") > 0, F.col("targets")).otherwise(F.col("catalog"))


def degraded(statements: DataFrame) -> DataFrame:
    """(statement, degraded): whether targets and sources differ in number, or a target has no source."""
    return statements.select("statement", ((F.size(_targets()) != F.size("sources")) | F.exists("sources", lambda x: F.size(x) == 0)).alias("degraded"))
