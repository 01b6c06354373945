"""Script-corpus and evaluation queries over documents, labels and benchmark passages."""

from pyspark.sql import functions as F

from weftline.functions import scalar as s
from weftline.operators import evaluation as e, keyed
from weftline.registry import Registry

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _docs(t):
    return t.read("documents")


@_r.query("scl_01_biz_date", "SELECT id, CAST(biz_date AS DATE) AS d FROM run")
def biz_dates(t):
    text = F.when(F.col("id") % 2 == 0, F.col("biz_date")).otherwise(F.replace("biz_date", F.lit("-"), F.lit("")))
    return t.run().select("id", s.biz_date(text).alias("d"))


@_r.query("scl_02_pattern_format", "SELECT id, strftime(started_at, '%Y/%m/%d') AS a, strftime(started_at, '%y') AS b FROM run")
def formats(t):
    return t.run().select("id", s.formatted(F.to_date("started_at"), "yyyy/mm/dd").alias("a"), s.formatted(F.to_date("started_at"), "yy").alias("b"))


@_r.query("scl_03_pattern_offset", "SELECT id, CAST(started_at AS DATE) - 3 AS d, CAST(CAST(started_at AS DATE) + INTERVAL 2 MONTH AS DATE) AS m, CAST(CAST(started_at AS DATE) - INTERVAL 1 YEAR AS DATE) AS y FROM run")
def offsets(t):
    day = F.to_date("started_at")
    return t.run().select("id", s.shifted(day, "yyyymmdd", -3).alias("d"), s.shifted(day, "yyyy-mm", 2).alias("m"), s.shifted(day, "yyyy", -1).alias("y"))


@_r.query("scl_04_biz_month", "SELECT id, CAST(CASE WHEN date_trunc('month', started_at) = DATE '1997-05-01' THEN DATE '1997-04-01' ELSE date_trunc('month', started_at) END AS DATE) AS m FROM run")
def months(t):
    return t.run().select("id", s.biz_month(F.to_date("started_at"), F.lit("1997-05-17").cast("date")).alias("m"))


@_r.query("scl_07_json_object", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_object(t):
    return t.read("events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"))


@_r.query("scl_08_cross_cycle_offset", "SELECT id, CASE WHEN id % 3 = 0 THEN strftime(CAST(biz_date AS DATE) - 1, '%Y-%m-%d') ELSE biz_date END AS d FROM inst")
def cross_cycle(t):
    return t.inst().select("id", s.cross_cycle(F.col("biz_date"), F.when(F.col("id") % 3 == 0, "LAST_DAY").otherwise("SAME")).alias("d"))


@_r.query("scl_10_date_range", "SELECT r_regionkey AS task_id, strftime(unnest(generate_series(DATE '2024-01-30', DATE '2024-02-03', INTERVAL 1 DAY)), '%Y-%m-%d') AS biz_date FROM region")
def date_range(t):
    from weftline.operators.readiness import backfill

    return backfill(t.read("region").select(F.col("r_regionkey").alias("task_id")), "2024-01-30", "2024-02-03")


@_r.query("scl_14_masked_url", "SELECT page_id, regexp_replace(regexp_replace('jdbc:x://u:p' || page_id || '@h/db?password=s' || page_id || '&a=1', '(password=)[^&;]*', '\\1***'), '(://[^:/@]+:)[^@/]+@', '\\1***@') AS url FROM pages")
def masked(t):
    return t.read("pages").select("page_id", s.masked_url(F.concat(F.lit("jdbc:x://u:p"), "page_id", F.lit("@h/db?password=s"), "page_id", F.lit("&a=1"))).alias("url"))


_REDACTED = "text"
for _pattern in s.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '<redacted>', 'g')"


@_r.query("scl_15_redacted", f"SELECT doc_id, md5({_REDACTED}) AS h FROM documents")
def redacted(t):
    return _docs(t).select("doc_id", F.md5(s.redacted(F.col("text"))).alias("h"))


@_r.query("scl_15_redacted_cases", r"""SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'mysql <redacted> -u a' WHEN 1 THEN '<redacted> x' WHEN 2 THEN '<redacted>' WHEN 3 THEN 'jdbc:mysql<redacted>/db?a=1' WHEN 4 THEN 's3<redacted>/key' WHEN 5 THEN 'at <redacted>.' ELSE 'plain.table_' || s_suppkey END AS text FROM supplier""")
def redacted_cases(t):
    """Texts with each kind of secret, made of suppliers' numbers."""
    texts = ["mysql -h 10.0.0.%1$s -u a", "PGPASSWORD=abc%2$s x", "api_key: xyz%2$s", "jdbc:mysql://u:p%2$s@db.host-1:3306/db?a=1", "s3://bucket%2$s/key", "at 192.168.1.%1$s.", "plain.table_%2$s"]
    made = (F.format_string(x, (F.col("s_suppkey") % 250).cast("string"), F.col("s_suppkey").cast("string")) for x in texts)
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), s.redacted(F.element_at(F.array(*made), (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("text"))


@_r.query("scl_16_dedup_key", r"SELECT doc_id, substr(sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')), 1, 16) AS k FROM documents")
def dedup_key(t):
    return _docs(t).select("doc_id", s.dedup_key(F.col("text")).alias("k"))


@_r.query("scl_17_content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\s+', ' ', 'g'))) AS h FROM documents")
def content_hash(t):
    return _docs(t).select("doc_id", s.content_hash(F.col("text")).alias("h"))


@_r.query("scl_18_allowed_licence", "SELECT s_suppkey AS id, s_suppkey % 4 IN (0, 1) AS ok FROM supplier")
def allowed(t):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, " MIT ").when(k == 1, "ISC").when(k == 2, "Unlicense")
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), s.allowed_licence(name).alias("ok"))


@_r.query("scl_19_literal_density", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '\b(?:from|join|into|table|overwrite)\s+([a-z_][\w.]*)', 1))) AS n FROM documents")
def density(t):
    return _docs(t).select("doc_id", F.size(s.named_tables(F.lower("text"))).alias("n"))


@_r.query("scl_20_idiom_gate", "SELECT doc_id, regexp_matches(text, '(?i)(license|copyright|https?://|@)') AS ok FROM documents")
def gate(t):
    return _docs(t).select("doc_id", F.col("text").rlike("(?i)(license|copyright|https?://|@)").alias("ok"))


@_r.query("scl_22_script_subset", r"SELECT doc_id, CASE WHEN source = 'src1' THEN 'python' WHEN source = 'src2' THEN 'shell' WHEN regexp_matches(text, '(?m)^\s*(import|from|def)\s') THEN 'python' WHEN regexp_matches(text, '(?m)^#!.*sh|^\s*(echo|export)\s') THEN 'shell' ELSE 'sql' END AS subset FROM documents")
def subset(t):
    kind = F.when(F.col("source") == "src1", "PySpark").when(F.col("source") == "src2", "bash")
    return _docs(t).select("doc_id", s.script_subset(kind, F.col("text")).alias("subset"))


@_r.query("scl_23_leaf_and_dynamic", r"SELECT page_id, regexp_extract(url, '[^.]*$') AS leaf, regexp_matches(url, '[${}%]') AS dynamic FROM pages")
def leaves(t):
    return t.read("pages").select("page_id", s.leaf(F.col("url")).alias("leaf"), s.dynamic(F.col("url")).alias("dynamic"))


@_r.query("scl_24_line_contexts", r"SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '(?i)\b(from|join|into|table|overwrite)\s+([\w.]+\.)?the\b')) AS refs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'the') AND NOT regexp_matches(line, '[/\\]the\b|\bthe[/\\]|^\s*(#|--|//).*\bthe\b') AND NOT (regexp_matches(line, '\bthe\b') AND regexp_matches(line, '^\s*(from\s+\S+\s+)?import\b')) GROUP BY doc_id")
def contexts(t):
    """A line may declare a view and name a table too: every context counts, not the first alone."""
    lines = _docs(t).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", s.contexts(F.col("line"), F.lit("the")).alias("c"))
    return lines.where(~F.arrays_overlap("c", F.array(*map(F.lit, ("comment", "import", "path"))))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.array_contains("c", "table_ref")).alias("refs"))


@_r.query("scl_25_kept_names", "SELECT s_suppkey AS id, s_suppkey % 10 IN (1, 5, 9) AS kept FROM supplier")
def kept_names(t):
    name = lambda before, after="": F.concat(F.lit(before), F.col("k"), F.lit(after))
    texts = [name("# reads t"), name("select *\nfrom db.t"), name("from x.t", " import y"), name("open('/data/t", "/p')"), name("select at", "b from z"), F.concat(F.lit("-- t"), F.col("k"), F.lit("\nJOIN T"), F.col("k"), F.lit(" on 1 = 1")), name("select * from ${db}t"), name("select * from db.t"), name("df.createOrReplaceTempView('t", "')"), name("path = 't", "'")]
    kind = F.col("s_suppkey") % len(texts)
    text = F.coalesce(*(F.when(kind == i, x) for i, x in enumerate(texts)))
    called = F.when(kind == 6, name("${db}t")).when(kind == 7, name("db.t", "*")).otherwise(name("db.t"))
    rows = t.read("supplier").withColumn("k", F.col("s_suppkey").cast("string"))
    return rows.select(F.col("s_suppkey").alias("id"), s.kept_name(called, text).alias("kept"))


@_r.query("scl_27_thinned", "SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2500")
def thinned(t):
    return _docs(t).where(s.thinned(F.col("doc_id").cast("string"), 0.25)).select("doc_id")


@_r.query("scl_30_slug", "SELECT s_suppkey AS id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def slugs(t):
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), s.slug(F.col("s_name")).alias("slug"))


@_r.query("scl_31_rerooted", "SELECT id, CASE WHEN starts_with(p, '/7/') THEN '/1/7/' || substr(p, 4) ELSE p END AS path FROM (SELECT id, '/' || project_id || '/' || id || '/' AS p FROM task)")
def rerooted(t):
    path = F.concat_ws("/", F.lit(""), "project_id", "id", F.lit(""))
    return t.task().select("id", s.rerooted(path, "/7/", "/1/7/").alias("path"))


@_r.query("scl_32_trend_array", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 4 ELSE 0 END AS total FROM supplier")
def trends(t):
    json = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("["), "s_suppkey", F.lit(", x, 4]"))).otherwise("[]")
    return t.read("supplier").select(F.col("s_suppkey").alias("id"), F.aggregate(s.trend(json), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@_r.query("scl_34_longest_names", "SELECT n_nationkey AS id, 1 AS n FROM nation")
def longest(t):
    names = F.array(F.lower("n_name"), F.concat(F.lit("db."), F.lower("n_name")))
    return t.read("nation").select(F.col("n_nationkey").alias("id"), F.size(s.longest_names(names)).alias("n"))


@_r.query("scl_26_canonical_columns", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 <> 0 THEN 'a,b' END AS columns FROM nation")
def canonical(t):
    cols = F.array(F.lit(" T.B "), F.lit("a"), F.when(F.col("n_nationkey") % 4 == 0, "x.*").otherwise("b"))
    return t.read("nation").select(F.col("n_nationkey").alias("id"), F.array_join(s.canonical_columns(cols), ",").alias("columns"))


_SETS = "SELECT l_orderkey AS k, coalesce(list_distinct(list('t' || l_suppkey) FILTER (WHERE l_linenumber <= 4)), []) AS gold, coalesce(list_distinct(list('t' || l_suppkey) FILTER (WHERE l_linenumber >= 2)), []) AS pred FROM lineitem GROUP BY 1"
_COUNTS = f"SELECT k, len(list_intersect(gold, pred)) AS tp, len(pred) - len(list_intersect(gold, pred)) AS fp, len(gold) - len(list_intersect(gold, pred)) AS fn, len(pred) AS pred_total FROM ({_SETS})"
_MICRO = "round(CASE WHEN sum(tp) + sum(fp) = 0 THEN 1 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fp)) END, 6) AS precision, round(CASE WHEN sum(tp) + sum(fn) = 0 THEN 1 ELSE sum(tp)::DOUBLE / (sum(tp) + sum(fn)) END, 6) AS recall, round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0 ELSE 2 * sum(tp)::DOUBLE / (2 * sum(tp) + sum(fp) + sum(fn)) END, 6) AS f1"


def _sets(t):
    pick = lambda c: F.collect_set(F.when(c, F.concat(F.lit("t"), "l_suppkey")))
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(pick(F.col("l_linenumber") <= 4).alias("gold"), pick(F.col("l_linenumber") >= 2).alias("pred"))
    return rows.select("k", e.clean_set(F.col("gold")).alias("gold"), e.clean_set(F.col("pred")).alias("pred"))


def _counts(t):
    return _sets(t).select("k", *(c.alias(n) for n, c in e.counted(F.col("gold"), F.col("pred")).items()))


@_r.query("evl_01_table_sets", f"SELECT k, len(gold) AS n FROM ({_SETS})")
def table_sets(t):
    return _sets(t).select("k", F.size("gold").alias("n"))


_SAME_TABLE = "SELECT a.id, b.id AS other FROM task a JOIN task b ON a.name = b.name"


@_r.query("evl_02_same_table", _SAME_TABLE)
def same_table(t):
    a = t.task().select("id", F.concat(F.lit("db."), "name").alias("qualified"), F.col("name").alias("leaf"))
    b = t.task().select(F.col("id").alias("other"), F.col("name").alias("leaf"))
    return a.join(b, "leaf").where(s.same_table(F.col("qualified"), F.col("leaf"))).select("id", "other")


@_r.query("evl_04_row_counts", _COUNTS)
def row_counts(t):
    return _counts(t)


@_r.query("evl_05_micro_scores", f"SELECT {_MICRO} FROM ({_COUNTS})")
def micro(t):
    return _counts(t).agg(*(c.alias(n) for n, c in e.micro().items()))


@_r.query("agg_31_micro_average", f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_COUNTS})")
def summed(t):
    return _counts(t).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@_r.query("agg_32_scores_by_family", f"SELECT k % 7 AS family, {_MICRO} FROM ({_COUNTS}) GROUP BY 1")
def by_family(t):
    return _counts(t).groupBy((F.col("k") % 7).alias("family")).agg(*(c.alias(n) for n, c in e.micro().items()))


@_r.query("evl_38_overlapping_buckets", f"SELECT bucket, {_MICRO} FROM (SELECT *, unnest(['type-' || k % 3, CASE WHEN k % 3 < 2 THEN 'family-a' ELSE 'family-b' END]) AS bucket FROM ({_COUNTS})) GROUP BY bucket")
def overlapping(t):
    family = F.when(F.col("k") % 3 < 2, "family-a").otherwise("family-b")
    rows = _counts(t).withColumn("bucket", F.explode(F.array(F.concat(F.lit("type-"), F.col("k") % 3), family)))
    return rows.groupBy("bucket").agg(*(c.alias(n) for n, c in e.micro().items()))


@_r.query("evl_06_gate", f"SELECT precision >= 0.85 AND recall >= 0.60 AND f1 >= 0.5 AS passed FROM (SELECT {_MICRO} FROM ({_COUNTS}))")
def gate_passed(t):
    return micro(t).select(((F.col("precision") >= 0.85) & (F.col("recall") >= 0.60) & (F.col("f1") >= 0.5)).alias("passed"))


@_r.query("evl_07_bootstrap_interval")
def interval(t):
    return e.bootstrap(_docs(t).select("doc_id", "n_chars"), "n_chars", seed=12)


@_r.query("evl_09_mcnemar")
def exact_test(t):
    rows = t.read("labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return e.mcnemar(rows, "a", "b")


@_r.query("evl_10_exact_match", f"SELECT k, fp = 0 AND fn = 0 AS exact FROM ({_COUNTS})")
def exact_match(t):
    return _counts(t).select("k", ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"))


_KEY = r"substr(sha256(regexp_replace(lower(trim({0}.text)), '\s+', ' ', 'g')), 1, 16)"


_UNGROUNDED = f"SELECT d.doc_id, count(*) AS n FROM (SELECT doc_id, coalesce(text, '') AS text, {_KEY.format('documents')} AS k FROM documents) d CROSS JOIN (SELECT DISTINCT text, {_KEY.format('benchmark')} AS k FROM benchmark WHERE trim(text) <> '') b WHERE NOT contains(d.text, b.text) AND d.k IS DISTINCT FROM b.k GROUP BY d.doc_id"


@_r.query("evl_11_ungrounded", _UNGROUNDED)
def ungrounded(t):
    names = t.read("benchmark").select(F.col("text").alias("name"))
    gold = _docs(t).select("doc_id", s.dedup_key(F.col("text")).alias("k")).join(names.select("name", s.dedup_key(F.col("name")).alias("k")), "k").select("doc_id", "name")
    return e.ungrounded(_docs(t), names, gold, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


_VOTES = "SELECT l_orderkey AS row, l_suppkey AS item, l_linenumber AS voter FROM lineitem"


def _votes(t):
    return t.read("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("voter"))


@_r.query("evl_20_majority", f"SELECT row, item, count(DISTINCT voter) AS votes FROM ({_VOTES}) GROUP BY row, item HAVING count(DISTINCT voter) >= 2")
def majority(t):
    return e.majority(_votes(t), 2, ["row", "item"])


@_r.query("evl_19_two_teacher_agreement", f"SELECT row, item, count(DISTINCT voter) = 2 AS agreed FROM ({_VOTES}) WHERE voter IN (1, 2) GROUP BY row, item")
def teachers(t):
    return _votes(t).where("voter in (1, 2)").groupBy("row", "item").agg((F.count_distinct("voter") == 2).alias("agreed"))


@_r.query("evl_21_unanimous", f"SELECT row, item FROM ({_VOTES}) GROUP BY row, item HAVING count(DISTINCT voter) = (SELECT max(n) FROM (SELECT count(DISTINCT voter) AS n FROM ({_VOTES}) GROUP BY row))")
def unanimous(t):
    most = _votes(t).groupBy("row").agg(F.count_distinct("voter").alias("n")).agg(F.max("n").alias("most"))
    return e.majority(_votes(t), 1, ["row", "item"]).join(most).where("votes = most").select("row", "item")


@_r.query("evl_25_governance_split", f"SELECT CASE WHEN votes >= 2 THEN 'auto' ELSE 'review' END AS route, count(*) AS n FROM (SELECT row, item, count(DISTINCT voter) AS votes FROM ({_VOTES}) GROUP BY ALL) GROUP BY 1")
def governance(t):
    return e.majority(_votes(t), 1, ["row", "item"]).groupBy(F.when(F.col("votes") >= 2, "auto").otherwise("review").alias("route")).agg(F.count("*").alias("n"))


_POINTS = "SELECT priority AS tier, count(*) FILTER (WHERE state = 'SUCCESS')::DOUBLE AS good, count(*)::DOUBLE AS n FROM run GROUP BY 1"


def _points(t):
    return t.run().groupBy(F.col("priority").alias("tier")).agg(F.count_if(F.col("state") == "SUCCESS").cast("double").alias("good"), F.count("*").cast("double").alias("n"))


@_r.query("evl_13_tier_precision", f"SELECT tier, round(good / n, 6) AS precision FROM ({_POINTS})")
def tier_precision(t):
    return _points(t).select("tier", F.round(F.col("good") / F.col("n"), 6).alias("precision"))


@_r.query("evl_14_frontier", f"SELECT arg_max(tier, n) AS tier, max(round(n / 1000000, 6)) AS recall FROM ({_POINTS}) WHERE good / n >= 0.48")
def best_point(t):
    return e.frontier(_points(t).select("tier", (F.col("good") / F.col("n")).alias("precision"), F.round(F.col("n") / 1000000, 6).alias("recall")), 0.48)


@_r.query("evl_15_folds", "SELECT fold, count(*) AS n, sum(quality)::BIGINT AS good FROM (SELECT quality, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS fold FROM labels) GROUP BY fold")
def five_folds(t):
    return e.folds(t.read("labels"), 5, "doc_id").groupBy("fold").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


_CV = "SELECT fold, lang, count(*) AS n, sum(quality)::BIGINT AS good FROM (SELECT l.quality, d.lang, (row_number() OVER (ORDER BY l.doc_id) - 1) % 5 AS fold FROM labels l JOIN documents d USING (doc_id)) GROUP BY ALL"
_CV = f"SELECT *, rest_n > 0 AND rest_good >= 0.6 * rest_n AS ok FROM (SELECT *, sum(n) OVER (PARTITION BY lang) - n AS rest_n, sum(good) OVER (PARTITION BY lang) - good AS rest_good FROM ({_CV}))"


def _validated(t):
    rows = t.read("labels").select("doc_id", "quality").join(_docs(t).select("doc_id", "lang"), "doc_id")
    return e.cross_validated(rows, 5, "doc_id", "lang", "quality", 0.6)


@_r.query("evl_15_cross_validation", f"SELECT coalesce(sum(n) FILTER (WHERE ok), 0)::BIGINT AS accepted, coalesce(sum(good) FILTER (WHERE ok), 0)::BIGINT AS right, round(CASE WHEN coalesce(sum(n) FILTER (WHERE ok), 0) = 0 THEN 1 ELSE sum(good) FILTER (WHERE ok)::DOUBLE / sum(n) FILTER (WHERE ok) END, 6) AS precision, round(coalesce(sum(good) FILTER (WHERE ok), 0)::DOUBLE / sum(good), 6) AS recall FROM ({_CV})")
def cross_validation(t):
    return _validated(t)[0]


@_r.query("evl_15_accepted_tiers", f"SELECT lang, count(*) AS folds FROM ({_CV}) WHERE ok GROUP BY lang")
def accepted_tiers(t):
    return _validated(t)[1]


@_r.query("evl_16_threshold_sweep", f"SELECT th AS threshold, count(*) FILTER (WHERE good / n >= th) AS kept FROM ({_POINTS}), (SELECT unnest([0.45, 0.48, 0.49, 0.5]) AS th) GROUP BY th")
def sweep(t):
    rows = _points(t).withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in (0.45, 0.48, 0.49, 0.5)))))
    return rows.groupBy("threshold").agg(F.count_if(F.col("good") / F.col("n") >= F.col("threshold")).alias("kept"))


@_r.query("evl_17_envelope", "SELECT src, dst, CASE WHEN confidence IN ('CONFIRMED', 'DECLARED') THEN 'auto' ELSE 'review' END AS route FROM flow")
def envelope(t):
    return t.flow().select("src", "dst", F.when(keyed.confidence_rank() <= 1, "auto").otherwise("review").alias("route"))


@_r.query("evl_18_channel_recall", f"SELECT round(sum(len(list_distinct(list_concat(gold, pred))))::DOUBLE / count(*), 6) AS candidates, round(sum(len(list_intersect(gold, pred)))::DOUBLE / sum(len(gold)), 6) AS recall FROM ({_SETS})")
def channels(t):
    return _sets(t).agg(F.round(F.sum(F.size(F.array_union("gold", "pred"))) / F.count("*"), 6).alias("candidates"), F.round(F.sum(F.size(F.array_intersect("gold", "pred"))) / F.sum(F.size("gold")), 6).alias("recall"))


@_r.query("evl_22_empty_share", "SELECT doc_id FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, (SELECT count(*) FROM labels WHERE quality = 1) AS n FROM labels) WHERE quality = 1 OR k <= floor(n * 0.1 / 0.9)")
def empty_share(t):
    return e.kept_empty(t.read("labels").where("quality is not null"), F.col("quality") == 0, 0.1, "doc_id").select("doc_id")


@_r.query("evl_23_contamination", r"SELECT doc_id FROM documents WHERE substr(sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')), 1, 16) NOT IN (SELECT substr(sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')), 1, 16) FROM benchmark)")
def clean(t):
    gold = t.read("benchmark").select(s.dedup_key(F.col("text")).alias("k"))
    return _docs(t).select("doc_id", s.dedup_key(F.col("text")).alias("k")).join(gold, "k", "left_anti").select("doc_id")


@_r.query("evl_27_needs_review", f"SELECT k, len(gold) AS a, len(pred) AS b, len(list_intersect(gold, pred)) < greatest(len(gold), len(pred)) AS needs_review FROM ({_SETS})")
def needs_review(t):
    return _sets(t).select("k", F.size("gold").alias("a"), F.size("pred").alias("b"), (F.size(F.array_intersect("gold", "pred")) < F.greatest(F.size("gold"), F.size("pred"))).alias("needs_review"))


@_r.query("evl_28_false_positives", f"SELECT count(*) FILTER (WHERE fp > 0 AND tp = 0) AS killable, count(*) FILTER (WHERE fp > 0 AND tp > 0) AS groundable, count(*) FILTER (WHERE fp > 0 AND tp + fn = 0) AS on_empty FROM ({_COUNTS})")
def false_positives(t):
    c = F.col
    return _counts(t).agg(F.count_if((c("fp") > 0) & (c("tp") == 0)).alias("killable"), F.count_if((c("fp") > 0) & (c("tp") > 0)).alias("groundable"), F.count_if((c("fp") > 0) & (c("tp") + c("fn") == 0)).alias("on_empty"))


_NAMES = "SELECT name, bool_or(synthetic) AS synthetic FROM (SELECT p_name AS name, false AS synthetic FROM part UNION ALL SELECT s_name, true FROM supplier UNION ALL SELECT p_name, true FROM part WHERE p_partkey % 50 = 0) GROUP BY name"


@_r.query("evl_30_name_pools", f"SELECT name, CASE WHEN place <= greatest(60, n // 6) THEN 'heldout' ELSE 'train' END AS pool, synthetic FROM (SELECT *, row_number() OVER (ORDER BY md5(name), name) AS place, count(*) OVER () AS n FROM ({_NAMES}))")
def name_pools(t):
    part = t.read("part")
    made = t.read("supplier").select("s_name").union(part.where("p_partkey % 50 = 0").select("p_name"))
    return e.name_pools(part.select("p_name"), made)


ACQUIRED = r"SELECT min(doc_id) AS doc_id, k FROM (SELECT doc_id, substr(sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')), 1, 16) AS k FROM documents WHERE length(text) BETWEEN 200 AND 20000 AND source <> 'src3' AND regexp_matches(text, '(?i)the')) GROUP BY k"


@_r.query("evl_31_acquisition_chain", ACQUIRED)
def acquisition(t):
    rows = _docs(t).where("length(text) between 200 and 20000 and source <> 'src3'").where(F.col("text").rlike("(?i)the"))
    return keyed.first_of(rows.select("doc_id", s.dedup_key(F.col("text")).alias("k")), "doc_id", "k")


@_r.query("evl_32_manifest", "SELECT doc_id, lang, source, md5(text) AS hash FROM documents WHERE text IS NOT NULL")
def manifest(t):
    return _docs(t).where("text is not null").withColumn("hash", F.md5("text")).drop("text", "n_chars")


@_r.query("evl_34_third_party_recall", f"SELECT round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 6) AS recall FROM (SELECT DISTINCT g.row, g.item, EXISTS (SELECT 1 FROM ({_VOTES}) p WHERE p.voter = 3 AND p.row = g.row AND p.item = g.item) AS hit FROM ({_VOTES}) g WHERE g.voter <= 2)")
def third_party(t):
    gold = _votes(t).where("voter <= 2").select("row", "item").distinct()
    third = _votes(t).where("voter = 3").select("row", "item").distinct().withColumn("hit", F.lit(1))
    return gold.join(third, ["row", "item"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@_r.query("evl_35_arbitration", f"SELECT k, len(gold) = 0 AND len(pred) > 0 AS disputed FROM ({_SETS})")
def arbitration(t):
    return _sets(t).select("k", ((F.size("gold") == 0) & (F.size("pred") > 0)).alias("disputed"))


@_r.query("evl_36_rejection_reasons", f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN fp = 0 AND fn = 0 THEN 'kept' WHEN fn = 0 THEN 'superset' WHEN fp = 0 THEN 'missing' ELSE 'mixed' END AS reason FROM ({_COUNTS})) GROUP BY reason")
def reasons(t):
    c = F.col
    reason = F.when((c("fp") == 0) & (c("fn") == 0), "kept").when(c("fn") == 0, "superset").when(c("fp") == 0, "missing").otherwise("mixed")
    return _counts(t).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@_r.query("evl_39_channel_routing", f"SELECT k, CASE WHEN len(gold) > 0 THEN 'sql' ELSE 'model' END AS channel FROM ({_SETS})")
def routing(t):
    return _sets(t).select("k", F.when(F.size("gold") > 0, "sql").otherwise("model").alias("channel"))
