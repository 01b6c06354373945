"""Queries over graded names: orders as scripts, their suppliers as tables."""

from pyspark.sql import functions as F

from weftline.operators import calibration as c
from weftline.registry import Registry

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

_ALIKE = "(a.name = b.name OR ends_with(a.name, '.' || b.name) OR ends_with(b.name, '.' || a.name))"
_SQL = "SELECT DISTINCT l_orderkey AS k, CASE WHEN l_suppkey % 2 = 0 THEN 'db.s' ELSE 's' END || l_suppkey AS name FROM lineitem WHERE l_linenumber <= 3"
_MODEL = "SELECT DISTINCT l_orderkey AS k, CASE WHEN l_suppkey % 3 = 0 THEN 'x.db.s' WHEN l_suppkey % 3 = 1 THEN 'y.s' ELSE 's' END || l_suppkey AS name FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5"
_GOLD = "SELECT DISTINCT l_orderkey AS k, 's' || l_suppkey AS name FROM lineitem WHERE (l_linenumber * 7 + l_suppkey) % (2 + l_suppkey % 4) <> 0"
_GRADED = f"""WITH s AS ({_SQL}), m AS ({_MODEL}), gold AS ({_GOLD}),
    edges AS (SELECT k, name, CASE WHEN EXISTS (SELECT 1 FROM m b WHERE b.k = a.k AND {_ALIKE}) THEN 'agree' WHEN name LIKE '%.%' THEN 'sql_qual' ELSE 'sql_bare' END AS tier FROM s a
        UNION ALL SELECT k, name, CASE WHEN name LIKE '%.%' THEN 'model_qual' ELSE 'model_bare' END FROM m a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND {_ALIKE})),
    keys AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT k FROM gold)),
    e AS (SELECT a.k, a.name, a.tier, EXISTS (SELECT 1 FROM gold b WHERE b.k = a.k AND {_ALIKE}) AS ok FROM edges a WHERE k IN (SELECT k FROM gold)),
    g AS (SELECT b.k, b.name, list_distinct(list(a.tier) FILTER (WHERE a.tier IS NOT NULL)) AS tiers FROM gold b LEFT JOIN edges a ON a.k = b.k AND {_ALIKE} GROUP BY ALL)"""
_PRIOR = "list_position(['agree', 'sql_qual', 'sql_bare', 'model_qual', 'model_bare'], tier)"


def _graded(t):
    line, n, k = t.read("lineitem"), F.col("l_suppkey"), F.col("l_orderkey").alias("k")
    name = lambda head: F.concat(head, n).alias("name")
    parsed = line.where("l_linenumber <= 3").select(k, name(F.when(n % 2 == 0, "db.s").otherwise("s")))
    model = line.where("l_linenumber between 2 and 5").select(k, name(F.when(n % 3 == 0, "x.db.s").when(n % 3 == 1, "y.s").otherwise("s")))
    gold = line.where("(l_linenumber * 7 + l_suppkey) % (2 + l_suppkey % 4) <> 0").select(k, name(F.lit("s")))
    return c.candidates(parsed, model, "k"), gold


@_r.query("evl_12_graded_names", f"{_GRADED} SELECT k, name, tier FROM edges")
def graded(t):
    return _graded(t)[0]


def _curve(order: str) -> str:
    return f"""{_GRADED}, p AS (SELECT tier, count(*) AS n, count(*) FILTER (WHERE ok) AS good, row_number() OVER (ORDER BY {order}) AS place FROM e GROUP BY tier)
        SELECT a.place, a.tier, a.n, a.good AS correct, sum(b.n)::BIGINT AS accepted, round(sum(b.good)::DOUBLE / sum(b.n), 6) AS precision,
            round((SELECT count(*) FROM g WHERE list_has_any(g.tiers, list(b.tier)))::DOUBLE / (SELECT count(*) FROM g), 6) AS recall, round(((SELECT count(*) FROM e) - sum(b.n))::DOUBLE / (SELECT count(*) FROM keys), 6) AS review
        FROM p a JOIN p b ON b.place <= a.place GROUP BY ALL"""


@_r.query("evl_13_prior_order", _curve(_PRIOR))
def prior_order(t):
    return c.curve(*_graded(t), "k", calibrated=False)


@_r.query("evl_13_calibrated_order", _curve(f"count(*) FILTER (WHERE ok)::DOUBLE / count(*) DESC, {_PRIOR}"))
def calibrated_order(t):
    return c.curve(*_graded(t), "k", calibrated=True)


def _folded(k: str, least: float) -> str:
    return f"""{_GRADED}, f AS (SELECT k, i % {k} AS fold FROM keys), x AS (SELECT fold, tier, ok FROM e JOIN f USING (k)), own AS (SELECT fold, tier, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM x GROUP BY ALL),
        whole AS (SELECT tier, sum(n) AS n, sum(good) AS good FROM own GROUP BY tier),
        tr AS (SELECT d.fold, w.tier, w.n - coalesce(o.n, 0) AS n, w.good - coalesce(o.good, 0) AS good FROM (SELECT DISTINCT fold FROM f) d CROSS JOIN whole w LEFT JOIN own o ON o.fold = d.fold AND o.tier = w.tier),
        pl AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY good::DOUBLE / n DESC, {_PRIOR}) AS place FROM tr WHERE n > 0),
        cu AS (SELECT *, sum(good) OVER w::DOUBLE / sum(n) OVER w >= {least} AS ok FROM pl WINDOW w AS (PARTITION BY fold ORDER BY place ROWS UNBOUNDED PRECEDING)),
        ac AS (SELECT d.fold, coalesce((SELECT list(tier ORDER BY place) FROM cu WHERE cu.fold = d.fold AND place < coalesce((SELECT min(place) FROM cu z WHERE z.fold = d.fold AND NOT z.ok), 99)), []) AS accept FROM (SELECT DISTINCT fold FROM f) d),
        ev AS (SELECT a.fold, a.accept, (SELECT count(*) FROM f WHERE f.fold = a.fold) AS n_keys, (SELECT coalesce(sum(n), 0)::BIGINT FROM own o WHERE o.fold = a.fold AND list_contains(a.accept, o.tier)) AS accepted,
            (SELECT coalesce(sum(good), 0)::BIGINT FROM own o WHERE o.fold = a.fold AND list_contains(a.accept, o.tier)) AS correct, v.covered, v.golds
            FROM ac a JOIN (SELECT fold, count(*) FILTER (WHERE list_has_any(g.tiers, ac.accept)) AS covered, count(*) AS golds FROM g JOIN f USING (k) JOIN ac USING (fold) GROUP BY fold) v ON v.fold = a.fold)"""


def _pooled(k: str, least: float) -> str:
    p, r = "CASE WHEN accepted = 0 THEN 1 ELSE correct::DOUBLE / accepted END", "covered::DOUBLE / golds"
    return f"""{_folded(k, least)}, mo AS (SELECT array_to_string(accept, ',') AS modal, count(*) AS modal_folds FROM ev GROUP BY 1 ORDER BY 2 DESC, min(fold) LIMIT 1)
        SELECT count(*) AS folds, round(CASE WHEN sum(accepted) = 0 THEN 1 ELSE sum(correct)::DOUBLE / sum(accepted) END, 6) AS precision, round(sum(covered)::DOUBLE / sum(golds), 6) AS recall,
            round(min({p}), 6) AS precision_min, round(max({p}), 6) AS precision_max, round(min({r}), 6) AS recall_min, round(max({r}), 6) AS recall_max, any_value(modal) AS modal, any_value(modal_folds) AS modal_folds FROM ev, mo"""


def _validated(t, k, least):
    return c.fold_sets(*_graded(t), "k", k, least)


@_r.query("evl_15_fold_sets", f"{_folded('5', 0.744)} SELECT fold, array_to_string(accept, ',') AS accept, n_keys, accepted, correct, covered, golds FROM ev")
def fold_sets(t):
    return _validated(t, 5, 0.744).withColumn("accept", F.array_join("accept", ","))


@_r.query("evl_15_five_folds", _pooled("5", 0.744))
def five_folds(t):
    return c.pooled(_validated(t, 5, 0.744)).withColumn("modal", F.array_join("modal", ","))


@_r.query("evl_15_leave_one_out", _pooled("(SELECT count(*) FROM keys)", 0.744))
def leave_one_out(t):
    return c.pooled(_validated(t, None, 0.744)).withColumn("modal", F.array_join("modal", ","))


_EXPERT = "SELECT l_orderkey AS k, CASE WHEN l_linenumber % 2 = 0 THEN 'reads' ELSE 'writes' END AS role, lower({name}) AS name, (l_linenumber * 100000 + l_suppkey) * 1000000 + l_partkey AS pos, CASE WHEN {null} THEN NULL ELSE 'c' || l_partkey % 5 END AS cols FROM lineitem WHERE {lines}"
_FIRST = "SELECT k, role, name, arg_min({{'c': cols}}, {{'n': cols IS NULL, 'p': pos}}).c AS cols, min(pos) AS pos FROM ({0}) GROUP BY ALL"
_TABLE = _FIRST.format(_EXPERT.format(name="CASE WHEN l_suppkey % 2 = 0 THEN 'DB.s' ELSE 's' END || l_suppkey % 12", null="l_quantity % 3 = 0", lines="l_linenumber <= 5"))
_COLUMN = _FIRST.format(_EXPERT.format(name="CASE WHEN l_suppkey % 3 = 0 THEN 'a.db.s' WHEN l_suppkey % 3 = 1 THEN 'db.s' ELSE 's' END || l_suppkey % 12", null="l_quantity % 4 = 0", lines="l_linenumber >= 2"))


def _fused(union: bool) -> str:
    wanted = "SELECT k, role, name FROM ta UNION SELECT k, role, name FROM co" if union else "SELECT k, role, name FROM ta"
    return f"""WITH ta AS ({_TABLE}), co AS ({_COLUMN}), a AS ({wanted}),
        h AS (SELECT a.k, a.role, a.name, b.cols, row_number() OVER (PARTITION BY a.k, a.role, a.name ORDER BY (a.name <> b.name)::INT, b.pos) AS n FROM a JOIN co b ON b.k = a.k AND b.role = a.role AND {_ALIKE})
        SELECT a.k, a.role, a.name, CASE WHEN h.n IS NOT NULL THEN h.cols ELSE ta.cols END AS columns FROM a LEFT JOIN h ON h.k = a.k AND h.role = a.role AND h.name = a.name AND h.n = 1 LEFT JOIN ta ON ta.k = a.k AND ta.role = a.role AND ta.name = a.name"""


def _experts(t):
    role = F.when(F.col("l_linenumber") % 2 == 0, "reads").otherwise("writes").alias("role")
    n, leaf = F.col("l_suppkey"), F.col("l_suppkey") % 12
    def side(lines, head, null):
        return t.read("lineitem").where(lines).select(F.col("l_orderkey").alias("k"), role, F.concat(head, leaf).alias("name"), F.when(~null, F.array(F.concat(F.lit("c"), F.col("l_partkey") % 5))).alias("columns"), ((F.col("l_linenumber") * 100000 + n) * 1000000 + F.col("l_partkey")).alias("pos"))

    tables = side("l_linenumber <= 5", F.when(n % 2 == 0, " DB.s").otherwise("s"), F.col("l_quantity") % 3 == 0)
    return tables, side("l_linenumber >= 2", F.when(n % 3 == 0, "a.db.s").when(n % 3 == 1, "db.s").otherwise("s"), F.col("l_quantity") % 4 == 0)


@_r.query("evl_24_grafted_columns", _fused(False))
def grafted(t):
    return c.grafted(*_experts(t), ["k", "role"]).withColumn("columns", F.array_join("columns", ","))


@_r.query("evl_24_fused_union", _fused(True))
def fused_union(t):
    return c.grafted(*_experts(t), ["k", "role"], union=True).withColumn("columns", F.array_join("columns", ","))
