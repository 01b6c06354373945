"""Small cases with results worked out by hand."""

import time
from math import comb

import pytest
from pyspark.sql import functions as F

from weftline import catalog
from weftline.functions import scalar as s
from weftline.operators import evaluation, filters, graph, keyed, readiness, sqllineage
from weftline.streaming import outbox


def edges(spark):
    return spark.createDataFrame([("a", "b", 10), ("b", "c", 11), ("c", "d", 12), ("b", "e", 13)], "src string, dst string, task_id long")


def nodes(spark):
    return spark.createDataFrame([(x,) for x in "abcde"], "id string")


def test_reach_paths_and_levels(spark):
    e, n = edges(spark), nodes(spark)
    assert {r.id: r.hop for r in graph.downstream(e, n, "a", 20).collect()} == {"b": 1, "c": 2, "e": 2, "d": 3}
    assert {r.id for r in graph.upstream(e, n, "d", 20).collect()} == {"a", "b", "c"}
    assert [r.path for r in graph.paths(e, "a", "d", 5).collect()] == [["a", "b", "c", "d"]]
    assert {(r.other, r.level) for r in graph.task_levels(e, 5).where("task_id = 10").collect()} == {(11, 1), (13, 1), (12, 2)}
    assert graph.peeled(e, 5).count() == 0
    assert graph.peeled(e.union(spark.createDataFrame([("d", "b", 1)], e.schema)), 9).count() > 0
    assert {r.id: r.layer for r in graph.layers(e, n, 4).collect()} == {"a": 0, "b": 1, "c": 2, "e": 2, "d": 3}


def test_edges_of_a_strength_are_met(spark):
    rows = spark.createDataFrame([(1, 1, 2, "FAILED", "STRONG"), (1, 2, 3, "FAILED", "WEAK"), (1, 3, 4, "SUCCESS", "STRONG"), (1, 3, 5, "WAITING", "WEAK")], "run_id int, src int, dst int, src_state string, strength string")
    got = readiness.unmet_upstream(spark.createDataFrame([(1, i) for i in range(1, 6)], "run_id int, node int"), rows)
    assert {r.node: r.unmet for r in got.collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_greedy_placement(spark):
    waiting = spark.createDataFrame([(i, i % 3, "p") for i in range(5)], "id long, priority long, pool string")
    free = spark.createDataFrame([("x", 2, "p"), ("y", 1, "p")], "node string, free long, pool string")
    assert {(r.id, r.node) for r in readiness.placed(waiting, free).collect()} == {(0, "x"), (3, "x"), (1, "y")}


def test_backfill_bounds(spark):
    with pytest.raises(ValueError):
        readiness.backfill(spark.range(1).withColumnRenamed("id", "task_id"), "2024-02-02", "2024-02-01")


def test_diff_and_updates(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "n")], "id int, v string")
    assert {(r.id, r.change, r.v) for r in keyed.diff(old, new, "id").collect()} == {(2, "modified", "x"), (4, "added", "n")}


def test_filters_without_values_pass_all(spark):
    assert spark.range(5).where(filters.every([None, filters.one_of("id", " , "), filters.infix(None, "id")])).count() == 5
    assert filters.held_limit(0) == 100 and filters.held_limit(9999) == 2000 and filters.held_depth(50) == 20


def test_scalars(spark):
    row = spark.range(1).select(
        s.biz_date(F.lit("20240230")).alias("none"), s.cross_cycle(F.lit("2024-03-01"), F.lit("LAST_DAY")).alias("before"), s.redacted(F.lit("password=abc jdbc://u:p@h/x 10.0.0.1")).alias("red"),
        s.context(F.lit("# from a.b"), F.lit("b")).alias("c1"), s.context(F.lit("select * from x.b"), F.lit("b")).alias("c2"), s.canonical_columns(F.array(F.lit("t.A"), F.lit("*"))).alias("cc")).first()
    assert (row["none"], row.before, row.red, row.c1, row.c2, row.cc) == (None, "2024-02-29", "<redacted> jdbc<redacted>/x <redacted>", "comment", "table_ref", None)


def test_mcnemar(spark):
    rows = spark.createDataFrame([(True, False)] * 4 + [(False, True)] * 20 + [(True, True)] * 5, "a boolean, b boolean")
    r = evaluation.mcnemar(rows, "a", "b").first()
    assert (r.b_only, r.c_only) == (4, 20) and abs(r.p - 0.0015) < 0.0005


def test_mcnemar_of_many_rows_agrees_with_whole_numbers_and_takes_no_longer():
    for b, c in ((501, 500), (700, 700), (1100, 1000), (200, 1800), (1500, 1), (990, 1010), (3000, 3300)):
        want = min(1.0, 2 * sum(comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
        assert evaluation._two_sided(b, c) == pytest.approx(want, rel=1e-12, abs=1e-320)
    start = time.perf_counter()
    assert 0.68 < evaluation._two_sided(499_800, 500_200) < 0.7 and evaluation._two_sided(0, 10**8) == 0.0
    assert time.perf_counter() - start < 5


def test_contexts_of_a_line_are_all_told(spark):
    row = spark.range(1).select(s.contexts(F.lit("insert from the here with the as x"), F.lit("the")).alias("c"), s.context(F.lit("insert from the here with the as x"), F.lit("the")).alias("first"), s.contexts(F.lit("other the"), F.lit("the")).alias("o"), s.contexts(F.lit("none"), F.lit("the")).alias("n")).first()
    assert (row.c, row.first, row.o, row.n) == (["temp_view", "table_ref"], "temp_view", ["other"], None)


def test_line_contexts_of_a_view_line_as_sql_has_them(spark, tmp_path):
    import duckdb
    from weftline.plans import corpus

    text = "nothing\nwe wait with the as read from the end\n# from the\nimport the with the as\nthe"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus.QUERIES["scl_24_line_contexts"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(corpus.ORACLES["scl_24_line_contexts"]).fetchall() == [(1, 2, 1)]


def test_a_hop_makes_what_it_finds_distinct_and_not_all_edges(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    twice = edges(spark).union(edges(spark))
    assert sorted(tuple(r) for r in graph.reach(twice, spark.createDataFrame([("a",)], "id string"), 2).collect()) == [("a", 0), ("b", 1), ("c", 2), ("e", 2)]
    assert plans[1].count("Aggregate") == 1


def test_ungrounded_names_as_brute_force(spark):
    long = "x" * 60
    docs = [(1, f"select a from {long}1"), (41, "only here"), (2, None), (3, "from b.c")]
    names = [f"{long}1", f"{long}2", "b.c", "here", "here", " ", None]
    gold = [(2, "b.c"), (3, f"{long}2"), (41, None), (None, "here")]
    got = evaluation.ungrounded(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(gold, "doc_id long, name string"), "doc_id")
    want = sorted((d, x) for d, text in docs for x in {x for x in names if x and x.strip()} if (d, x) not in gold and x not in (text or ""))
    assert sorted(map(tuple, got.collect())) == want and (1, f"{long}2") in want


def test_whole_tables_whatever_the_ids(spark, tmp_path):
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table("customer", [(1, "a", "m", 1, 0.0), (2500, "a", "m", 1, 0.0), (90000, "b", "m", 1, 0.0)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long, c_acctbal double")
    table("supplier", [(1, 5.0), (2, -5.0), (3, 5.0)], "s_suppkey long, s_acctbal double")
    table("lineitem", [(700, 1, 1, 9), (500, 2, 1, 8), (500, 1, 1, 7), (100, 1, 2, 6), (300, 1, 3, 5)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long")
    got = catalog.QUERIES["set_07_requested_valid"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 500, 1, 7), (3, 300, 1, 5)]
    got = catalog.QUERIES["evl_02_same_table"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2500), (2500, 1), (2500, 2500), (90000, 90000)]


def test_long_paths_are_no_cycles(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(0, 14)], "src int, dst int")
    n = spark.range(15).select(F.col("id").cast("int"))
    loop = e.union(spark.createDataFrame([(12, 10)], e.schema))
    assert graph.peeled(e).count() == 0 and {(r.src, r.dst) for r in graph.peeled(loop).collect()} == {(10, 11), (11, 12), (12, 10), (12, 13), (13, 14)}
    assert {r.id: r.layer for r in graph.layers(e, n).collect()} == {i: i for i in range(15)}
    with pytest.raises(ValueError):
        graph.layers(loop, n)


def test_places_over_range_parts(spark):
    values = [(i * 37 % 101, "x") for i in range(101)] + [(7, "y")] * 60 + [(None, "z")]
    rows = keyed.numbered(spark.createDataFrame(values, "v int, s string").repartition(5), "n", "v").collect()
    assert sorted(r.n for r in rows) == list(range(len(values)))
    assert [r.v for r in sorted(rows, key=lambda r: r.n)] == sorted((v for v, _ in values), key=lambda v: (v is not None, v or 0))
    assert keyed.numbered(spark.createDataFrame([], "v int"), "n", "v").count() == 0


def test_bootstrap_pairs_share_weights(spark):
    rows = spark.createDataFrame([(i, i % 5, 1, 1, i % 5, 1, 1) for i in range(300)], "id int, tp_a int, fp_a int, fn_a int, tp_b int, fp_b int, fn_b int")
    same = evaluation.paired_bootstrap(rows, seed=1, resamples=300).first()
    assert (same.difference, same.low, same.high, same.significant) == (0, 0, 0, False)
    better = evaluation.paired_bootstrap(rows.withColumn("tp_a", F.col("tp_a") + 1).withColumn("fn_a", F.lit(0)), seed=1, resamples=300).first()
    assert better.significant and better.low < better.difference < better.high and better.f1_a > better.f1_b


def test_bootstrap_interval_as_theory(spark):
    rows = spark.range(900).select("id", (F.col("id") % 10).alias("v")).union(spark.createDataFrame([(1000, None)], "id long, v long"))
    got = evaluation.bootstrap(rows, "v", seed=5).first()
    spread = 1.96 * (8.25 / 900) ** 0.5
    assert got["mean"] == 4.5 and abs(got.low - 4.5 + spread) < 0.03 and abs(got.high - 4.5 - spread) < 0.03
    again = evaluation.bootstrap(rows.repartition(7), "v", seed=5).first()
    assert abs(again.low - got.low) < 1e-9 and abs(again.high - got.high) < 1e-9


def test_cross_validation_leaves_the_fold_out(spark):
    rows = [(i, "good" if i % 2 else "bad", int(i % 2 == 1 or i % 10 == 0)) for i in range(100)]
    scores, accepted = evaluation.cross_validated(spark.createDataFrame(rows, "id int, tier string, ok int"), 5, "id", "tier", "ok", 0.9)
    s = scores.first()
    assert (s.accepted, s.right, s.precision, s.recall) == (50, 50, 1.0, round(50 / 60, 6)) and [tuple(r) for r in accepted.collect()] == [("good", 5)]


def test_closed_path_of_a_cycle(spark):
    path = lambda rows: [r.id for r in sorted(graph.closed_path(spark.createDataFrame(rows, "src int, dst int")).collect(), key=lambda r: r.place)]
    tail = [(50, 3), (4, 60), (60, 61)]
    assert path([(3, 9), (9, 4), (4, 3), *tail, (70, 71), (71, 70), (4, 70)]) == [3, 9, 4, 3]
    assert path([(i, (i + 7) % 20) for i in range(20)]) == [i * 7 % 20 for i in range(21)]
    assert path([(5, 5), (1, 5)]) == [5, 5]
    assert path([(1, 2), (2, 3), (1, 3)]) == [] and path([]) == []


def test_streams_resume_only_when_stopped():
    assert outbox.resumed(lambda: "started", "SUSPENDED", True) == "started"
    for state, resumable in (("RUNNING", True), ("STOPPED", False)):
        with pytest.raises(ValueError):
            outbox.resumed(lambda: "started", state, resumable)


def test_column_edges_of_statements(spark):
    rows = [(1, ["x", "y"], ["a"], [["s", "s", " "], []]), (2, None, ["a", "b", "c"], [["s"], ["u", "v"]]), (3, [], ["a"], [["s"], ["u"]]), (4, [" "], ["a"], [["s"]])]
    df = spark.createDataFrame(rows, "statement int, targets array<string>, catalog array<string>, sources array<array<string>>")
    assert {tuple(r) for r in sqllineage.column_edges(df).collect()} == {(1, "x", "s"), (2, "a", "s"), (2, "b", "u"), (2, "b", "v"), (3, "a", "s")}
    assert {tuple(r) for r in sqllineage.degraded(df).collect()} == {(1, True), (2, True), (3, True), (4, False)}


def test_kept_names(spark):
    cases = [
        ("db.t", "SELECT 1\nFROM DB.T", True), ("t", "from t import x\nfrom a import t", False), ("t", "import os\nselect * from t", True), ("t", "-- t\n# t", False),
        ("t", "x.createOrReplaceTempView('t')", False), ("t", "att t_1 1t", False), ("t", "/data/t/x", False), ("${x}", "${x}", False), ("a.*", "a.*", False), ("a.", "a.", False),
        ("t", "", False), (None, "t", False), ("t", None, False),
    ]
    rows = spark.createDataFrame([(i, n, x) for i, (n, x, _) in enumerate(cases)], "i int, name string, text string").select("i", s.kept_name(F.col("name"), F.col("text")).alias("kept"))
    assert {r.i: r.kept for r in rows.collect()} == {i: c[2] for i, c in enumerate(cases)}


def test_name_pools(spark):
    one = lambda names: spark.createDataFrame([(n,) for n in names], "n string")
    got = evaluation.name_pools(one([f"t{i % 700}" for i in range(1000)] + [None]), one(["t1", "made"])).collect()
    assert len(got) == len({r.name for r in got}) == 701 and sum(r.pool == "heldout" for r in got) == 701 // 6
    assert {r.name for r in got if r.synthetic} == {"t1", "made"}
    assert {r.pool for r in evaluation.name_pools(one(["a", "b"]), one([])).collect()} == {"heldout"}
    assert evaluation.name_pools(one([]), one([])).count() == 0
