"""Cuts by counts, exact keys beside nulls, engines, stores, fused checks, verified merges, framing and folds over streams."""

import glob
import hashlib
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from movelog.operators import annotate as A
from movelog.operators import checks as V
from movelog.operators import games as G
from movelog.operators import merge as M
from movelog.operators import parse as P
from movelog.operators import sampling as S
from movelog.operators import scoring as C
from movelog.operators import sequence as Q
from movelog.plans import fixtures, queries
from movelog.sources import archive
from movelog.streaming import ingest
from movelog.sources import shared
from movelog.streaming.fold import fold_stream

BIG = 2**53 + 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- top n


def test_cut_by_counts_is_the_window(spark):
    rng = random.Random(1)
    rows = [("hot", f"p{k}") for k in range(4000)] + [("small", f"q{k}") for k in range(30)] + [(None, f"r{k}") for k in range(1500)] + [("hot", None)] * 3 + [("hot", "p1")] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "bin string, player string").withColumn("extra", F.lit(1)).repartition(7)
    for n in (1, 29, 30, 31, 1001, 3999, 9999):
        order = lambda p: ("", "") if p is None else (hashlib.md5(f"s:{p}".encode()).hexdigest(), p)
        wanted = sorted((str(b), str(p)) for bin_ in ("hot", "small", None) for b, p in sorted(((b, p) for b, p in rows if b == bin_), key=lambda r: order(r[1]))[:n])
        found = S.cut_top_n(df, ["bin"], "player", n, "s:")
        assert found.columns == df.columns
        assert sorted((str(r.bin), str(r.player)) for r in found.collect()) == wanted
    assert S.cut_top_n(df.limit(0), ["bin"], "player", 5, "s:").count() == 0


def test_no_task_sorts_a_stratum(spark):
    df = spark.range(5000).selectExpr("cast(id % 3 AS string) AS bin", "cast(id AS string) AS player")
    assert "WindowGroupLimit" in plan(S.hash_top_n(df, ["bin"], "player", 1000, ""))
    cut = S.hash_top_n(df, ["bin"], "player", 1001, "")
    text = cut._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [row_number" in line]
    assert windows and all("__slice" in line.split("],")[1] for line in windows)  # ranks are by stratum and slice
    joins = [line for line in text.splitlines() if "Join " in line]
    assert joins and all("__slice" in line for line in joins)  # no row is dealt by its stratum alone


# ---------------------------------------------------------------- summaries


def test_moves_are_not_sorted_for_their_summary(spark):
    text = plan(G.games_meta(spark.createDataFrame([], "game_id string, date date, white string, black string, white_elo int, black_elo int, time_control string, termination string, result string, half_move int, clock double")))
    lines = text[text.index("Initial Plan") if "Initial Plan" in text else 0 :].splitlines()
    at = [k for k, line in enumerate(lines) if "SortAggregate" in line]
    first_hash = min(k for k, line in enumerate(lines) if "HashAggregate" in line)
    assert all(k < first_hash for k in at)  # sorting aggregates only above the hash aggregates, on games


def test_least_header_counts(spark):
    rows = [("g", "a", 1, 9.0), ("g", "b", 2, 2.0), ("h", None, 1, None)]
    df = spark.createDataFrame(rows, "game_id string, white string, half_move int, clock double").withColumns({c: F.lit("x") for c in G.GAME_COLUMNS if c != "white"})
    found = {r.game_id: (r.white, r.n_plies, r.plies_both_gt_thr) for r in G.games_meta(df).collect()}
    assert found == {"g": ("a", 2, 1), "h": (None, 1, 1)}


# ---------------------------------------------------------------- exact keys


def test_keys_above_2_53_beside_nulls(spark):
    df = spark.createDataFrame([(BIG, "a w", 1), (BIG + 1, "b w", 2), (None, "c w", 3)], "k long, fen_a string, half_move int").coalesce(1)
    length = lambda frame: frame["fen_a" if "fen_a" in frame else "state"].str.len()
    keys = {BIG, BIG + 1, None}
    assert {r.k for r in C.score_grid(df, ["k"], ["fen_a"], ["p"], length).collect()} == keys
    assert {(r.k, r.score) for r in C.score_where(df, F.lit(True), ["k"], ["fen_a"], length).collect()} == {(BIG, 3), (BIG + 1, 3), (None, None)}
    assert {r.k for r in C.dedup_score_scatter(df, ["k"], ["fen_a"], [], length).collect()} == keys
    within = C.dedup_score_scatter(df, ["k"], ["fen_a"], [], lambda frame: frame["k"].fillna(0).astype("int64"), within=["k"])
    assert {(r.k, r.score) for r in within.collect()} == {(BIG, BIG), (BIG + 1, BIG + 1), (None, 0)}
    assert {(r.k, r.eval_a) for r in C.evaluate_missing(df, ["k"], F.lit(True), length).collect() if r.k} == {(BIG, 3), (BIG + 1, 3)}
    folded = Q.ordered_fold(df.withColumn("g", F.lit("g")), ["g"], "half_move", "", lambda state, row: f"{state}/{row['k']}").orderBy("half_move").collect()
    assert [r.k for r in folded] == [BIG, BIG + 1, None] and folded[2].state_after == f"/{BIG}/{BIG + 1}/None"
    assert {r.k for r in Q.successor_state(df, "fen_a", "fen_a", lambda s, a: s).collect()} == keys
    engines = C.score_with_engines(df, ["k"], ["fen_a"], ["p"], lambda param: length)
    assert {(r.k, r.score) for r in engines.collect()} == {(k, 3) for k in keys}


def test_whatever_a_step_raises_is_that_rows_failure(spark):
    def step(state, action):
        return {"go": "there"}[action]

    df = spark.createDataFrame([("s", "go"), ("s", "stop"), ("s", None)], "state string, action string")
    found = {(r.action, r.state_after, r.failure) for r in Q.successor_state(df, "state", "action", step).collect()}
    assert found == {("go", "there", None), ("stop", None, "'stop'"), (None, None, None)}


# ---------------------------------------------------------------- engines and stores


class Counting:
    """An engine that leaves a file for each start, and fails on one input."""

    def __init__(self, folder, param):
        open(f"{folder}/{os.getpid()}-{param}-{len(glob.glob(f'{folder}/{os.getpid()}-{param}-*'))}", "w").close()
        self.param = param

    def __call__(self, frame):
        if (frame["x"] == 13).any():
            raise KeyError("unlucky")
        return frame["x"] * 10 + int(self.param[1:])


def test_an_engine_starts_once_for_each_worker_and_parameter(spark, tmp_path):
    folder, params = str(tmp_path), ["p1", "p2", "p3"]
    df = spark.range(400).selectExpr("id AS k", "id AS x")
    rows = C.score_with_engines(df, ["k"], ["x"], params, lambda param: Counting(folder, param), tasks_each=5).collect()
    assert len(rows) == 1200
    starts = [name.rsplit("-", 1)[0] for name in os.listdir(folder)]
    assert len(starts) == len(set(starts)) and {s.split("-")[1] for s in starts} == set(params)
    bad = [r for r in rows if r.failure]
    assert sorted((r.k, r.param, r.score) for r in bad) == [(13, p, None) for p in params] and all("unlucky" in r.failure for r in bad)
    assert all(r.score == r.k * 10 + int(r.param[1:]) for r in rows if not r.failure)
    assert C.score_with_engines(df.limit(0), ["k"], ["x"], params, lambda param: Counting(folder, param)).count() == 0


def test_inputs_that_failed_are_tried_apart_from_then_on(spark):
    calls, sound = [], []

    def scorer(frame):
        calls.append(len(frame))
        if not sound and frame["x"].isin([3, 50]).any():
            raise ValueError("unlucky")
        return frame["x"] * 2

    frame = pd.DataFrame({"k": range(1000, 2000), "x": [k % 100 for k in range(1000)]}, index=range(7, 1007))
    wanted = ([None if k % 100 in (3, 50) else k % 100 * 2 for k in range(1000)], ["unlucky" if k % 100 in (3, 50) else None for k in range(1000)])
    attempt = C.Attempts(["x"])
    assert attempt(scorer, frame) == wanted
    calls.clear()
    assert attempt(scorer, frame) == wanted and sorted(calls) == [1] * 20 + [980]
    sound.append(True)  # what failed once is no verdict
    assert attempt(scorer, frame)[1] == [None] * 1000
    lists = pd.DataFrame({"x": [[1], [2]]})  # cannot be hashed
    assert C.Attempts(["x"])(lambda f: f["x"].str.len(), lists) == ([1, 1], [None, None])


def test_a_value_that_has_only_failed_is_tried_apart_with_other_values_beside_it():
    calls = []

    def scorer(frame):
        calls.append(len(frame))
        if (frame["x"] == "bad").any():
            raise ValueError("unlucky")
        return frame["n"] * 2

    attempt = C.Attempts(["x", "n"])
    for at in range(0, 8_000, 2_000):  # n is never the same twice, so that no row's inputs have failed before
        frame = pd.DataFrame({"x": ["bad" if k % 100 == 7 else "good" for k in range(2_000)], "n": range(at, at + 2_000)})
        calls.clear()
        assert attempt(scorer, frame) == ([None if k % 100 == 7 else 2 * (at + k) for k in range(2_000)], ["unlucky" if k % 100 == 7 else None for k in range(2_000)])
        assert len(calls) < 250  # halving takes some 320
        if at:
            assert sorted(calls) == [1] * 20 + [1_980]
    calls.clear()
    frame = pd.DataFrame({"x": "good", "n": [7, 8, 107]})  # numbers that failed beside "bad" pass once, and are clear from then on
    assert attempt(scorer, frame) == ([14, 16, 214], [None] * 3) and attempt(scorer, frame)[0] == [14, 16, 214]
    assert calls[-1] == 3


def test_engine_tasks_grow_with_the_shuffle_partitions(spark):
    df = spark.range(9).selectExpr("id AS k", "id AS x")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert C.score_with_engines(df, ["k"], ["x"], ["a", "b"], lambda param: lambda frame: frame["x"]).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_task_has_one_parameter(spark):
    df = spark.range(90).selectExpr("id AS k", "id AS x")
    each = C.score_with_engines(df, ["k"], ["x"], ["a", "b", "c"], lambda param: lambda frame: frame["x"], tasks_each=3)
    seen = {(r.task, r.param) for r in each.withColumn("task", F.spark_partition_id()).collect()}
    assert len({t for t, _ in seen}) == len(seen) == 9


def test_store_scores_nothing_twice(spark, tmp_path):
    store = C.ScoreStore(spark, f"{tmp_path}/store", {"state": "string", "elo": "long"})
    calls = []
    work = spark.createDataFrame([("a", BIG), ("a", BIG), ("b", None), ("c", 1)], "state string, elo long")
    length = lambda frame: frame["state"].str.len() + frame["param"].str.len()
    assert store.runs() == calls and store.stored().count() == 0
    assert store.add(work, ["p", "qq"], length) == 6
    assert store.add(work, ["p", "qq"], length) == 0
    assert store.add(work.union(spark.createDataFrame([("d", None)], work.schema)), ["p", "qq"], length) == 2
    assert store.add(work, ["new"], length) == 3
    assert len(store.runs()) == 3
    # A run that dies before its name is in the manifest does not count.
    spark.createDataFrame([("a", BIG, 7, "p")], "state string, elo long, score long, param string").write.partitionBy("param").parquet(f"{tmp_path}/store/scores/dead")
    assert store.stored().count() == 11
    assert sorted((r.state, r.elo, r.param, r.score) for r in store.scattered(work.where("state = 'a'")).collect()) == [("a", BIG, "new", 4)] * 2 + [("a", BIG, "p", 2)] * 2 + [("a", BIG, "qq", 3)] * 2


# ---------------------------------------------------------------- checks


def test_fused_checks_take_one_aggregate_for_each_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "x"), ("b", 1, "x"), (None, 1, "?")], "g string, k int, v string")
    checks = V.Checks(df).nulls("nulls", "g").numeric("numbers", "v").allowed("values", "v", ["x", "y"]).unique("pairs", "g", "k").contiguous("gaps", ["g"], "k").constant("values of a group", ["g"], "v")
    found = {r.what: (r.n, sorted(r.samples)) for r in checks.report().collect()}
    assert {what: n for what, (n, _) in found.items()} == {"nulls": 1, "numbers": 5, "values": 1, "pairs": 1, "gaps": 2, "values of a group": 1}
    assert found["values"][1] == ['{"v":"?"}'] and found["pairs"][1] == ['{"g":"b","k":1,"value":2}']
    text = checks.report()._jdf.queryExecution().optimizedPlan().toString()
    keyed = [line for line in text.splitlines() if "Aggregate [g#" in line]
    assert len(keyed) == 2 and text.count("Aggregate [") == 5  # one for (g, k), one for g, and three over all their rows
    with pytest.raises(V.CheckFailed, match="gaps: 2.*"):
        V.strict_all(checks.report())
    V.strict_all(V.Checks(df.limit(0)).nulls("nulls", "g").unique("pairs", "g", "k").report())


def test_samples_are_few(spark):
    report = V.Checks(spark.range(5000)).row("all", F.lit(True), "id").report().first()
    assert report.n == 5000 and 1 <= len(report.samples) <= V.SAMPLES


# ---------------------------------------------------------------- merge


def keyed(spark, rows, columns):
    return spark.createDataFrame(rows, f"player string, game_id string, half_move int{columns}")


def test_doubled_keys_raise_and_are_listed(spark):
    main = keyed(spark, [("p", "g", 1, "m"), ("p", "g", 2, "n"), ("p", "g", 2, "again")], ", move string")
    good = keyed(spark, [("p", "g", 1, 5)], ", x int")
    doubled = keyed(spark, [("p", "g", 1, 6.0), ("p", "g", 1, 7.0), ("q", "g", 1, 8.0)], ", y double")
    merged = M.merge_side_tables(main, [good])
    assert merged.columns == ["player", "game_id", "half_move", "move", "x"] and sorted((r.move, r.x) for r in merged.collect()) == [("again", None), ("m", 5), ("n", None)]
    with pytest.raises(Exception, match="several rows of the key"):
        M.merge_side_tables(main, [good, doubled]).collect()
    faults = {(r.player, r.half_move, r.table, r.n_main, r.n_side) for r in M.merge_faults(main, [good, doubled]).collect()}
    assert faults == {("p", 2, 1, 2, 0), ("q", 1, 2, 0, 1), ("p", 1, 2, 1, 2), ("p", 2, 2, 2, 0)}
    with pytest.raises(ValueError, match="do not match"):
        M.verified_merge(main, [good], M.KEYS, F.lit(True))
    one = main.where("move != 'again'")
    table, missing = M.verified_merge(one, [one.select(*M.KEYS, F.lit(1).alias("x")), one.select(*M.KEYS, F.lit(None).cast("int").alias("z"))], M.KEYS, F.col("half_move") > 1)
    assert sorted((r.half_move, r.x, r.z) for r in table.collect()) == [(1, None, None), (2, 1, None)]
    assert {r.column_name: r.n_missing for r in missing.collect()} == {"x": 0, "z": 1}


def test_merge_shuffles_once_for_all_sides(spark):
    main = keyed(spark, [("p", "g", 1)], "")
    sides = [keyed(spark, [("p", "g", 1, k)], f", c{k} int") for k in range(3)]
    assert plan(M.merge_side_tables(main, sides)).count("Exchange hashpartitioning") == 1
    row = M.merge_side_tables(main, sides).first()
    assert (row.c0, row.c1, row.c2) == (0, 1, 2)


def test_merge_collects_no_rows_of_a_key(spark):
    main = keyed(spark, [("p", "g", 1, "m"), (None, "g", 2, "n")], ", move string")
    side = keyed(spark, [(None, "g", 2, 5), ("only here", "g", 1, 6)], ", x int")
    merged = M.merge_side_tables(main, [side])
    assert "ObjectHashAggregate" not in plan(merged) and "SortAggregate" not in plan(merged)
    assert sorted(((r.player, r.x) for r in merged.collect()), key=str) == [("p", None), (None, 5)]
    with pytest.raises(Exception, match="several rows of the key"):  # main does not have the key
        M.merge_side_tables(main, [side.union(side.where("player IS NOT NULL"))]).collect()


def test_tables_in_buckets_merge_where_they_lie(spark):
    rows = [(f"p{k % 5}", None if k % 9 == 0 else f"g{k % 9}", k, f"m{k}") for k in range(90)]
    main = shared.kept_by(keyed(spark, rows, ", move string"), "kept-rows", "game_id", 2)
    sides = [main.where("half_move % 2 = 1").select(*M.KEYS, F.concat("move", F.lit("!")).alias("one")), main.select(*M.KEYS, F.lit(2).alias("two"))]
    merged, faults = M.merge_side_tables(main, sides), M.merge_faults(main, sides)
    assert "Exchange" not in plan(merged) and "Exchange" not in plan(faults)
    assert {(r.player, r.game_id, r.half_move, r.move, r.one, r.two) for r in merged.collect()} == {(*r, f"{r[3]}!" if r[2] % 2 else None, 2) for r in rows}
    assert {(r.half_move, r.table, r.n_main, r.n_side) for r in faults.collect()} == {(k, 1, 1, 0) for k in range(0, 90, 2)}
    with pytest.raises(ValueError, match="do not match"):
        M.verified_merge(main, sides, M.KEYS, F.lit(True))


def test_verified_merge_moves_no_rows(spark):
    merged = queries.QUERIES["verified_merge"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(merged) and merged.count() == 12_000


def test_index_columns_by_bitmaps(spark):
    rows = [(k, (k * 7) % 50, k + 1, k % 49, str(49 - k), None if k == 3 else k, k + 0.5, 5) for k in range(50)]
    df = spark.createDataFrame(rows, "u_a int, u_b int, u_c long, u_d int, u_e string, u_f int, u_g double, v int")
    found = {r.column_name: r.is_index for r in M.index_columns(df, "u_").collect()}
    assert found == {"u_a": True, "u_b": True, "u_c": True, "u_d": False, "u_e": True, "u_f": False, "u_g": False}
    doubled = df.withColumn("u_d", F.when(F.col("u_a") == 7, 8).otherwise(F.col("u_a")))
    assert not {r.column_name: r.is_index for r in M.index_columns(doubled, "u_d").collect()}["u_d"]
    assert "Expand" not in plan(M.index_columns(df, "u_")) and M.drop_index_columns(df, "u_").columns == ["u_d", "u_f", "u_g", "v"]
    assert not any(r.is_index for r in M.index_columns(df.limit(0), "u_").collect())


# ---------------------------------------------------------------- archives


def by_lines(text):
    """The line rule: a game begins at each line that begins with the opening."""
    games = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.startswith(archive.OPENING):
            games.append([])
        if games:
            games[-1].append(line)
    return sorted("\n".join(g).rstrip(" \t\n") for g in games)


def test_framing_is_the_line_rule_for_any_split(spark, tmp_path):
    rng = random.Random(3)
    starts = ['by "someone"\n', 'value"]\nand more\n', "", "\n", '[Site "x"]\n', '"]\n']
    pieces = ['[Event "A"]\n[Site "x/1"]\n\n1. e4 1-0\n', '[Event "broken\n\n1. d4\n', ' [Event "indented"]\n', '[Event "B"]\r\n[Site "x"]\r\n\r\n1. c4\r\n', '{ [Event "inside"] }\n', '[Event "C"]\r[Site "y"]\r\r1. f4\r', '\n\n', "é[Event \n"]
    texts = [start + "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for start in starts for _ in range(4)]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.pgn").write_text(text, newline="")
    wanted = sorted(g for text in texts for g in by_lines(text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16b", "37b", "200b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert sorted(r.game for r in archive.read_games(spark, str(tmp_path)).collect()) == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_move_pattern_is_applied_once(spark):
    moves, counts = P.parse_games(spark.createDataFrame([('[Event "Blitz"]\n[Site "x/1"]\n\n1. e4 { [%clk 0:00:01] }',)], "game string"))
    for df in (moves, counts, P.judged(spark.createDataFrame([("x",)], "game string"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(r"[KQRBN]?[a-h]") == 1


def test_marks_in_a_text_do_no_harm(spark):
    text = f"1. e4 {{ a{P.PART}b [%clk 0:00:02] {P.END} }} 1... e5 {P.BEGIN} 2. d4"
    found = P.explode_moves(spark.createDataFrame([("g", text)], "game_id string, section string")).orderBy("half_move").collect()
    assert [(r.move_number, r.move, r.clock_text) for r in found] == [(1, "e4", "0:00:02"), (1, "e5", None), (2, "d4", None)]


def test_streams_keep_their_rejects(spark, tmp_path):
    block = '[Event "{}"]\n[Site "{}"]\n\n{}\n\n'
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination()
    (tmp_path / "in" / "a.pgn").write_text('by "someone"\n' + block.format("Blitz", "x/1", "1. e4") + block.format("Bullet", "x/2", "1. d4"))
    run()
    (tmp_path / "in" / "b.pgn").write_text(block.format("Blitz", "x/3", "1. c4") + block.format("Blitz", "", "1. f4"))
    run()
    run()
    assert {r.reason: r.n for r in ingest.outcomes(spark, f"{tmp_path}/out").collect()} == {"kept": 2, "not_eligible": 1, "no_id": 1}
    assert sorted(r.move for r in ingest.moves(spark, f"{tmp_path}/out").collect()) == ["c4", "e4"]
    assert sorted((r.reason, r.Site) for r in spark.read.parquet(f"{tmp_path}/out/rejects").collect()) == [("no_id", ""), ("not_eligible", "x/2")]


# ---------------------------------------------------------------- folds


def test_stream_fold_over_runs_with_late_and_abandoned_rows(spark, tmp_path):
    rows = [(g, k, None if k == 2 else BIG + k, f"m{k}") for g in ("a", None) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "g string, k int, n long, _m string")

    def run(part, patience=3_600_000):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = fold_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["g"], "k", "", lambda s, r: f"{s}/{r['_m']}:{r['n']}", patience=patience)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    assert run(df.where("k = 5 OR k = 2")).count() == 0
    assert run(df.where("k = 1")).count() == 4
    wanted = {(r.g, r.k, r.n, r.state_before, r.state_after) for r in Q.ordered_fold(df, ["g"], "k", "", lambda s, r: f"{s}/{r['_m']}:{r['n']}").collect()}
    done = run(df.where("k IN (3, 4)")).collect()
    assert {(r.g, r.k, r.n, r.state_before, r.state_after) for r in done} == wanted and not any(r.late for r in done)
    again = run(df.where("k = 3 AND g = 'a'")).where("late").collect()
    assert [(r.g, r.k, r.state_after) for r in again] == [("a", 3, None)]
    # A game that nothing comes for is given up when later rows of others arrive: what waits is folded over the gap.
    run(spark.createDataFrame([("z", 2, 1, "m2"), ("z", 4, 1, "m4")], df.schema), patience=1)
    left = run(spark.createDataFrame([("y", 1, 1, "m1")], df.schema), patience=1).where("g = 'z'").orderBy("k").collect()
    assert [(r.k, r.state_before, r.state_after) for r in left] == [(2, "", "/m2:1"), (4, "/m2:1", "/m2:1/m4:1")]


def test_games_of_a_bucket_are_folded_apart_and_share_a_state_value(spark, tmp_path):
    df = spark.range(600).selectExpr("id % 60 AS g", "CAST(id DIV 60 + 1 AS INT) AS k", "if(id % 7 = 0, NULL, id % 2 = 0) AS yes", "if(id % 5 = 0, NULL, timestamp_seconds(id)) AS t", "array(id) AS `a b`")
    for part in (df.where("k > 4 OR g = 3"), df.where("k <= 4 AND g != 3")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = fold_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["g"], "k", "", lambda s, r: f"{s}/{r['yes']}{r['k']}", buckets=2)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        query.awaitTermination()
        assert max(x["numRowsTotal"] for p in query.recentProgress for x in p["stateOperators"]) < 20  # and not one for each of 60 games
    wanted = Q.ordered_fold(df, ["g"], "k", "", lambda s, r: f"{s}/{r['yes']}{r['k']}")
    rows = lambda found: sorted(str(r) for r in found.select("g", "k", "yes", "t", "a b", "state_before", "state_after").collect())
    assert rows(spark.read.parquet(f"{tmp_path}/out").where("NOT late")) == rows(wanted)


def test_sql_fold_takes_every_step_once(spark):
    df = spark.createDataFrame([("g", k, f"m{k}") for k in range(1, 200)], "g string, k int, m string")
    rows = Q.sql_fold(df, ["g"], "k", "m", F.lit(0), lambda s, m: s + F.length(m)).orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.state_before == total
        total += len(r.m)
        assert r.state_after == total


def test_annotate(spark):
    rows = [("g", 1, "e4", 60.0), ("g", 2, "e5", 50.0), ("g", 3, "bad", 58.0), ("g", 4, "d5", None), ("h", 1, "d4", None)]
    df = spark.createDataFrame(rows, "game_id string, half_move int, move string, clock double")

    def rules(state, move):
        return {"e4": "e2e4", "e5": "e7e5", "d4": "d2d4"}[move], state + move

    found = {(r.game_id, r.half_move): (r.move_uci, r.fen_before, r.fen_after, r.clock_delta, r.failure) for r in A.annotate_moves(df, "s", rules).collect()}
    assert found == {("g", 1): ("e2e4", "s", "se4", 0.0, None), ("g", 2): ("e7e5", "se4", "se4e5", 0.0, None), ("g", 3): (None, None, None, 2.0, "'bad'"), ("g", 4): (None, None, None, 0.0, None), ("h", 1): ("d2d4", "s", "sd4", 0.0, None)}
    with pytest.raises(V.CheckFailed, match="games with gaps: 1"):
        A.annotate_moves(df.where("half_move != 2"), "s", rules)
    with pytest.raises(V.CheckFailed, match="doubled half-moves"):
        A.annotate_moves(df.union(df), "s", rules)
    assert A.annotate_moves(fixtures.moves(spark, "/root/testdata/sf0.001").limit(0), "s", rules).count() == 0


def test_shuffles_begin_with_partitions_by_the_rows_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    try:
        assert shared.dealt_by_size(spark.range(1_001)).count() == 1_001 and spark.conf.get(shared.INITIAL) == "11"
        shared.dealt_by_size(spark.range(5))
        assert spark.conf.get(shared.INITIAL) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(shared.INITIAL)


def test_masked_rows_are_scored_in_place(spark):
    """No shuffle brings the scores back, and a key that repeats stays one row each."""
    df = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (2, "bc", None), (3, None, BIG), (None, "d", 1)], "k long, x string, other long")
    rows = C.score_where(df, F.col("k") != 2, ["k"], ["x"], lambda frame: frame["x"].fillna("").str.len())
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([(1, "a", 7, 1), (1, "a", 7, 1), (2, "bc", None, None), (3, None, BIG, 0), (None, "d", 1, None)], key=repr)


def test_game_views_shuffle_moves_once(spark):
    """Moves go to their game's place; windows, summaries and joins by game find them there."""
    plan = fixtures.player_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(game_id" in plan and "hashpartitioning(l_orderkey" not in plan and plan.count("Exchange hashpartitioning") <= 4
