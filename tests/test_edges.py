"""Literal edge rows of the parsing and table rules."""

import pytest
from pyspark.sql import functions as F

from movelog.functions import text as T
from movelog.operators import checks as V
from movelog.operators import games as G
from movelog.operators import merge as M
from movelog.operators import parse as P
from movelog.operators import player_moves as PM
from movelog.operators import sampling as S
from movelog.operators import scoring as C
from movelog.operators import sequence as Q
from movelog.plans.dataset import SMALL, Dataset
from movelog.plans import fixtures
from movelog.sources import archive, shared, tables


def values(spark, f, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("t"))).collect())]


def test_clock(spark):
    assert values(spark, T.clock_seconds, ["0:10:00", "10:00", "a:b:c", None]) == [600, None, None, None]


def test_eval(spark):
    assert values(spark, T.parse_eval, ["0.18", "#3", "#-2", "#0", "abc", "#x"]) == [0.18, 100.0, -100.0, -100.0, None, None]
    assert values(spark, T.bad_mate, ["0.18", "#3", "#x", None]) == [False, False, True, False]


def test_elo(spark):
    assert values(spark, T.parse_elo, ["2186", "?", "", None, "99999999999999", " 1500", "1500\n"]) == [2186, 0, 0, 0, 0, 0, 0]


def test_id(spark):
    assert values(spark, T.id_from_url, ["https://games.example/JRgTjrR2/", " https://games.example/abc?x=1", "", None]) == ["JRgTjrR2", "abc", "", ""]


def test_increment(spark):
    assert values(spark, T.increment_seconds, ["180+2", "180", "180+", "180+x"]) == [2, None, None, None]


def test_bins(spark):
    assert values(spark, T.rating_bin, [1099.9, 1100.0, 2199.99, 2200.0, None], "double") == ["lt_1100", "1100_1200", "2100_2200", "gt_2200", None]
    with pytest.raises(ValueError):
        T.rating_bin(F.lit(1), 1100, 2150, 100)


def test_top1_keeps_the_first_of_equals(spark):
    row = spark.range(1).select(T.top1(F.create_map(F.lit("e2e4"), F.lit(0.4), F.lit("d2d4"), F.lit(0.4))).alias("x")).first()
    assert row.x == "e2e4"


def test_white_pov(spark):
    df = spark.createDataFrame([("x b", None, -1), ("x b", None, 1), ("x w", 30, None), ("x b", 30, None), ("x w", None, None)], "s string, cp int, mate int")
    assert [r[0] for r in df.select(T.white_pov(F.col("s"), F.col("cp"), F.col("mate"), 999)).collect()] == [999, -999, 30, -30, None]


def test_moves_are_numbered_by_place(spark):
    games = spark.createDataFrame([("a", "1. d4 d5 2. c4 e6"), ("b", "1. e8=Q+ { [%eval #3] } 1... O-O-O?? 2. Nbxd7#")], "game_id string, section string")
    rows = P.explode_moves(games).orderBy("game_id", "half_move").collect()
    assert [(r.game_id, r.half_move, r.move) for r in rows] == [("a", 1, "d4"), ("a", 2, "c4"), ("b", 1, "e8=Q+"), ("b", 2, "O-O-O"), ("b", 3, "Nbxd7#")]
    assert rows[2].eval_text == "#3" and rows[2].clock_text is None
    assert [r[0] for r in P.misnumbered(P.explode_moves(games)).collect()] == ["a"]


def test_reject_reasons(spark):
    block = '[Event "{}"]\n[Site "{}"]\n\n{}'
    games = [block.format("Rated Blitz", "x/1", "1. e4 0-1"), block.format("Rated Bullet", "x/2", "1. e4"), block.format("Blitz", "", "1. e4"), block.format("Blitz", "x/4", "none"), block.format("Blitz", "x/5", "1. e4 { [%clk 1:00] }"), "no tags", block.format("Blitz", "x/6", "1. e4 { [%eval #x] }")]
    moves, rejects = P.parse_games(spark.createDataFrame([(g,) for g in games], "game string"))
    assert {r.reason: r.n for r in rejects.collect()} == {"kept": 1, "not_eligible": 1, "no_id": 1, "no_moves": 1, "parse_failure": 2, "no_header": 1}
    assert [(r.game_id, r.move) for r in moves.collect()] == [("1", "e4")]


def moves_frame(spark, clocks):
    rows = [("g", None, "a", "b", 1500, 1600, "180+2", "Normal", "1-0", i, f"m{i}", c) for i, c in enumerate(clocks, 1)]
    return spark.createDataFrame(rows, "game_id string, date date, white string, black string, white_elo int, black_elo int, time_control string, termination string, result string, half_move int, move string, clock double")


def test_cutoff(spark):
    assert G.games_meta(moves_frame(spark, [None, None, None])).first().plies_both_gt_thr == 3
    assert G.games_meta(moves_frame(spark, [2.0, 9.0])).first().plies_both_gt_thr == 0
    assert G.games_meta(moves_frame(spark, [9.0, 9.0, 9.0, 3.0])).first().plies_both_gt_thr == 3


def test_clock_delta_of_gaps(spark):
    rows = Q.clock_delta(moves_frame(spark, [60.0, 60.0, 50.0, None, 45.0, 30.0])).orderBy("half_move").collect()
    assert [r.clock_delta for r in rows] == [0.0, 0.0, 10.0, 0.0, 5.0, 0.0]


def test_short_stratum_keeps_its_test_count(spark):
    df = spark.createDataFrame([("b", f"p{i}") for i in range(3)], "bin string, player string")
    rows = S.split_fixed_count(df, ["bin"], "player", S.Selection(final=5, test_share=0.2).test_players, "x").collect()
    assert sorted(r.split_by_player for r in rows) == ["test", "train", "train"]


def test_short_games(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False)], "game_id string, half_move int, is_used boolean")
    assert {r.game_id for r in V.check_min_segment(PM.used_length(rows), 2).collect()} == {"b"}
    assert not V.check_min_segment(PM.used_length(rows, legacy=True), 2).collect()


def test_strict_check_raises_with_samples(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(V.CheckFailed, match="n"):
        V.strict(V.check_unique(df, ["k"]), "keys")
    V.strict(V.check_unique(df.distinct(), ["k"]), "keys")


def test_first_side_table_wins(spark):
    main = spark.createDataFrame([("p", "g", 1, "m")], "player string, game_id string, half_move int, move string")
    one = spark.createDataFrame([("p", "g", 1, 1)], "player string, game_id string, half_move int, x int")
    two = spark.createDataFrame([("p", "g", 1, 2, "other")], "player string, game_id string, half_move int, x int, move string")
    row = M.merge_side_tables(main, [one, two]).first()
    assert (row.x, row.move) == (1, "m")
    assert M.overlaps(main, [one, two]) == [(1, "x"), (1, "move")]
    assert M.key_agreement(main, one).count() == 0


def test_embedding_gaps_count_as_unfilled(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None])], "k int, v array<double>")
    row = M.fill_stats(M.embeddings_long(df, ["k"], ["v"])).first()
    assert (row.n_rows, row.n_filled) == (4, 1)


def test_existing_evaluations_stay(spark):
    df = spark.createDataFrame([(1, "s w", "t b", 5)], "k int, fen_a string, fen_b string, eval_a int")
    row = C.evaluate_missing(df, ["k"], F.lit(True), lambda f: f["state"].str.len()).first()
    assert (row.eval_a, row.eval_b) == (5, 3)


def test_empty_tables(spark):
    moves = moves_frame(spark, [1.0]).limit(0)
    assert Dataset(moves, SMALL).player_games_out().count() == 0
    assert Q.count_positions(moves.withColumn("player", F.lit("p")).withColumn("player_color", F.lit("white")), 1).count() == 0


def test_archive_round_trip(spark):
    raw = fixtures.raw_moves(spark, "/root/testdata/sf0.001")
    path = shared.shared_folder(spark, "round-trip")
    archive.write_archive(archive.archive_text(raw), path)
    moves, _ = P.parse_games(archive.read_games(spark, path, 4), "rated")
    want = raw.select(F.substring("game_id", 2, 20).alias("game_id"), "half_move", "move", F.col("clock").cast("int").alias("clock"))
    got = moves.select("game_id", "half_move", "move", "clock")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_odd_archives(spark, tmp_path):
    text = 'a comment\n[Site "before any game"]\n[Event "Blitz A"]\n[Site "x/1"]\n\n1. e4 1-0\n[Event "Blitz B"]\r\n[Site "x/2"]\r\n\r\n1. d4 { [Event "inside"] } d5\r\n\r\n\r\n[Event ""]\n\n1. c4\n'
    (tmp_path / "a.pgn").write_text(text, newline="")
    (tmp_path / "b.pgn").write_text('[Event " C"]\n[Site "x/3"]\n\n1. f4\n')
    (tmp_path / "c.pgn").write_text("no game\n")
    want = ['[Event " C"]\n[Site "x/3"]\n\n1. f4', '[Event ""]\n\n1. c4', '[Event "Blitz A"]\n[Site "x/1"]\n\n1. e4 1-0', '[Event "Blitz B"]\n[Site "x/2"]\n\n1. d4 { [Event "inside"] } d5']
    assert sorted(r.game for r in archive.read_games(spark, str(tmp_path)).collect()) == sorted(want)


def test_move_section_ends_before_another_tag(spark):
    texts = ["t\n\n1. e4 1-0", "t\n\n1. e4\n\n[Event x", "t\n\n1. e4\n\n2. d4 0-1\n", "no blank line"]
    assert values(spark, P.move_section, texts) == ["1. e4", "1. e4", "1. e4\n\n2. d4", ""]


def test_fold_streams_over_batches(spark):
    rows = [(g, k, f"m{k}") for g in (None, "a", "b") for k in range(1, 41)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = Q.ordered_fold(spark.createDataFrame(rows, "g string, k long, m string"), ["g"], "k", 0, lambda s, r: s + r["k"], "long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 120 and all(r.state_after == r.k * (r.k + 1) // 2 and r.state_before == r.state_after - r.k for r in found)


def test_input_checks_of_player_moves(spark):
    games = spark.createDataFrame([("p", "g", "White", 3, 1500, 1500, "180+2")], "player string, game_id string, player_color string, plies_both_gt_thr int, player_elo int, opponent_elo int, time_control string")
    moves = spark.createDataFrame([("g", 1, "e4", "u", "a", "b", 1.0, 0.0)], "game_id string, half_move int, move string, move_uci string, fen_before string, fen_after string, clock double, clock_delta double")
    games, moves = games.withColumns({c: F.lit("x") for c in ("rating_bin", "split_by_player", "split_by_games")}), moves
    assert [r.n for r in PM.input_checks(games, moves).collect()] == [0] * 8
    wrong = {
        "colours": (games.withColumn("player_color", F.lit("green")), moves),
        "a game with two rows of a colour": (games.union(games.withColumn("player", F.lit("q"))), moves),
        "a game with two rows of a player": (games.union(games.withColumn("player_color", F.lit("black"))), moves),
        "a half-move with two rows": (games, moves.union(moves)),
        "numbers of player games": (games.withColumn("player_elo", F.lit("x")), moves),
        "numbers of moves": (games, moves.withColumn("clock", F.lit("x"))),
        "nulls in moves": (games, moves.withColumn("fen_after", F.lit(None).cast("string"))),
        "time controls without an increment": (games.withColumn("time_control", F.lit("180")), moves),
    }
    for what, (g, m) in wrong.items():
        assert [r.what for r in PM.input_checks(g, m).where("n > 0").collect()] == [what]
        with pytest.raises(V.CheckFailed, match=what):
            PM.build_player_moves(g, m, 1, 5, 2)


def test_dataset_properties(spark):
    data = Dataset(fixtures.moves(spark, "/root/testdata/sf0.001"), SMALL)
    rows, players = data.player_games_out().collect(), data.players().collect()
    assert len(rows) == 26 and len({r.rating_bin for r in players}) == 13
    names = {r.player for r in players}
    assert not [r for r in rows if r.opponent in names]
    assert sum(r.split_by_player == "test" for r in players) == 13


def test_same_sample_for_any_partitioning(spark):
    def sample(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted((r.player, r.game_id) for r in Dataset(fixtures.moves(spark, "/root/testdata/sf0.001"), SMALL).player_games_out().collect())

    try:
        assert sample("1") == sample("64")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plans(spark):
    data = Dataset(fixtures.moves(spark, "/root/testdata/sf0.001"))
    plan = data.preselected._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    meta = G.games_meta(fixtures.moves(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in meta and "l_comment" not in meta


def test_csv_round_trip(spark):
    moves = moves_frame(spark, [9.0, 8.0])
    path = shared.shared_folder(spark, "csv")
    tables.write_moves(moves, path)
    assert [r.move for r in tables.read_moves(spark, path, tables.RAW_MOVES.replace(" Eval double,", "").replace("Clock int", "Clock double"), {"HalfMove": "half_move", "Move": "move"}).orderBy("half_move").collect()] == ["m1", "m2"]
