"""The registered queries of the game-log operators, each beside its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import annotate as A
from ..operators import checks as V
from ..operators import games as G
from ..operators import merge as M
from ..operators import parse as P
from ..operators import player_moves as PM
from ..operators import sampling as S
from ..operators import scoring as C
from ..operators import sequence as Q
from ..sources import archive, shared, tables
from ..streaming import fold, ingest
from . import features
from . import fixtures as X
from .dataset import Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its oracle over the fixture views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = X.sql(sql)
        return f

    return add


def stand_in(*columns: str):
    """A scorer that DuckDB can repeat: the md5 of the joined inputs, from -1000 to 1000."""

    def scorer(frame: pd.DataFrame) -> pd.Series:
        import hashlib

        joined = map(":".join, zip(*[map(str, frame[c].tolist()) for c in columns], strict=True))
        return pd.Series([int.from_bytes(hashlib.md5(x.encode()).digest()[:4]) % 2001 - 1000 for x in joined], frame.index, "int64")

    return scorer


def scored(text: str) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % 2001 - 1000)"


# ------------------------------------------------------------ sources and parsing


def archive_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_text(X.raw_moves(spark, sf_dir))


ONE_GAME = "(SELECT game_id, min(event) event, min(site) site, min(date) date, min(white) white, min(black) black, min(white_elo) white_elo, min(black_elo) black_elo, min(time_control) time_control, min(termination) termination, min(result) result FROM raw_moves GROUP BY game_id)"
SITE_ID = "split_part(rtrim(site, '/'), '/', 4)"
CLOCK = "concat('[%clk 0:00:', lpad(CAST(CAST(clock AS INT) AS STRING), 2, '0'), ']')"


@query(f"""SELECT site, CAST(length(game) AS INT) AS n_chars, md5(game) AS game_md5 FROM (
SELECT min(site) AS site, concat('[Event "', min(event), '"]\n[Site "', min(site), '"]\n[Date "', strftime(min(date), '%Y.%m.%d'), '"]\n[White "', min(white), '"]\n[Black "', min(black), '"]\n[WhiteElo "', min(white_elo), '"]\n[BlackElo "', min(black_elo), '"]\n[TimeControl "', min(time_control), '"]\n[Termination "', min(termination), '"]\n[Result "', min(result), '"]\n\n',
 string_agg(concat(CAST((half_move + 1) // 2 AS STRING), CASE WHEN half_move % 2 = 1 THEN '.' ELSE '...' END, ' ', move, ' {{ ', concat_ws(' ', concat('[%eval ', eval_text, ']'), CASE WHEN clock IS NOT NULL THEN {CLOCK} END), ' }}'), ' ' ORDER BY half_move), ' ', min(result)) AS game
FROM raw_moves GROUP BY game_id)""")
def frame_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_folder(spark, "archive")
    archive.write_archive(archive_games(spark, sf_dir), path)
    games = archive.read_games(spark, path)
    return games.select(P.tag(F.col("game"), "Site").alias("site"), F.length("game").alias("n_chars"), F.md5("game").alias("game_md5"))


@query("SELECT game_id, CAST(date AS STRING) AS date, white, black, white_elo, black_elo, time_control, termination, result, half_move, move, clock FROM moves")
def read_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_folder(spark, "moves-csv")
    tables.write_moves(X.moves(spark, sf_dir), path)
    schema = "GameId string, Date string, White string, Black string, WhiteElo int, BlackElo int, TimeControl string, Termination string, GameResult string, HalfMove int, Move string, Clock double"
    return tables.read_moves(spark, path, schema, {k: v for k, v in tables.RAW_NAMES.items() if k != "Eval"})


@query("SELECT o_orderkey AS game, o_custkey AS owner FROM orders")
def select_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.select_renamed(X.table(spark, sf_dir, "orders"), {"o_orderkey": "game", "o_custkey": "owner"})


META = "SELECT game_id, date, white, black, white_elo, black_elo, time_control, termination, result, n_plies, first_white_leq_thr_ply, first_black_leq_thr_ply, plies_both_gt_thr FROM games_meta"


@query(META)
def games_meta_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_folder(spark, "games-meta")
    shared.cached(spark, path, lambda: X.meta(spark, sf_dir))
    return shared.cached(spark, path, lambda: X.meta(spark, sf_dir))


@query("SELECT game_id, half_move, move, CAST(eval_number AS DOUBLE) AS eval, clock FROM (SELECT CAST(o AS STRING) AS game_id, half_move, move, CASE WHEN eval_text = '#-2' THEN -100.0 ELSE CAST(eval_text AS DOUBLE) END AS eval_number, CAST(clock AS INT) AS clock FROM (SELECT *, substr(game_id, 2) AS o FROM raw_moves) WHERE event = 'Rated BLITZ game')")
def stream_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out, marks = (shared.shared_folder(spark, f"stream-{x}") for x in ("in", "out", "marks"))
    archive.write_archive(archive_games(spark, sf_dir), source)
    ingest.ingest(spark, source, out, marks).awaitTermination()
    return ingest.moves(spark, out).select("game_id", "half_move", "move", "eval", "clock")


SPOILT = "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event = 'Rated Bullet game' THEN 'not_eligible' WHEN k % 13 = 0 THEN 'parse_failure' WHEN k % 17 = 0 THEN 'no_id' ELSE 'kept' END AS reason FROM (SELECT DISTINCT game_id, event, CAST(substr(game_id, 2) AS BIGINT) AS k FROM raw_moves)) GROUP BY reason"


def spoilt_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive games, some of them spoilt on purpose: a bad clock, or no id."""
    k = F.substring("game_id", 2, 20).cast("long")
    spoilt = F.when(k % 13 == 0, F.regexp_replace("game", r"\n\n1\. (\w+) ", "\n\n1. $1 { [%clk x] } 1... a1 ")).when(k % 17 == 0, F.regexp_replace("game", r'\[Site "[^"]*"\]', '[Site ""]')).otherwise(F.col("game"))
    return archive_games(spark, sf_dir).select(spoilt.alias("game"))


@query(SPOILT)
def stream_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes that the stream itself has counted, batch by batch."""
    source, out, marks = (shared.shared_folder(spark, f"stream-{x}") for x in ("in", "out", "marks"))
    archive.write_archive(spoilt_games(spark, sf_dir), source)
    ingest.ingest(spark, source, out, marks).awaitTermination()
    return ingest.outcomes(spark, out)


@query(f"SELECT game_id, event AS \"Event\", site AS \"Site\", strftime(date, '%Y.%m.%d') AS \"Date\", white AS \"White\", black AS \"Black\", CAST(white_elo AS STRING) AS \"WhiteElo\", CAST(black_elo AS STRING) AS \"BlackElo\", time_control AS \"TimeControl\", termination AS \"Termination\", result AS \"Result\" FROM {ONE_GAME}")
def extract_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_tags(archive_games(spark, sf_dir)).drop("game")


@query(f"SELECT game_id FROM {ONE_GAME} WHERE lower(event) LIKE '%blitz%'")
def filter_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_event(archive_games(spark, sf_dir)).select("game_id")


@query(f"SELECT site, {SITE_ID} AS id FROM (SELECT DISTINCT game_id, split_part(site, '?', 1) AS bare, site FROM raw_moves) WHERE site NOT LIKE '%?%' UNION ALL SELECT site, split_part({SITE_ID}, '?', 1) FROM (SELECT DISTINCT game_id, site FROM raw_moves) WHERE site LIKE '%?%'")
def id_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = X.raw_moves(spark, sf_dir).select("game_id", "site").distinct()
    return sites.select("site", T.id_from_url(F.col("site")).alias("id"))


ODD = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '?' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN CAST(o_custkey AS STRING) ELSE concat('-', o_custkey) END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN CAST(o_custkey AS INT) ELSE 0 END AS elo FROM orders")
def parse_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(ODD)
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.parse_elo(text).alias("elo"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 5 * 3600 + o_orderkey % 60 * 60 + o_custkey % 60 AS INT) END AS seconds FROM orders")
def clock_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat(o_custkey % 60, ':00') ELSE concat(o_custkey % 5, ':', lpad(o_orderkey % 60, 2, '0'), ':', lpad(o_custkey % 60, 2, '0')) END")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.clock_seconds(text).alias("seconds"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 7 - 3 > 0 THEN 100.0::DOUBLE ELSE (-100.0)::DOUBLE END WHEN o_orderkey % 3 = 1 THEN (o_custkey + 0.25)::DOUBLE END AS eval FROM orders")
def parse_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('#', o_custkey % 7 - 3) WHEN o_orderkey % 3 = 1 THEN concat(o_custkey, '.25') ELSE 'abc' END")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.parse_eval(text).alias("eval"))


@query("SELECT game_id, md5(string_agg(concat(CAST((half_move + 1) // 2 AS STRING), CASE WHEN half_move % 2 = 1 THEN '.' ELSE '...' END, ' ', move, ' { ', concat_ws(' ', concat('[%eval ', eval_text, ']'), CASE WHEN clock IS NOT NULL THEN concat('[%clk 0:00:', lpad(CAST(CAST(clock AS INT) AS STRING), 2, '0'), ']') END), ' }'), ' ' ORDER BY half_move)) AS section_md5 FROM raw_moves GROUP BY game_id")
def move_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_games(spark, sf_dir).select("game_id", F.md5(P.move_section(F.col("game"))).alias("section_md5"))


@query("SELECT game_id, half_move, CAST((half_move + 1) // 2 AS INT) AS move_number, move, eval_text, CASE WHEN clock IS NOT NULL THEN concat('0:00:', lpad(CAST(CAST(clock AS INT) AS STRING), 2, '0')) END AS clock_text FROM raw_moves")
def explode_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = archive_games(spark, sf_dir).select("game_id", P.move_section(F.col("game")).alias("section"))
    return P.explode_moves(games)


@query(SPOILT)
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_games(spoilt_games(spark, sf_dir))[1]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 9 AS INT) END AS increment FROM orders")
def increment_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN concat('180+', o_custkey % 9) WHEN 1 THEN '180' WHEN 2 THEN '180+' ELSE '180+x' END")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.increment_seconds(text).alias("increment"))


@query("SELECT game_id, half_move, half_move % 3 != 0 AS is_uci, lower(text) AS lowered FROM (SELECT *, CASE CAST(half_move % 3 AS INT) WHEN 0 THEN move WHEN 1 THEN upper(concat(move, move)) ELSE concat(move, move, 'q') END AS text FROM moves)")
def looks_like_uci(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("half_move") % 3 == 0, F.col("move")).when(F.col("half_move") % 3 == 1, F.upper(F.concat("move", "move"))).otherwise(F.concat("move", "move", F.lit("q")))
    return X.moves(spark, sf_dir).select("game_id", "half_move", T.looks_like_uci(text).alias("is_uci"), F.lower(text).alias("lowered"))


@query("SELECT game_id, half_move, fen_a IS NULL OR lower(trim(fen_a)) IN ('', 'none', 'nan') AS a_missing, fen_b IS NULL OR trim(fen_b) = '' AS b_missing FROM states")
def is_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.states(spark, sf_dir).select("game_id", "half_move", T.is_missing(F.col("fen_a")).alias("a_missing"), T.is_missing(F.col("fen_b"), ()).alias("b_missing"))


@query("SELECT game_id, half_move, CASE WHEN half_move % 4 IN (0, 2) THEN 'white' WHEN half_move % 4 = 1 THEN 'black' END AS color FROM moves")
def normalize_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE CAST(half_move % 4 AS INT) WHEN 0 THEN 'W' WHEN 1 THEN ' Black' WHEN 2 THEN 'white' ELSE 'green' END")
    return X.moves(spark, sf_dir).select("game_id", "half_move", T.normalize_color(text).alias("color"))


# ------------------------------------------------------------ games, filters, selection


@query("SELECT game_id, half_move, clock FROM (SELECT CASE WHEN half_move % 7 = 0 THEN NULL ELSE game_id END AS game_id, half_move, clock FROM moves) WHERE game_id IS NOT NULL")
def base_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.moves(spark, sf_dir).withColumn("game_id", F.when(F.col("half_move") % 7 != 0, F.col("game_id")))
    return G.base_moves(rows).select("game_id", "half_move", "clock")


@query("SELECT game_id, half_move, date FROM moves WHERE strftime(date, '%Y-%m') = '1995-03'")
def filter_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_month(X.moves(spark, sf_dir), "1995-03").select("game_id", "half_move", "date")


@query("SELECT game_id, half_move, time_control FROM moves WHERE time_control = '180+2'")
def filter_time_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_time_control(X.moves(spark, sf_dir), "180+2").select("game_id", "half_move", "time_control")


@query(META)
def games_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.meta(spark, sf_dir)


@query("SELECT * FROM player_games")
def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.player_games(spark, sf_dir)


@query("SELECT * FROM month_stats")
def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.player_stats(X.player_games(spark, sf_dir), 10)


@query("SELECT player, avg_bin FROM binned")
def rating_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.binned(G.player_stats(X.player_games(spark, sf_dir), 10)).select("player", "avg_bin")


def build(spark: SparkSession, sf_dir: str) -> Dataset:
    """The dataset on a game summary that is written once, as all steps read it."""
    path = shared.shared_folder(spark, "games-meta")
    return Dataset(X.moves(spark, sf_dir), meta=shared.cached(spark, path, lambda: X.meta(spark, sf_dir)))


@query("SELECT * FROM preselected")
def preselect_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).preselected


def top_lines(n: int) -> str:
    return f"SELECT flag, line FROM (SELECT flag, line, row_number() OVER (PARTITION BY flag ORDER BY md5(concat('large:', line)), line) AS place FROM (SELECT l_returnflag AS flag, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS line FROM lineitem)) WHERE place <= {n}"


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in three strata of unequal size."""
    return X.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("line"))


@query(top_lines(1001))
def top_n_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_top_n(line_keys(spark, sf_dir), ["flag"], "line", 1001, "large:")


@query(top_lines(5000))
def top_n_of_large_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_top_n(line_keys(spark, sf_dir), ["flag"], "line", 5000, "large:")


@query("SELECT * FROM eligible")
def eligible_player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).eligible


@query("SELECT * FROM enough")
def enough_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.enough_games(build(spark, sf_dir).eligible, 3)


@query("SELECT * FROM candidates")
def candidate_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build(spark, sf_dir)
    return S.candidate_players(d.eligible, d.params.selection)


@query("SELECT e.game_id, e.player FROM eligible e SEMI JOIN candidates c ON c.avg_bin = e.avg_bin AND c.player = e.player")
def restrict_to_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build(spark, sf_dir)
    return G.restrict_to_players(d.eligible, S.candidate_players(d.eligible, d.params.selection)).select("game_id", "player")


@query("SELECT game_id, player, opponent FROM deduped")
def drop_vs_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build(spark, sf_dir)
    pool = S.candidate_players(d.eligible, d.params.selection)
    return G.drop_vs_selected(G.restrict_to_players(d.eligible, pool), pool).select("game_id", "player", "opponent")


@query("SELECT avg_bin, player, avg_elo, n_games, n_eligible FROM final")
def final_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).final.drop("split_by_player")


@query("SELECT avg_bin, player, split_by_player FROM final")
def split_by_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).final.select("avg_bin", "player", "split_by_player")


@query("SELECT * FROM final_one")
def select_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build(spark, sf_dir)
    return S.select_players(d.eligible, S.Selection(drop_vs_selected=False))[0]


@query("SELECT p.game_id, p.player, f.split_by_player FROM pool p JOIN final f USING (avg_bin, player)")
def select_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build(spark, sf_dir)
    return d.pool.join(d.final.select("avg_bin", "player", "split_by_player"), ["avg_bin", "player"]).select("game_id", "player", "split_by_player")


@query("SELECT game_id FROM game_split")
def selected_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.selected_games(build(spark, sf_dir).pool)


@query("SELECT game_id, split_by_games FROM game_split")
def split_by_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).game_split


@query("SELECT p.game_id, p.player, f.split_by_player, s.split_by_games, f.n_eligible FROM pool p JOIN final f USING (avg_bin, player) JOIN game_split s USING (game_id)")
def attach_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = build(spark, sf_dir)
    return S.attach_splits(d.pool, d.final, d.game_split).select("game_id", "player", "split_by_player", "split_by_games", "n_eligible")


@query("SELECT game_id, player FROM sampled")
def sample_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).sampled.select("game_id", "player")


@query("SELECT avg_bin AS rating_bin, player, split_by_player, avg_elo, n_games AS n_games_month, n_eligible AS n_eligible_games FROM final")
def dataset_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).players()


@query("SELECT CASE WHEN max(CASE WHEN s.split_by_player = 'test' THEN 1 ELSE 0 END) = 1 THEN 'test' ELSE 'train' END AS split_by_player, min(s.split_by_games) AS split_by_games, g.game_id, g.date, g.white, g.black, g.white_elo, g.black_elo, g.time_control, g.termination, g.result, g.n_plies, g.plies_both_gt_thr FROM games_meta g JOIN sampled s USING (game_id) GROUP BY ALL")
def dataset_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_folder(spark, "dataset")
    games = build(spark, sf_dir).games()
    tables.write_dataset({"games": games}, path)
    return spark.read.schema(games.schema).parquet(f"{path}/games")


@query("SELECT m.* FROM moves m JOIN games_meta g USING (game_id) WHERE m.game_id IN (SELECT game_id FROM sampled) AND m.half_move <= g.plies_both_gt_thr")
def dataset_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_folder(spark, "dataset")
    moves = build(spark, sf_dir).moves_out()
    tables.write_dataset({"moves": moves}, path)
    return spark.read.schema(moves.schema).parquet(f"{path}/moves")


@query("SELECT split_by_player, split_by_games, avg_bin AS rating_bin, player, opponent, player_color, game_id, player_elo, opponent_elo, avg_elo, date, time_control, termination, result, n_plies, plies_both_gt_thr FROM sampled")
def dataset_player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir).player_games_out()


COUNTED = ("players", "games", "moves", "player_games")


@query("""SELECT 'players' AS table_name, count(*) AS n FROM final UNION ALL SELECT 'games', count(DISTINCT game_id) FROM sampled UNION ALL SELECT 'player_games', count(*) FROM sampled
UNION ALL SELECT 'moves', count(*) FROM moves m JOIN games_meta g USING (game_id) WHERE m.game_id IN (SELECT game_id FROM sampled) AND m.half_move <= g.plies_both_gt_thr""")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build writes all four tables."""
    path = shared.shared_folder(spark, "dataset")
    found = build(spark, sf_dir).tables()
    tables.write_dataset(found, path)
    counts = [spark.read.schema(found[name].schema).parquet(f"{path}/{name}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name in COUNTED]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


# ------------------------------------------------------------ sequences and player moves


@query("SELECT game_id, half_move, clock, clock_delta FROM annotated")
def clock_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.clock_delta(X.moves(spark, sf_dir)).select("game_id", "half_move", "clock", "clock_delta")


PLACED = "(SELECT *, row_number() OVER (PARTITION BY player, game_id ORDER BY half_move) - 1 AS place, 1 + CASE WHEN player_color = 'white' THEN 0 ELSE 1 END AS start FROM player_rows)"
WINDOWED = f"(SELECT * FROM {PLACED} WHERE place >= start AND (place - start) % 2 = 0)"


@query(f"SELECT player, game_id, half_move, move FROM {WINDOWED}")
def eval_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.eval_window(X.player_rows(spark, sf_dir), 1).select("player", "game_id", "half_move", "move")


@query(f"SELECT p.player, p.game_id, count(w.half_move) AS n_positions FROM player_rows p LEFT JOIN {WINDOWED} w USING (player, game_id, half_move) GROUP BY ALL")
def count_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count_positions(X.player_rows(spark, sf_dir), 1)


BEFORE = "(SELECT player, game_id, half_move, string_agg(move, ' ') OVER w AS before, string_agg(CAST(CAST(clock_delta AS INT) AS STRING), ' ') OVER c AS seconds FROM player_rows WINDOW w AS (PARTITION BY player, game_id ORDER BY half_move ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY player, game_id ORDER BY half_move ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query(f"SELECT w.player, w.game_id, w.half_move, coalesce(b.before, '') AS moves_before FROM {WINDOWED} w JOIN {BEFORE} b USING (player, game_id, half_move)")
def move_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.prefixes(X.player_rows(spark, sf_dir), {"move": "before"}, 1)
    return rows.select("player", "game_id", "half_move", F.array_join("before", " ").alias("moves_before"))


@query(f"SELECT w.player, w.game_id, w.half_move, trim(concat(coalesce(b.before, ''), ' ', 'x', w.move)) AS moves_with, b.seconds FROM {WINDOWED} w JOIN {BEFORE} b USING (player, game_id, half_move)")
def prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.player_rows(spark, sf_dir).withColumn("seconds", T.seconds_or_zero(F.col("clock_delta"))).withColumn("other", F.concat(F.lit("x"), "move"))
    found = Q.prefix_with_candidate(Q.prefixes(rows, {"move": "before", "seconds": "times"}, 1, current=("seconds",)), "before", "other", "tried")
    return found.select("player", "game_id", "half_move", F.array_join("tried", " ").alias("moves_with"), F.array_join("times", " ").alias("seconds"))


FOLD = "SELECT game_id, half_move, move, concat_ws('/', 'start', string_agg(move, '/') OVER (PARTITION BY game_id ORDER BY half_move ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS state_before, concat('start/', string_agg(move, '/') OVER (PARTITION BY game_id ORDER BY half_move ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS state_after FROM moves"


@query(FOLD)
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ordered_fold(X.moves(spark, sf_dir).select("game_id", "half_move", "move"), ["game_id"], "half_move", "start", lambda state, row: f"{state}/{row['move']}")


@query(FOLD)
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stateful stream: the moves come in files that mix their order, and two runs share them."""
    source, out, marks = (shared.shared_folder(spark, f"fold-{x}") for x in ("in", "out", "marks"))
    moves = X.moves(spark, sf_dir).select("game_id", "half_move", "move")
    early = F.md5(F.concat("game_id", F.col("half_move").cast("string"))) < "8"
    for part in (early, ~early):
        moves.where(part).write.mode("append").parquet(source)
        rows = fold.fold_stream(spark.readStream.schema(moves.schema).parquet(source), ["game_id"], "half_move", "start", lambda state, row: f"{state}/{row['move']}")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).where("NOT late").drop("late")


@query(FOLD)
def ordered_fold_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sql_fold(X.moves(spark, sf_dir), ["game_id"], "half_move", "move", F.lit("start"), lambda state, move: F.concat(state, F.lit("/"), move))


def play(state: str, move: str) -> str:
    """The stand-in for a rules library: no piece may go to the first rank."""
    if move.endswith("1"):
        raise ValueError("not allowed")
    return f"{state}/{move}"


@query("SELECT game_id, half_move, CASE WHEN move NOT LIKE '%1' THEN concat(fen_before, '/', move) END AS state_after, CASE WHEN move LIKE '%1' THEN 'not allowed' END AS failure FROM annotated")
def successor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.annotated(spark, sf_dir).select("game_id", "half_move", "move", "fen_before")
    return Q.successor_state(rows, "fen_before", "move", play).select("game_id", "half_move", "state_after", "failure")


def rules(state: str, move: str) -> tuple[str, str]:
    """The stand-in for a rules library that also spells moves out: no piece may go to the eighth rank as long as the start is near."""
    if move.endswith("8") and state.count("/") < 2:
        raise ValueError("not allowed")
    return move + move, f"{state}/{move}"


REFUSED = "(SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY half_move) AS place FROM annotated)"


@query(f"""SELECT m.game_id, m.half_move, CASE WHEN r.place IS NULL OR m.place < r.place THEN m.move_uci END AS move_uci, CASE WHEN r.place IS NULL OR m.place < r.place THEN f.state_before END AS fen_before,
 CASE WHEN r.place IS NULL OR m.place < r.place THEN f.state_after END AS fen_after, m.clock_delta, CASE WHEN m.place = r.place THEN 'not allowed' END AS failure
FROM {REFUSED} m JOIN ({FOLD}) f USING (game_id, half_move) LEFT JOIN (SELECT game_id, min(place) AS place FROM {REFUSED} WHERE place <= 2 AND move LIKE '%8' GROUP BY game_id) r ON r.game_id = m.game_id""")
def annotate_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.annotate_moves(X.moves(spark, sf_dir).select("game_id", "half_move", "move", "clock"), "start", rules)
    return rows.select("game_id", "half_move", "move_uci", "fen_before", "fen_after", "clock_delta", "failure")


@query("SELECT player, game_id, half_move, (player_color = 'white') = (half_move % 2 = 1) AS is_own FROM player_rows")
def own_move_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.player_rows(spark, sf_dir).select("player", "game_id", "half_move", T.own_move(F.col("player_color"), F.col("half_move")).alias("is_own"))


@query("SELECT player, game_id, half_move, (player_color = 'white') = (half_move % 2 = 1) AND half_move > 2 AS is_expected FROM player_rows")
def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.player_rows(spark, sf_dir).select("player", "game_id", "half_move", T.expected_row(F.col("player_color"), F.col("half_move"), 2).alias("is_expected"))


def player_move_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checked build; games may have few used half-moves here."""
    return PM.build_player_moves(X.labelled_player_games(spark, sf_dir), X.annotated(spark, sf_dir), 1, 5, 0, save=True)


USED = "(a.half_move > 1 AND a.half_move <= least(g.plies_both_gt_thr, 5))"
BIN = "CASE WHEN player_elo >= 2200 THEN 'gt_2200' WHEN player_elo < 1100 THEN 'lt_1100' ELSE concat(CAST((player_elo-1100)//100*100+1100 AS STRING),'_',CAST((player_elo-1100)//100*100+1200 AS STRING)) END"
SPLIT = "CASE WHEN ('0x' || substr(md5(concat({}, '{}')), 1, 8))::BIGINT % 1000000 < {} THEN 'test' ELSE 'train' END"


@query(f"SELECT p.player, p.game_id, {BIN} AS rating_bin, {SPLIT.format('p.player', 'players', 200000)} AS split_by_player, {SPLIT.format('p.game_id', 'games', 300000)} AS split_by_games, p.player_color, p.player_elo, p.opponent_elo, p.time_control, a.half_move, a.move, a.move_uci, a.fen_before, a.fen_after, a.clock, a.clock_delta, {USED} AS is_used, a.clock_delta + CAST(split_part(p.time_control, '+', 2) AS INT) AS move_thinking_time FROM player_games p JOIN annotated a USING (game_id) JOIN games_meta g USING (game_id)")
def player_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_move_rows(spark, sf_dir)


@query(f"SELECT p.player, p.game_id, a.half_move, {USED} AS is_used FROM player_games p JOIN annotated a USING (game_id) JOIN games_meta g USING (game_id)")
def is_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_move_rows(spark, sf_dir).select("player", "game_id", "half_move", "is_used")


LENGTHS = f"SELECT game_id, count(*) FILTER (WHERE {USED}) AS used_length FROM annotated a JOIN games_meta g USING (game_id) GROUP BY game_id"


@query(LENGTHS)
def used_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PM.used_length(player_move_rows(spark, sf_dir))


@query(f"SELECT * FROM ({LENGTHS}) WHERE used_length < 2")
def check_min_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_min_segment(PM.used_length(player_move_rows(spark, sf_dir)), 2)


@query("""SELECT * FROM (VALUES ('colours', (SELECT count(*) FROM player_games WHERE player_elo > 1900)), ('numbers of player games', (SELECT count(*) FROM player_games WHERE n_plies = 3)),
 ('time controls without an increment', (SELECT count(*) FROM player_games WHERE time_control = '180+1')),
 ('a game with two rows of a colour', (SELECT count(*) FROM (SELECT game_id, CASE WHEN player_elo > 1900 THEN 'green' ELSE player_color END AS c FROM player_games GROUP BY ALL HAVING count(*) > 1))),
 ('a game with two rows of a player', 0), ('numbers of moves', 0), ('nulls in moves', (SELECT count(*) FROM moves WHERE clock IS NULL)), ('a half-move with two rows', (SELECT count(*) FROM moves WHERE half_move = 2))) t(what, n)""")
def player_input_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks find in inputs that are spoilt on purpose."""
    games, moves = X.labelled_player_games(spark, sf_dir), X.annotated(spark, sf_dir)
    games = games.withColumn("player_color", F.when(F.col("player_elo") > 1900, "green").otherwise(F.col("player_color")))
    games = games.withColumn("opponent_elo", F.when(F.col("n_plies") == 3, "x").otherwise(F.col("opponent_elo").cast("string"))).withColumn("time_control", F.when(F.col("time_control") == "180+1", "180").otherwise(F.col("time_control")))
    moves = moves.withColumn("fen_after", F.when(F.col("clock").isNotNull(), F.col("fen_after")))
    return PM.input_checks(games, moves.union(moves.where("half_move = 2").withColumn("fen_after", F.lit("x")))).select("what", "n")


@query(f"""SELECT 'games without moves' AS what, count(*) FILTER (WHERE kept = 0) AS n FROM (SELECT game_id, count(*) FILTER (WHERE half_move > 3) AS kept FROM moves GROUP BY game_id) UNION ALL
SELECT 'short games', count(*) FROM (SELECT game_id, count(*) FILTER (WHERE half_move > 3) AS kept, count(*) FILTER (WHERE half_move > 3 AND {USED}) AS used FROM annotated a JOIN games_meta g USING (game_id) GROUP BY game_id) WHERE kept > 0 AND used < 2""")
def player_game_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games without moves and with too few used ones, when moves up to the third are not there."""
    return PM.game_checks(X.player_games(spark, sf_dir), X.annotated(spark, sf_dir).where("half_move > 3"), 1, 5, 2).select("what", "n")


# ------------------------------------------------------------ checks


@query("SELECT 'clock' AS column_name, count(*) - count(clock) AS n_null FROM moves")
def check_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_nulls(X.moves(spark, sf_dir), ["clock", "move", "half_move"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_unique(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT time_control, count(*) AS n FROM moves WHERE time_control NOT IN ('180+0', '180+2') GROUP BY time_control")
def check_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_allowed(X.moves(spark, sf_dir), "time_control", ["180+0", "180+2"])


@query("SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct FROM lineitem GROUP BY l_orderkey HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(*) = count(DISTINCT l_linenumber))")
def check_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_contiguous(X.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT 'move' AS column_name, count(*) AS n_bad FROM moves")
def check_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.moves(spark, sf_dir).select("move", F.col("clock").cast("string").alias("clock"))
    return V.check_numeric(rows, ["move", "clock"])


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.missing_references(X.table(spark, sf_dir, "orders"), lines, "o_orderkey")


@query("SELECT * FROM (SELECT (SELECT count(*) FROM orders) AS n_in, (SELECT count(*) FROM games_meta) AS n_out) WHERE n_in != n_out OR n_in = 0")
def check_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_row_count(X.table(spark, sf_dir, "orders"), X.meta(spark, sf_dir))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def check_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_constant(X.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


SCORES = "(SELECT game_id, half_move, fen_before, CASE WHEN half_move % 3 != 0 THEN CAST(half_move * 10 - white_elo % 40 AS INT) END AS cp, CASE WHEN half_move % 3 = 0 THEN CAST(half_move % 5 - 2 AS INT) WHEN half_move % 7 = 0 THEN 1 END AS mate FROM annotated)"


def engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("half_move")
    cp = F.when(h % 3 != 0, (h * 10 - F.col("white_elo") % 40).cast("int"))
    mate = F.when(h % 3 == 0, (h % 5 - 2).cast("int")).when(h % 7 == 0, 1)
    return X.annotated(spark, sf_dir).select("game_id", "half_move", "fen_before", cp.alias("cp"), mate.alias("mate"))


@query(f"SELECT * FROM {SCORES} WHERE (cp IS NULL) = (mate IS NULL)")
def check_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_exactly_one(engine_scores(spark, sf_dir), "cp", "mate")


@query("SELECT game_id, half_move, fen_a FROM states WHERE fen_a IS NOT NULL AND NOT regexp_full_match(fen_a, '[a-h][1-8] [wb]')")
def check_state_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_state_shape(X.states(spark, sf_dir).select("game_id", "half_move", "fen_a"), "fen_a", "^[a-h][1-8] [wb]$")


@query("SELECT game_id, (SELECT count(*) FROM moves WHERE clock IS NULL) AS n_missing FROM (SELECT DISTINCT game_id FROM moves WHERE clock IS NULL ORDER BY game_id LIMIT 50)")
def missing_clock_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.missing_clock_report(X.moves(spark, sf_dir), 50)


# ------------------------------------------------------------ scoring


@query(f"SELECT game_id, half_move, CASE WHEN half_move % 2 = 0 THEN -s ELSE s END AS white_cp FROM (SELECT *, CASE WHEN mate > 0 THEN 10000 WHEN mate <= 0 THEN -10000 ELSE cp END AS s FROM {SCORES})")
def white_pov_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_scores(spark, sf_dir).select("game_id", "half_move", T.white_pov(F.col("fen_before"), F.col("cp"), F.col("mate")).alias("white_cp"))


@query("SELECT game_id, half_move, CASE WHEN half_move % 2 = 0 THEN 0.0 - coalesce(clock, 0.0) ELSE coalesce(clock, 0.0) END AS white_value FROM annotated")
def white_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.annotated(spark, sf_dir).select("game_id", "half_move", T.white_value(F.col("fen_before"), F.col("clock")).alias("white_value"))


PARAMS = ["p1050", "p1550", "p2050"]
GRID = f"SELECT game_id, half_move, param, {scored('concat(param, chr(58), fen_before, chr(58), CAST(white_elo AS STRING))')} AS score FROM annotated CROSS JOIN (VALUES ('p1050'), ('p1550'), ('p2050')) t(param)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_grid(X.annotated(spark, sf_dir), ["game_id", "half_move"], ["fen_before", "white_elo"], PARAMS, stand_in("param", "fen_before", "white_elo"))


@query(GRID)
def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


class Engine:
    """A stand-in for an engine that is dear to start, and that fails on moves to a corner of the board."""

    def __init__(self, param: str):
        self.score = stand_in("param", "fen_before", "white_elo")

    def __call__(self, frame: pd.DataFrame) -> pd.Series:
        if any("h1 " in x for x in frame["fen_before"].tolist() if x):
            raise ValueError("not on the board")
        return self.score(frame)


@query(f"SELECT game_id, half_move, param, CASE WHEN move != 'h1' THEN score END AS score, CASE WHEN move = 'h1' THEN 'not on the board' END AS failure FROM ({GRID}) JOIN moves USING (game_id, half_move)")
def score_with_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_with_engines(X.annotated(spark, sf_dir), ["game_id", "half_move"], ["fen_before", "white_elo"], PARAMS, Engine)


@query(f"SELECT game_id, half_move, max(score) FILTER (WHERE param = 'p1050') AS move_model_p1050, max(score) FILTER (WHERE param = 'p1550') AS move_model_p1550, max(score) FILTER (WHERE param = 'p2050') AS move_model_p2050 FROM ({GRID}) GROUP BY ALL")
def widen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.widen_scores(grid(spark, sf_dir), ["game_id", "half_move"], PARAMS, "move_model")


@query("SELECT game_id, half_move, CASE WHEN half_move % 3 = 0 THEN 'a' WHEN half_move % 3 = 1 THEN 'b' ELSE 'a' END AS best FROM moves")
def top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("half_move") % 3
    probs = F.create_map(F.lit("a"), F.when(h == 0, 0.6).otherwise(0.4).cast("double"), F.lit("b"), F.when(h == 1, 0.5).otherwise(0.4).cast("double"), F.lit("c"), F.lit(0.1).cast("double"))
    return X.moves(spark, sf_dir).select("game_id", "half_move", T.top1(probs).alias("best"))


@query("SELECT game_id, half_move, concat('{\"', move, '\":', CAST(half_move AS STRING), ',\"x\":', CAST(half_move + 1 AS STRING), '}') AS probs FROM moves")
def probs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.moves(spark, sf_dir).select("game_id", "half_move", T.probs_json(F.array("move", F.lit("x")), F.array("half_move", F.col("half_move") + 1)).alias("probs"))


@query("SELECT game_id, arg_min(move, half_move) AS first_move FROM moves GROUP BY game_id")
def best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.moves(spark, sf_dir).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("half_move", F.col("move").alias("Move")))).alias("lines"))
    return lines.select("game_id", T.best_of(F.col("lines")).alias("first_move"))


@query(f"SELECT player, game_id, half_move, CASE WHEN (player_color = 'white') = (half_move % 2 = 1) THEN {scored('fen_before')} END AS score FROM player_rows")
def score_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.player_rows(spark, sf_dir).select("player", "game_id", "half_move", "player_color", "fen_before")
    return C.score_where(rows, T.own_move(F.col("player_color"), F.col("half_move")), ["player", "game_id", "half_move"], ["fen_before"], stand_in("fen_before")).select("player", "game_id", "half_move", "score")


CELLS = "(SELECT * FROM (SELECT game_id, half_move, opponent_elo, 'fen_before' AS source_col, fen_before AS state FROM states UNION ALL SELECT game_id, half_move, opponent_elo, 'fen_a', fen_a FROM states UNION ALL SELECT game_id, half_move, opponent_elo, 'fen_b', fen_b FROM states))"
FILLED = f"(SELECT * FROM {CELLS} WHERE state IS NOT NULL AND lower(trim(state)) NOT IN ('', 'none', 'nan'))"
FENS = ["fen_before", "fen_a", "fen_b"]


@query(f"SELECT game_id, half_move, source_col, state, {scored('concat(state, chr(58), CAST(opponent_elo AS STRING))')} AS score FROM {FILLED}")
def dedup_score_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_score_scatter(X.states(spark, sf_dir), ["game_id", "half_move"], FENS, ["opponent_elo"], stand_in("state", "opponent_elo"))


@query(f"SELECT game_id, half_move, source_col, state, {scored('concat(game_id, chr(58), CAST(half_move AS STRING), chr(58), state)')} AS score FROM {FILLED}")
def dedup_within_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_score_scatter(X.states(spark, sf_dir), ["game_id", "half_move"], FENS, [], stand_in("game_id", "half_move", "state"), within=["game_id", "half_move"])


@query(f"SELECT (SELECT count(*) FROM {CELLS}) AS n_cells, count(*) AS n_used, count(DISTINCT concat(state, ':', CAST(opponent_elo AS STRING))) AS n_unique FROM {FILLED}")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_stats(X.states(spark, sf_dir), ["game_id", "half_move"], FENS, ["opponent_elo"])


@query("SELECT count(*) - count(clock) AS n_filled FROM moves")
def fill_with_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_with_report(X.moves(spark, sf_dir), "clock")[1]


@query("SELECT game_id, half_move FROM states WHERE (fen_a IS NULL OR trim(fen_a) = '') AND half_move > 3")
def early_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.early_missing(X.states(spark, sf_dir), "fen_a", 3).select("game_id", "half_move")


@query(f"SELECT game_id, half_move, eval_b, CASE WHEN half_move % 2 = 1 THEN CAST({scored('fen_before')} AS INT) END AS eval_before, CASE WHEN half_move % 2 = 1 AND fen_a IS NOT NULL THEN CAST({scored('fen_a')} AS INT) END AS eval_a FROM (SELECT *, 7 AS eval_b FROM states)")
def eval_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.states(spark, sf_dir).withColumn("eval_b", F.lit(7))
    return C.evaluate_missing(rows, ["game_id", "half_move"], F.col("half_move") % 2 == 1, stand_in("state")).select("game_id", "half_move", "eval_b", "eval_before", "eval_a")


OLD = "SELECT DISTINCT state FROM (SELECT fen_a AS state FROM dated WHERE is_old UNION ALL SELECT fen_b FROM dated WHERE is_old UNION ALL SELECT fen_before FROM dated WHERE is_old) WHERE trim(state) != ''"
DATED = "dated AS (SELECT s.*, m.date < DATE '1995-01-01' AS is_old FROM states s JOIN moves m USING (game_id, half_move))"


@query(f"SELECT * FROM (WITH {DATED}, o AS ({OLD}), a AS ({OLD.replace('WHERE is_old', '')}) SELECT 'first' AS run, (SELECT count(*) FROM o) AS n_new, (SELECT count(*) FROM o) AS n_stored UNION ALL SELECT 'again', 0, (SELECT count(*) FROM o) UNION ALL SELECT 'grown', (SELECT count(*) FROM a) - (SELECT count(*) FROM o), (SELECT count(*) FROM a))")
def score_store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many states three runs score: on the games of some years, on the same again, and on the table as it has grown since."""
    dates = X.moves(spark, sf_dir).select("game_id", "half_move", "date")
    whole = X.states(spark, sf_dir).drop("opponent_elo").join(dates, ["game_id", "half_move"])
    store, old, counts = C.ScoreStore(spark, shared.shared_folder(spark, "scores"), {"state": "string"}), whole.where("date < DATE '1995-01-01'"), []
    for run, table in (("first", old), ("again", old), ("grown", whole)):
        _, added = C.evaluate_stored(table, ["game_id", "half_move"], F.lit(True), stand_in("state"), store)
        counts.append((run, added, store.stored().count()))
    return spark.createDataFrame(counts, "run string, n_new long, n_stored long")


@query(f"SELECT game_id, half_move, 7 AS eval_b, CASE WHEN half_move % 2 = 1 THEN CAST({scored('fen_before')} AS INT) END AS eval_before, CASE WHEN half_move % 2 = 1 AND fen_a IS NOT NULL THEN CAST({scored('fen_a')} AS INT) END AS eval_a FROM states")
def eval_stored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = C.ScoreStore(spark, shared.shared_folder(spark, "scores"), {"state": "string"})
    rows = X.states(spark, sf_dir).withColumn("eval_b", F.lit(7))
    return C.evaluate_stored(rows, ["game_id", "half_move"], F.col("half_move") % 2 == 1, stand_in("state"), store)[0].select("game_id", "half_move", "eval_b", "eval_before", "eval_a")


@query("SELECT game_id, half_move, CASE WHEN half_move % 3 = 0 THEN 0 ELSE coalesce(CAST(clock AS INT), 0) END AS seconds FROM moves")
def seconds_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("half_move") % 3 == 0, "bad").otherwise(F.col("clock").cast("string"))
    return X.moves(spark, sf_dir).select("game_id", "half_move", T.seconds_or_zero(text).alias("seconds"))


# ------------------------------------------------------------ merging and vectors


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    """A main table, which is written once, as all side tables are made of it, in buckets of games, so that they merge where they lie."""
    main = shared.kept_by(X.player_rows(spark, sf_dir).select("player", "game_id", "half_move", "player_color", "move"), "main-rows", "game_id", 2)
    one = main.where("half_move % 2 = 1").select("player", "game_id", "half_move", F.concat("move", F.lit("!")).alias("move_one"), F.lit(1).alias("shared"))
    two = main.where("half_move > 1").select("player", "game_id", "half_move", F.concat("move", F.lit("?")).alias("move_two"), F.lit(2).alias("shared"), F.lit("x").alias("move"))
    return main, [one, two]


MERGED = "(SELECT player, game_id, half_move, player_color, move, CASE WHEN half_move % 2 = 1 THEN concat(move, '!') END AS move_one, CASE WHEN half_move % 2 = 1 THEN 1 END AS shared, CASE WHEN half_move > 1 THEN concat(move, '?') END AS move_two FROM player_rows)"
OWN = "(player_color = 'white') = (half_move % 2 = 1) AND half_move > 2"


@query(f"SELECT * FROM {MERGED}")
def merge_side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_side_tables(*sides(spark, sf_dir))


@query("SELECT player, game_id, half_move, CAST(1 AS BIGINT) AS n_main, CAST(0 AS BIGINT) AS n_side FROM player_rows WHERE half_move % 2 = 0")
def key_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, (one, _) = sides(spark, sf_dir)
    return M.key_agreement(main, one)


FAULTY = """SELECT player, game_id, half_move, CASE WHEN half_move % 2 = 1 THEN 1 ELSE 0 END AS a, CASE WHEN half_move > 2 THEN 2 WHEN half_move > 1 THEN 1 ELSE 0 END AS b, 1 AS c FROM player_rows"""


@query(f"""SELECT player, game_id, half_move, CAST(1 AS INT) AS "table", CAST(1 AS BIGINT) AS n_main, CAST(a AS BIGINT) AS n_side FROM ({FAULTY}) WHERE a != 1 UNION ALL
SELECT player, game_id, half_move, 2, 1, b FROM ({FAULTY}) WHERE b != 1 UNION ALL SELECT DISTINCT concat(player, '?'), game_id, half_move, 2, 0, 1 FROM player_rows WHERE half_move = 1""")
def merge_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three side tables: one lacks keys, one lacks some, has some twice and some of its own, one is right."""
    main, (one, two) = sides(spark, sf_dir)
    alien = main.where("half_move = 1").select(F.concat("player", F.lit("?")).alias("player"), "game_id", "half_move")
    keys = two.select(*M.KEYS)
    return M.merge_faults(main, [one, keys.union(keys.where("half_move > 2")).union(alien), main])


@query(f"SELECT player, game_id, half_move, player_color, move, CASE WHEN {OWN} THEN concat(move, '!') END AS move_one, CASE WHEN {OWN} THEN concat(move, '?') END AS move_two FROM player_rows")
def verified_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, _ = sides(spark, sf_dir)
    complete = [main.select(*M.KEYS, F.concat("move", F.lit(end)).alias(name)) for end, name in (("!", "move_one"), ("?", "move_two"))]
    return M.verified_merge(main, complete, M.KEYS, T.expected_row(F.col("player_color"), F.col("half_move"), 2))[0]


@query(f"SELECT player, game_id, half_move, player_color, move, CASE WHEN {OWN} THEN move_one END AS move_one, shared, CASE WHEN {OWN} THEN move_two END AS move_two FROM {MERGED}")
def mask_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merge_side_tables(*sides(spark, sf_dir))
    return M.mask_extras(merged, ["move_one", "move_two"], T.expected_row(F.col("player_color"), F.col("half_move"), 2))


@query(f"SELECT 'move_one' AS column_name, count(*) FILTER (WHERE {OWN} AND move_one IS NULL) AS n_missing FROM {MERGED} UNION ALL SELECT 'move_two', count(*) FILTER (WHERE {OWN} AND move_two IS NULL) FROM {MERGED}")
def missing_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merge_side_tables(*sides(spark, sf_dir))
    return M.missing_expected(merged, ["move_one", "move_two"], T.expected_row(F.col("player_color"), F.col("half_move"), 2))


@query("SELECT o_orderkey, o_custkey AS unnamed_owner FROM orders")
def drop_index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("unnamed_owner"), F.col("o_orderkey").alias("unnamed_index"))
    return M.drop_index_columns(rows, "unnamed_")


VECTORS = "(SELECT vec_id, 'embedding' AS source_col, embedding AS vec FROM embeddings UNION ALL SELECT vec_id, 'half', CASE WHEN vec_id % 2 = 0 THEN embedding END FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("half"))
    return M.embeddings_long(rows, ["vec_id"], ["embedding", "half"])


@query(f"SELECT vec_id, source_col, CAST(len(vec) AS INT) AS width, CAST(vec[1] AS DOUBLE) AS first_value FROM {VECTORS}")
def embeddings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_folder(spark, "vectors")
    tables.write_embeddings(vectors(spark, sf_dir), path)
    back = spark.read.parquet(path)
    width = F.when(F.col("vec").isNotNull(), F.size("vec"))
    return back.select("vec_id", "source_col", width.alias("width"), F.get("vec", F.lit(0)).cast("double").alias("first_value"))


@query(f"SELECT source_col, count(*) AS n_rows, count(vec) AS n_filled FROM {VECTORS} GROUP BY source_col")
def fill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fill_stats(vectors(spark, sf_dir))


def state_vectors(frame: pd.DataFrame) -> pd.Series:
    """A stand-in for a network: two numbers for each state and rating."""
    return stand_in("state", "opponent_elo")(frame).map(lambda x: [float(x), float(x) + 1])


def featurised(spark: SparkSession, sf_dir: str) -> features.Features:
    """All state columns of the moves, where the first half-move's opponent has no rating."""
    rows = X.states(spark, sf_dir).withColumn("opponent_elo", F.when(F.col("half_move") > 1, F.col("opponent_elo")))
    return features.featurise(rows, ["game_id", "half_move"], "fen_", ["opponent_elo"], state_vectors, shared.shared_folder(spark, "features"))


RATED = "concat(state, ':', CASE WHEN half_move > 1 THEN CAST(opponent_elo AS STRING) ELSE '0' END)"


@query(f"SELECT game_id, half_move, source_col, CASE WHEN state IS NOT NULL AND lower(trim(state)) NOT IN ('', 'none', 'nan') THEN CAST({scored(RATED)} AS DOUBLE) END AS first_value, CASE WHEN state IS NOT NULL AND lower(trim(state)) NOT IN ('', 'none', 'nan') THEN CAST({scored(RATED)} + 1 AS DOUBLE) END AS second_value FROM {CELLS}")
def featurise(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda k: F.get("vec", F.lit(k)).cast("double")
    return featurised(spark, sf_dir).vectors.select("game_id", "half_move", "source_col", value(0).alias("first_value"), value(1).alias("second_value"))


@query(f"SELECT (SELECT count(*) FROM {CELLS}) AS n_cells, count(*) AS n_used, count(DISTINCT {RATED}) AS n_unique, (SELECT count(*) FROM states WHERE half_move = 1) AS n_filled_extras FROM {FILLED}")
def featurise_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featurised(spark, sf_dir).totals


@query(f"SELECT source_col, count(*) AS n_rows, count(*) FILTER (WHERE state IS NOT NULL AND lower(trim(state)) NOT IN ('', 'none', 'nan')) AS n_filled FROM {CELLS} GROUP BY source_col")
def featurise_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featurised(spark, sf_dir).filled
