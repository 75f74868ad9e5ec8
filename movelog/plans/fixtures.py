"""Game-shaped views over the driver's tables: an order is a game, a line item a half-move, a customer a player.

`PRELUDE` says the same views as SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rating_bin
from ..operators.games import games_meta, perspectives
from ..operators.sampling import split_by_hash
from ..operators.sequence import clock_delta
from ..sources.shared import dealt_by_size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move rows with what the archive needs besides: event, site, eval_text.

    Games have their id from the scan on: all that follows is by game_id, so that windows, summaries and
    joins of games with their moves find the rows where the first shuffle has put them.
    """
    game = lambda key: F.concat(F.lit("g"), F.col(key).cast("string")).alias("game_id")
    orders = table(spark, sf_dir, "orders").select(game("o_orderkey"), "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    lines = dealt_by_size(table(spark, sf_dir, "lineitem")).select(game("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("game_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    other = (F.col("o_custkey") + 1 + F.col("o_orderkey") % 97) % F.col("n")
    elo = lambda c: (F.lit(1000) + (c * 37) % 1300 + F.col("o_orderkey") % 50).cast("int")
    rows = lines.withColumn("half_move", place).join(orders, "game_id").join(F.broadcast(n), F.lit(True))  # n is one row
    return rows.select(
        "game_id",
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("white"),
        F.concat(F.lit("p"), other.cast("string")).alias("black"),
        elo(F.col("o_custkey")).alias("white_elo"),
        elo(other).alias("black_elo"),
        F.concat(F.lit("180+"), (F.col("o_orderkey") % 3).cast("string")).alias("time_control"),
        F.when(F.col("o_orderstatus") == "F", "Time forfeit").otherwise("Normal").alias("termination"),
        F.when(F.col("o_orderkey") % 2 == 0, "1-0").otherwise("0-1").alias("result"),
        F.col("half_move").cast("int").alias("half_move"),
        F.concat(F.substring(F.lit("abcdefgh"), (F.col("l_partkey") % 8 + 1).cast("int"), F.lit(1)), (F.col("l_suppkey") % 8 + 1).cast("string")).alias("move"),
        F.nullif(F.col("l_quantity"), F.lit(50.0)).alias("clock"),
        F.when(F.col("o_orderkey") % 5 == 0, "Rated Bullet game").otherwise("Rated BLITZ game").alias("event"),
        F.concat(F.lit("https://games.example/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "/").when(F.col("o_orderkey") % 11 == 0, "?x=1").otherwise("")).alias("site"),
        F.when(F.col("l_returnflag") == "R", "#-2").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".5"))).alias("eval_text"),
    )


MOVE_COLUMNS = ("game_id", "date", "white", "black", "white_elo", "black_elo", "time_control", "termination", "result", "half_move", "move", "clock")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_moves(spark, sf_dir).select(*MOVE_COLUMNS)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games_meta(moves(spark, sf_dir), 3)


def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(meta(spark, sf_dir))


def labelled_player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views of games with a bin and both splits, as the player-move table wants them."""
    rows = player_games(spark, sf_dir).withColumn("rating_bin", rating_bin(F.col("player_elo")))
    return split_by_hash(split_by_hash(rows, "player", 0.2, "players", "split_by_player"), "game_id", 0.3, "games")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves with stand-ins for notation and board states."""
    rows = clock_delta(moves(spark, sf_dir)).withColumn("move_uci", F.concat("move", "move"))
    before = F.concat("move", F.when(F.col("half_move") % 2 == 1, " w").otherwise(" b"))
    return rows.withColumn("fen_before", before).withColumn("fen_after", F.concat("fen_before", F.lit("/"), "move"))


def player_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, game_id, half_move and what the sequence operators read."""
    games = player_games(spark, sf_dir).select("game_id", "player", "player_color", "player_elo", "opponent_elo")
    return games.join(annotated(spark, sf_dir).select("game_id", "half_move", "move", "clock", "clock_delta", "time_control", "fen_before"), "game_id")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game_id, half_move, opponent_elo, fen_before, fen_a, fen_b with gaps of several kinds."""
    h = F.col("half_move")
    side = F.when(h % 2 == 1, " w").otherwise(" b")
    other = F.when(h % 2 == 1, " b").otherwise(" w")
    return moves(spark, sf_dir).select(
        "game_id",
        "half_move",
        F.when(h % 2 == 1, F.col("white_elo")).otherwise(F.col("black_elo")).alias("opponent_elo"),
        F.concat("move", side).alias("fen_before"),
        F.when(h % 3 == 0, None).when(h % 5 == 0, "None").otherwise(F.concat(F.substring("move", 1, 1), F.lit("1"), other)).alias("fen_a"),
        F.when(h % 4 == 0, "").otherwise(F.concat("move", side)).alias("fen_b"),
    )


PRELUDE = """n AS (SELECT count(*) AS n FROM customer),
raw_moves AS (
 SELECT concat('g',CAST(o.o_orderkey AS STRING)) AS game_id, CAST(o.o_orderdate AS DATE) AS date,
  concat('p',CAST(o.o_custkey AS STRING)) AS white,
  concat('p',CAST((o.o_custkey + 1 + o.o_orderkey % 97) % n.n AS STRING)) AS black,
  CAST(1000 + (o.o_custkey*37) % 1300 + o.o_orderkey % 50 AS INT) AS white_elo,
  CAST(1000 + (((o.o_custkey + 1 + o.o_orderkey % 97) % n.n)*37) % 1300 + o.o_orderkey % 50 AS INT) AS black_elo,
  concat('180+',CAST(o.o_orderkey % 3 AS STRING)) AS time_control,
  CASE WHEN o.o_orderstatus='F' THEN 'Time forfeit' ELSE 'Normal' END AS termination,
  CASE WHEN o.o_orderkey % 2 = 0 THEN '1-0' ELSE '0-1' END AS result,
  CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber,l.l_partkey,l.l_suppkey,l.l_quantity,l.l_extendedprice) AS INT) AS half_move,
  concat(substr('abcdefgh', CAST(l.l_partkey % 8 AS INT)+1, 1), CAST(l.l_suppkey % 8 + 1 AS STRING)) AS move,
  NULLIF(l.l_quantity, 50.0) AS clock,
  CASE WHEN o.o_orderkey % 5 = 0 THEN 'Rated Bullet game' ELSE 'Rated BLITZ game' END AS event,
  concat('https://games.example/', CAST(o.o_orderkey AS STRING), CASE WHEN o.o_orderkey % 7 = 0 THEN '/' WHEN o.o_orderkey % 11 = 0 THEN '?x=1' ELSE '' END) AS site,
  CASE WHEN l.l_returnflag = 'R' THEN '#-2' ELSE concat(CAST(l.l_linenumber AS STRING), '.5') END AS eval_text
 FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey CROSS JOIN n),
moves AS (SELECT game_id, date, white, black, white_elo, black_elo, time_control, termination, result, half_move, move, clock FROM raw_moves),
games_meta AS (
 SELECT game_id, min(date) date, min(white) white, min(black) black, min(white_elo) white_elo, min(black_elo) black_elo,
  min(time_control) time_control, min(termination) termination, min(result) result, max(half_move) n_plies,
  min(half_move) FILTER (WHERE half_move%2=1 AND clock<=3) first_white_leq_thr_ply,
  min(half_move) FILTER (WHERE half_move%2=0 AND clock<=3) first_black_leq_thr_ply,
  coalesce(least(min(half_move) FILTER (WHERE half_move%2=1 AND clock<=3), min(half_move) FILTER (WHERE half_move%2=0 AND clock<=3))-1, max(half_move)) plies_both_gt_thr
 FROM moves GROUP BY game_id),
player_games AS (
 SELECT game_id, date, time_control, termination, result, n_plies, first_white_leq_thr_ply, first_black_leq_thr_ply, plies_both_gt_thr,
  white player, black opponent, white_elo player_elo, black_elo opponent_elo, 'white' player_color FROM games_meta
 UNION ALL
 SELECT game_id, date, time_control, termination, result, n_plies, first_white_leq_thr_ply, first_black_leq_thr_ply, plies_both_gt_thr,
  black, white, black_elo, white_elo, 'black' FROM games_meta),
annotated AS (
 SELECT *, coalesce(lag(clock, 2) OVER (PARTITION BY game_id ORDER BY half_move) - clock, 0.0) AS clock_delta, concat(move, move) AS move_uci,
  concat(move, CASE WHEN half_move % 2 = 1 THEN ' w' ELSE ' b' END) AS fen_before,
  concat(move, CASE WHEN half_move % 2 = 1 THEN ' w' ELSE ' b' END, '/', move) AS fen_after FROM moves),
player_rows AS (
 SELECT p.player, p.game_id, p.player_color, p.player_elo, p.opponent_elo, a.half_move, a.move, a.clock, a.clock_delta, a.time_control, a.fen_before
 FROM player_games p JOIN annotated a USING (game_id)),
states AS (
 SELECT game_id, half_move, CASE WHEN half_move%2=1 THEN white_elo ELSE black_elo END AS opponent_elo,
  concat(move, CASE WHEN half_move%2=1 THEN ' w' ELSE ' b' END) AS fen_before,
  CASE WHEN half_move%3=0 THEN NULL WHEN half_move%5=0 THEN 'None' ELSE concat(substr(move,1,1),'1',CASE WHEN half_move%2=1 THEN ' b' ELSE ' w' END) END AS fen_a,
  CASE WHEN half_move%4=0 THEN '' ELSE concat(move, CASE WHEN half_move%2=1 THEN ' w' ELSE ' b' END) END AS fen_b FROM moves),
month_stats AS (SELECT player, avg(player_elo) AS avg_elo, count(*) AS n_games FROM player_games GROUP BY player HAVING count(*) >= 10),
binned AS (SELECT *, CASE WHEN avg_elo >= 2200 THEN 'gt_2200' WHEN avg_elo < 1100 THEN 'lt_1100'
  ELSE concat(CAST(CAST(floor((avg_elo-1100)/100)*100+1100 AS INT) AS STRING),'_',CAST(CAST(floor((avg_elo-1100)/100)*100+1200 AS INT) AS STRING)) END AS avg_bin FROM month_stats),
preselected AS (SELECT player, avg_elo, n_games, avg_bin FROM (SELECT *, row_number() OVER (PARTITION BY avg_bin ORDER BY md5(player), player) rn FROM binned) WHERE rn <= 50),
eligible AS (SELECT * FROM (SELECT g.*, p.avg_elo, p.avg_bin, p.n_games, CASE WHEN player_elo >= 2200 THEN 'gt_2200' WHEN player_elo < 1100 THEN 'lt_1100'
  ELSE concat(CAST((player_elo-1100)//100*100+1100 AS STRING),'_',CAST((player_elo-1100)//100*100+1200 AS STRING)) END AS player_bin
  FROM player_games g JOIN preselected p USING (player) WHERE plies_both_gt_thr >= 2) WHERE player_bin = avg_bin),
enough AS (SELECT avg_bin, player, min(avg_elo) avg_elo, min(n_games) n_games, count(*) n_eligible FROM eligible GROUP BY avg_bin, player HAVING count(*) >= 3),
candidates AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY avg_bin ORDER BY md5(concat('players:candidate:', player)), player) rn FROM enough) WHERE rn <= 20),
deduped AS (SELECT e.* FROM eligible e WHERE EXISTS (SELECT 1 FROM candidates c WHERE c.avg_bin = e.avg_bin AND c.player = e.player) AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.player = e.opponent)),
enough_two AS (SELECT avg_bin, player, min(avg_elo) avg_elo, min(n_games) n_games, count(*) n_eligible FROM deduped GROUP BY avg_bin, player HAVING count(*) >= 3),
final AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY avg_bin ORDER BY md5(concat('players:test:', player)), player) <= 2 THEN 'test' ELSE 'train' END AS split_by_player
  FROM (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY avg_bin ORDER BY md5(concat('players:final:', player)), player) rn FROM enough_two) WHERE rn <= 10)),
final_one AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY avg_bin ORDER BY md5(concat('players:test:', player)), player) <= 2 THEN 'test' ELSE 'train' END AS split_by_player
  FROM (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY avg_bin ORDER BY md5(concat('players:final:', player)), player) rn FROM enough) WHERE rn <= 10)),
pool AS (SELECT d.* FROM deduped d SEMI JOIN final f ON f.avg_bin = d.avg_bin AND f.player = d.player),
game_split AS (SELECT game_id, CASE WHEN ('0x' || substr(md5(concat(game_id, 'games')), 1, 8))::BIGINT % 1000000 < 300000 THEN 'test' ELSE 'train' END AS split_by_games FROM (SELECT DISTINCT game_id FROM pool)),
sampled AS (SELECT * EXCLUDE rn FROM (SELECT p.*, f.split_by_player, f.n_eligible, s.split_by_games,
  row_number() OVER (PARTITION BY p.avg_bin, p.player ORDER BY md5(concat(p.game_id, p.player)), p.game_id, p.player) rn
  FROM pool p JOIN final f USING (avg_bin, player) JOIN game_split s USING (game_id)) WHERE rn <= 3)"""


def sql(query: str) -> str:
    """The query over the views."""
    return f"WITH {PRELUDE}\n{query}"
