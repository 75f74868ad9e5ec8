"""Columns parsed from text: ids, ratings, clocks, evaluations, colours, states."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def id_from_url(url: Column) -> Column:
    """The last path part of a URL, without its query; empty for an empty URL."""
    text = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")
    return F.substring_index(F.element_at(F.split(text, "/"), -1), "?", 1)


def parse_elo(c: Column) -> Column:
    """Digits alone to an integer; anything else, blanks around them and null included, to 0."""
    return F.coalesce(F.when(c.rlike(r"\A[0-9]+\z"), _cast(c, "int")), F.lit(0))


def clock_seconds(c: Column) -> Column:
    """`H:MM:SS` to seconds; null for any other text."""
    part = F.split(c, ":")
    whole = _cast(F.get(part, F.lit(0)), "int") * 3600 + _cast(F.get(part, F.lit(1)), "int") * 60 + _cast(F.get(part, F.lit(2)), "int")
    return F.when(F.size(part) == 3, whole)


def parse_eval(c: Column, mate: float = 100.0) -> Column:
    """A number to a double, `#n` to +mate if n > 0 and else -mate; null for other text."""
    text = F.trim(c)
    n = _cast(F.substring(text, 2, 20), "int")
    return F.when(text.startswith("#"), F.when(n > 0, mate).when(n <= 0, -mate)).otherwise(_cast(text, "double"))


def bad_mate(c: Column) -> Column:
    """Is there a `#` that no integer follows; such a game is dropped whole."""
    text = F.trim(c)
    return F.coalesce(text.startswith("#") & _cast(F.substring(text, 2, 20), "int").isNull(), F.lit(False))


def increment_seconds(c: Column) -> Column:
    """The second number of `base+increment`; null where the text isn't of that form."""
    part = F.split(c, r"\+", 2)
    return F.when(F.size(part) == 2, _cast(F.trim(F.get(part, F.lit(1))), "int"))


def looks_like_uci(c: Column) -> Column:
    """Is a move in coordinate notation (`e2e4`, `a7a8q`), in either case."""
    return F.coalesce(F.trim(c).rlike("(?i)^[a-h][1-8][a-h][1-8][qrbn]?$"), F.lit(False))


def side_to_move(state: Column) -> Column:
    """The second word of a board state: w or b; null without one."""
    return F.get(F.split(F.trim(state), " "), F.lit(1))


def is_missing(c: Column, sentinels: Iterable[str] = ("", "none", "nan")) -> Column:
    """Null, blank, or one of the sentinel words in any case."""
    return c.isNull() | F.lower(F.trim(c)).isin("", *sentinels)


def normalize_color(c: Column) -> Column:
    """`w` or `white`, `b` or `black` in any case to white and black; null for other text."""
    text = F.lower(F.trim(c))
    return F.when(text.isin("w", "white"), "white").when(text.isin("b", "black"), "black")


def rating_bin(c: Column, lo: int = 1100, hi: int = 2200, step: int = 100) -> Column:
    """`lt_<lo>`, `gt_<hi>` from hi on, else `<start>_<end>` of the step; null for null."""
    if (hi - lo) % step:
        raise ValueError("the range has to be a multiple of the step")
    start = (F.floor((c - lo) / step) * step + lo).cast("int")
    inner = F.concat(start.cast("string"), F.lit("_"), (start + step).cast("string"))
    return F.when(c >= hi, f"gt_{hi}").when(c < lo, f"lt_{lo}").when(c.isNotNull(), inner)


def own_move(color: Column, half_move: Column) -> Column:
    """Whether the player moves: white on odd half-moves, black on even ones."""
    return F.coalesce(F.when(color == "white", half_move % 2 == 1).when(color == "black", half_move % 2 == 0), F.lit(False))


def expected_row(color: Column, half_move: Column, after: int = 20) -> Column:
    return own_move(color, half_move) & (half_move > after)


def hash_order(salt: str, *keys: Column) -> Column:
    """A repeatable random order: md5 of the salt and the keys."""
    return F.md5(F.concat(F.lit(salt), *keys))


def hash_bucket(c: Column, buckets: int = 1_000_000) -> Column:
    """A bucket from the first 8 hex digits of the md5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % buckets


def top1(probabilities: Column) -> Column:
    """The key of the greatest value of a map; the first among equals."""
    best = F.aggregate(
        F.map_entries(probabilities),
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value")),
        lambda a, e: F.when(a["value"].isNull() | (e["value"] > a["value"]), F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value"))).otherwise(a),
    )
    return best["key"]


def probs_json(keys: Column, values: Column) -> Column:
    """Aligned arrays of keys and values as compact JSON."""
    return F.to_json(F.map_from_arrays(keys, values))


def best_of(ranked: Column, name: str = "Move") -> Column:
    """The action of the first entry of a ranked list; null for an empty list."""
    return F.get(ranked, F.lit(0))[name]


def white_pov(state: Column, cp: Column, mate: Column, mate_eval: int = 10_000) -> Column:
    """A score of the side to move as white sees it; a mate counts +-mate_eval. Null without either."""
    score = F.coalesce(F.when(mate > 0, mate_eval).when(mate <= 0, -mate_eval), cp)
    return F.when(side_to_move(state) == "b", -score).otherwise(score)


def white_value(state: Column, value: Column) -> Column:
    """A value of the side to move as white sees it; null counts 0."""
    v = F.coalesce(value, F.lit(0.0))
    return F.when(side_to_move(state) == "b", F.lit(0.0) - v).otherwise(v)


def seconds_or_zero(c: Column) -> Column:
    """A duration to whole seconds; bad ones and null to 0."""
    return F.coalesce(_cast(_cast(c, "double"), "int"), F.lit(0))
