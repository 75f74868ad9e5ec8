"""Side tables onto a main table by key, and what is missing, masked or idle in the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["player", "game_id", "half_move"]


def side_extras(known: list[str], side: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and the columns that are not known yet."""
    return side.select(*keys, *[c for c in side.columns if c not in known])


def merge_side_tables(main: DataFrame, sides: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Side tables onto the main table by key; of columns with one name the first table's stays.

    All tables are one union, tagged by table: a single shuffle by key, however many side tables there
    are. Rows stay rows that are sorted by key and may spill; a key's window gives each main row the new
    columns, and no key's rows are collected. A key that a side table has twice raises while the result
    is made; `merge_faults` lists such keys.
    """
    new = {c: side.schema[c].dataType for side in reversed(sides) for c in side.columns if c in new_columns(main, sides, keys)}
    rest = [f for f in main.schema.fields if f.name not in keys]
    known, parts = set(main.columns), []
    for k, df in enumerate([main, *sides]):
        own = [c for c in df.columns if k and c not in known]
        known |= set(df.columns)
        of_main = [(F.lit(None).cast(f.dataType) if k else F.col(f.name)).alias(f.name) for f in rest]
        parts.append(df.select(*keys, F.lit(k).alias("__table"), *of_main, *[(F.col(c) if c in own else F.lit(None).cast(new[c])).alias(c) for c in new]))
    of_key = Window.partitionBy(*keys)
    counts = [F.count_if(F.col("__table") == k).over(of_key).alias(f"__n{k}") for k in range(1, len(parts))]
    seen = reduce(DataFrame.unionByName, parts).select(*keys, "__table", *[f.name for f in rest], *[F.first(c, ignorenulls=True).over(of_key).alias(c) for c in new], *counts)
    doubled = reduce(Column.__or__, [F.col(f"__n{k}") > 1 for k in range(1, len(parts))], F.lit(False))
    told = F.raise_error(F.concat(F.lit("a side table has several rows of the key "), F.to_json(F.struct(*keys))))
    # Rows of side tables are judged too: a key that main lacks may be doubled.
    return seen.where(F.when(doubled, told.cast("boolean")).otherwise(F.col("__table") == 0)).select(*main.columns, *new)


def new_columns(main: DataFrame, sides: list[DataFrame], keys: list[str]) -> list[str]:
    """The columns that the side tables bring, the first table first."""
    return list(dict.fromkeys(c for side in sides for c in side.columns if c not in main.columns and c not in keys))


def merge_faults(main: DataFrame, sides: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """keys, table (number of the side table, from 1), n_main, n_side: keys that a side table lacks, has alone or has more often than once."""
    tagged = [df.select(*keys, F.lit(k).alias("__table")) for k, df in enumerate([main, *sides])]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.count_if(F.col("__table") == k).alias(f"__n{k}") for k in range(len(tagged))])
    each = F.array(*[F.struct(F.lit(k).alias("table"), F.col("__n0").alias("n_main"), F.col(f"__n{k}").alias("n_side")) for k in range(1, len(sides) + 1)])
    return merged.select(*keys, F.inline(each)).where("n_main != n_side OR n_side > 1")


def verified_merge(main: DataFrame, sides: list[DataFrame], keys: list[str], expected: Column, complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """The merged table with the new columns null outside the expected rows, and column_name, n_missing within them.

    With `complete`, a side table that does not have exactly the main table's keys, each once, raises.
    """
    faults = merge_faults(main, sides, keys)
    if complete and (samples := faults.limit(10).collect()):
        raise ValueError(f"side tables do not match the main table: {[r.asDict() for r in samples]}")
    new = new_columns(main, sides, keys)
    merged = mask_extras(merge_side_tables(main, sides, keys), new, expected)
    return merged, missing_expected(merged, new, expected)


def overlaps(main: DataFrame, sides: list[DataFrame], keys: list[str] = KEYS) -> list[tuple[int, str]]:
    """(number of the side table, column) of columns that an earlier table has."""
    known, out = set(main.columns), []
    for n, side in enumerate(sides):
        out += [(n, c) for c in side.columns if c in known and c not in keys]
        known |= set(side.columns)
    return out


def key_agreement(main: DataFrame, side: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys that do not occur equally often in both tables, with both counts."""
    tag = lambda df, n: df.select(*keys, F.lit(n).alias("__side"))
    both = tag(main, 0).unionByName(tag(side, 1)).groupBy(*keys)
    return both.agg(F.count_if(F.col("__side") == 0).alias("n_main"), F.count_if(F.col("__side") == 1).alias("n_side")).where("n_main != n_side")


def mask_extras(df: DataFrame, columns: list[str], mask: Column) -> DataFrame:
    """Null outside the mask."""
    return df.withColumns({c: F.when(mask, F.col(c)) for c in columns})


def missing_expected(df: DataFrame, columns: list[str], mask: Column) -> DataFrame:
    """column_name, n_missing within the mask, in one pass."""
    counts = df.agg(*[F.count_if(mask & F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "n_missing")


def index_columns(df: DataFrame, prefix: str) -> DataFrame:
    """column_name, is_index of columns by prefix: are its values just 0..n-1 or 1..n, in any order.

    One aggregate finds the columns whose least, greatest and number of values allow that. Only for
    those, which are few, a bitmap of all values tells whether any is missing; 32,768 values share a
    bitmap, and tasks merge their bitmaps' bits before they are shuffled.
    """
    columns = [c for c in df.columns if c.startswith(prefix)]
    value = lambda c: F.col(c).try_cast("double")
    bounds = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.min(value(c)).alias("lo"), F.max(value(c)).alias("hi"), F.count_if(value(c) == F.floor(value(c))).alias("n")).alias(c) for c in columns]).first()
    n = bounds["n"]
    likely = [c for c in columns if n and bounds[c]["lo"] in (0, 1) and bounds[c]["hi"] - bounds[c]["lo"] == n - 1 and bounds[c]["n"] == n]
    out = [df.sparkSession.createDataFrame([(c, False) for c in columns if c not in likely], "column_name string, is_index boolean")]
    for c in likely:
        at = value(c).cast("long")
        bits = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        out.append(bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n")).select(F.lit(c).alias("column_name"), (F.col("n") == n).alias("is_index")))
    return reduce(DataFrame.union, out)


def drop_index_columns(df: DataFrame, prefix: str) -> DataFrame:
    """df without those columns; only their names pass through the driver."""
    if not any(c.startswith(prefix) for c in df.columns):
        return df
    return df.drop(*[r["column_name"] for r in index_columns(df, prefix).where("is_index").collect()])


def embeddings_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, source_col, vec (float32) of vector columns; null vectors stay as such."""
    return df.select(*keys, *[F.col(c).cast("array<float>").alias(c) for c in columns]).unpivot(keys, columns, "source_col", "vec")


def fill_stats(vectors: DataFrame) -> DataFrame:
    """source_col, n_rows, n_filled: vectors that are there with no value that is null or not a number."""
    whole = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    return vectors.groupBy("source_col").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("n_filled"))
