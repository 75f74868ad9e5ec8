"""Python over batches of rows, with whole numbers kept whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def whole_frame(batch: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """A batch as a frame; columns of whole numbers with nulls come as nullable integers, where pandas would take floats."""
    frame = batch.to_pandas()
    for column, values in zip(batch.schema.names, batch.columns, strict=True):
        if values.null_count and pa.types.is_integer(values.type):
            frame[column] = pd.array(values.to_pylist(), "Int64")
    return frame


def plain_rows(frame: pd.DataFrame) -> list[dict]:
    """The rows as dictionaries of Python values, None for null; a null is never a float beside whole numbers."""
    columns = [[None if missing else value for value, missing in zip(frame[c].tolist(), frame[c].isna().tolist(), strict=True)] for c in frame.columns]
    return [dict(zip(frame.columns, row, strict=True)) for row in zip(*columns, strict=True)]


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """As mapInPandas, but ids above 2^53 stay what they are in columns that hold nulls.

    Results are cast to the schema from Arrow's side; columns that a result leaves out are null.
    """
    wanted = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(whole_frame(batch) for batch in batches):
            frame = frame.assign(**{name: None for name in wanted.names if name not in frame})
            yield pa.RecordBatch.from_pandas(frame, wanted, preserve_index=False)

    return df.mapInArrow(mapped, schema)
