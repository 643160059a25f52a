"""A band layout fed by streams of catalogue files."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.sphere import band_of
from ..operators.edges import check_survey_names
from ..sources.catalog import check_coordinates
from ..sources.shared import numbered
from ..sources.storage import file_names, read_text, write_text


def _progress(spark: SparkSession, directory: str, survey: str, before: int | None = None) -> dict[str, Any] | None:
    """What the last batch (below ``before``) recorded."""
    found = (re.fullmatch(re.escape(survey) + r"-(\d+)\.json", n) for n in file_names(spark, f"{directory}/_progress"))
    numbers = [int(m[1]) for m in found if m and (before is None or int(m[1]) < before)]
    return json.loads(read_text(spark, f"{directory}/_progress/{survey}-{max(numbers)}.json")) if numbers else None


def layout_writer(stream: DataFrame, directory: str, survey: str, *, band_height_deg: float, order: str) -> DataStreamWriter:
    """Append each micro-batch (``ra, dec`` and a column to order by) to a survey's bands.

    Rows are numbered in arrival order, on from the batches before.  A batch goes to a folder of its own
    and its end is recorded with its number, so a batch that is run again is written over, not twice.
    A coordinate that isn't finite or lies beyond a pole fails the batch before anything of it is written.
    ``finish_layout`` makes the folder a layout to build edges from.
    """
    if not band_height_deg > 0:
        raise ValueError("band_height_deg must be greater than 0")
    check_survey_names([survey])

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = (_progress(spark, directory, survey, number) or {"n_rows": 0})["n_rows"]
        # Stored once; the check and the layout read that.
        rows = numbered(batch, "row", order).select((F.col("row") + first).alias("row"), F.col("ra").cast("double"), F.col("dec").cast("double"))
        n = check_coordinates({survey: rows})[survey]
        rows = rows.withColumn("band", band_of(F.col("dec"), band_height_deg))
        rows.repartitionByRange("band", "row").sortWithinPartitions("band", "row").write.mode("overwrite").partitionBy("band").parquet(f"{directory}/{survey}/batch={number}")
        write_text(spark, f"{directory}/_progress/{survey}-{number}.json", json.dumps({"n_rows": first + n, "band_height_deg": band_height_deg}))

    return stream.writeStream.foreachBatch(append)


def finish_layout(spark: SparkSession, directory: str, surveys: Sequence[str]) -> None:
    """Write ``layout.json`` over all batches so far; a survey without any has no rows.  Can be repeated."""
    ends = {n: _progress(spark, directory, n) for n in surveys}
    heights = {e["band_height_deg"] for e in ends.values() if e}
    if len(heights) != 1:
        raise ValueError(f"the surveys of a layout must share one band height, not {sorted(heights)}")
    write_text(spark, f"{directory}/layout.json", json.dumps({"band_height_deg": heights.pop(), "surveys": [{"name": n, "n_rows": e["n_rows"] if e else 0} for n, e in ends.items()]}))
