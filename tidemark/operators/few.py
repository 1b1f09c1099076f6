"""Tables that are expected to be few rows, met by every row of another as lists; the number of rows is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a list, at most.
MOST = 256


def listed(few: DataFrame, name: str, most: int = MOST) -> DataFrame | None:
    """One row with all rows of `few` as an array of structs; None where there are more than `most`. Reads at most one row more."""
    rows = few.limit(most + 1).collect()  # bounded
    if len(rows) > most:
        return None
    return few.sparkSession.createDataFrame(rows, few.schema).agg(F.array_agg(F.struct(*few.columns)).alias(name))


def with_lists(rows: DataFrame, few: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """rows with the array `name` of the rows of `few`: once where these are at most `most`, else once for each list of about so many.

    The lists together hold every row of `few` once. Few rows go to each task in one broadcast row; more are dealt to lists by hash, which
    meet the rows by the list's number, so that a task holds a list and never the whole table.
    """
    one = listed(few, name, most)
    if one is not None:
        return rows.crossJoin(F.broadcast(one))  # one row
    lists = -(-few.count() // most)
    packed = few.groupBy(F.pmod(F.xxhash64(*few.columns), F.lit(lists)).alias("_list")).agg(F.array_agg(F.struct(*few.columns)).alias(name))  # about `most` rows
    return rows.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long")))).join(packed, "_list").drop("_list")
