"""Plans of what a snapshot's writing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k, action, v) of two tables of key k and value v: insert, update, same, or keep what the new snapshot lacks."""
    o, n = old.select("k", F.col("v").alias("_old"), F.lit(True).alias("_o")), new.select("k", F.col("v").alias("_new"), F.lit(True).alias("_n"))
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "keep").when(F.col("_old") != F.col("_new"), "update").otherwise("same")
    return o.join(n, "k", "full").select("k", action.alias("action"), F.coalesce("_new", "_old").alias("v"))


def rebuilt_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table ``name`` built anew as a whole: at ``path`` its files are replaced in one commit, else it is a view that is defined anew."""
    if path:
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
