"""Change capture from the stored tables themselves: two versions, compared.

A version is a folder of rows by creation month, each row with a 128-bit digest
of its columns, and one digest row per month (count and sums of the rows'
digests, so it does not depend on the rows' order). Comparing two versions reads
the month digests first and then only the months that differ, of which only
keys and digests are joined:

    path/version=<n>/rows/created_month=<yyyy-MM or none>/...
    path/version=<n>/months/...                     (written last)

The result has one row per changed key: INSERT, UPDATE or DELETE with the key
columns and what a listener needs to fetch the row, as the tables' own change
notices have them. Rows of one key are expected once per version; a key that
occurs more often is compared as the set of its rows (digests summed), so a
repeated row is a change as well. Rows with a null key are left out: nothing
could be fetched for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "created_month"
DIGESTS = ["digest_a", "digest_b"]


def row_digests(columns: list[str]) -> list[Column]:
    """Two 64-bit digests of a row; nulls count by position."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(1), *parts).alias("digest_a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("digest_b")]


def _summed(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(38,0)")).alias(c)


def write_version(rows: DataFrame, path: str, version: int, time: str = "created_at") -> None:
    """Store ``rows`` as a version. A version without its months is incomplete; writing it again replaces it."""
    spark, folder = rows.sparkSession, f"{path}/version={version}"
    columns = rows.columns
    month = F.coalesce(F.date_format(F.col(time), "yyyy-MM"), F.lit("none"))
    marked = rows.select("*", *row_digests(columns)).repartitionByRange(time).sortWithinPartitions(time)
    marked.withColumn(MONTH, month).write.mode("overwrite").partitionBy(MONTH).parquet(f"{folder}/rows")
    stored = _rows(spark, path, version, [])
    stored.groupBy(MONTH).agg(F.count("*").alias("n"), *[_summed(c) for c in DIGESTS]).write.mode("overwrite").parquet(f"{folder}/months")


def _rows(spark: SparkSession, path: str, version: int, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Digests, month and the named columns of a version."""
    fields = [f"`{c}` {(types or {}).get(c, 'string')}" for c in columns] + [f"{c} bigint" for c in DIGESTS] + [f"{MONTH} string"]
    return spark.read.schema(", ".join(fields)).parquet(f"{path}/version={version}/rows")


def changed_months(spark: SparkSession, path: str, old: int, new: int) -> list[str]:
    """Months whose rows differ: at most one name per month of the tables' time span."""
    def months(version: int, name: str) -> DataFrame:
        kept = spark.read.schema(f"{MONTH} string, n bigint, digest_a decimal(38,0), digest_b decimal(38,0)").parquet(f"{path}/version={version}/months")
        return kept.select(MONTH, F.struct("n", *DIGESTS).alias(name))

    both = months(old, "before").join(months(new, "after"), MONTH, "full")
    return sorted(r[0] for r in both.where(~F.col("before").eqNullSafe(F.col("after"))).select(MONTH).collect())


def capture_changes(spark: SparkSession, path: str, old: int, new: int, key: str = "id", key_type: str = "string",
                    carry: dict[str, str] | None = None) -> DataFrame:
    """(operation, key, *carry) of every key whose rows differ between two stored versions.

    ``carry``: further columns with their types, from the new row or, for a
    DELETE, from the old one.
    """
    carry = carry or {}
    months = changed_months(spark, path, old, new)

    def side(version: int, name: str) -> DataFrame:
        rows = _rows(spark, path, version, [key, *carry], {key: key_type, **carry}).where(F.col(MONTH).isin(months) & F.col(key).isNotNull())
        return rows.groupBy(key).agg(F.struct(F.count("*").alias("n"), *[_summed(c) for c in DIGESTS], *[F.max(c).alias(c) for c in carry]).alias(name))

    both = side(old, "before").join(side(new, "after"), key, "full")
    same = F.lit(True)
    for c in ("n", *DIGESTS):
        same &= F.col(f"before.{c}") == F.col(f"after.{c}")
    operation = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").when(~same, "UPDATE")
    found = both.withColumn("operation", operation).where(F.col("operation").isNotNull())
    return found.select("operation", key, *[F.when(F.col("after").isNull(), F.col(f"before.{c}")).otherwise(F.col(f"after.{c}")).alias(c) for c in carry])


def land_changes(changes: DataFrame, path: str, version: int) -> str:
    """Write the changes that led to ``version`` where a stream of changes reads them.

    ``seq`` grows with the version and is unique; as many files as the
    comparison had tasks. Landing a version again replaces it.
    """
    at = F.lit(version).cast("bigint") * F.lit(1 << 44) + F.monotonically_increasing_id() % F.lit(1 << 44)
    changes.select(at.alias("seq"), "*").write.mode("overwrite").parquet(f"{path}/version={version}")
    return path
