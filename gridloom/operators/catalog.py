"""File manifest, table catalog and schema audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators.blocks import previous_value
from gridloom.operators.grid import TABLE

PENDING, SCANNED, INGESTED, ERROR = "pending", "scanned", "ingested", "error"
_BUCKETS = 1 << 16


def refresh(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Upsert a listing (``name, path, mtime, size``) by path.

    New files are pending; known ones take the new time and size, and are
    pending again only if the time changed. Files not listed stay as they are.
    """
    old, new = manifest.alias("o"), listing.alias("n")
    both = old.join(new, F.col("o.path") == F.col("n.path"), "full_outer")
    seen = F.col("n.path").isNotNull()
    merged = both.select(
        F.col("o.file_id").alias("file_id"),
        F.coalesce("o.name", "n.name").alias("name"),
        F.coalesce("o.path", "n.path").alias("path"),
        F.when(seen, F.col("n.mtime")).otherwise(F.col("o.mtime")).alias("mtime"),
        F.when(seen, F.col("n.size")).otherwise(F.col("o.size")).alias("size"),
        F.when(F.col("o.path").isNull() | (seen & ~F.col("o.mtime").eqNullSafe(F.col("n.mtime"))), PENDING)
        .otherwise(F.col("o.status"))
        .alias("status"),
    )
    return _with_ids(merged)


def _with_ids(files: DataFrame) -> DataFrame:
    """Fill missing file ids: unique numbers, counted inside 65,536 hash buckets of the path."""
    bucket = F.when(F.col("file_id").isNull(), F.pmod(F.xxhash64("path"), F.lit(_BUCKETS))).otherwise(
        F.pmod(F.col("file_id"), F.lit(_BUCKETS))
    )
    files = files.withColumn("_b", bucket)
    used = F.coalesce(F.max(F.floor(F.col("file_id") / _BUCKETS)).over(Window.partitionBy("_b")), F.lit(0))
    order = Window.partitionBy("_b", F.col("file_id").isNull()).orderBy("path")
    fresh = (used + F.row_number().over(order)) * _BUCKETS + F.col("_b")
    return files.withColumn("file_id", F.coalesce("file_id", fresh)).drop("_b")


def with_status(manifest: DataFrame, statuses: Sequence[str] = (PENDING,)) -> DataFrame:
    return manifest.filter(F.col("status").isin(*statuses)).orderBy("file_id")


def set_status(manifest: DataFrame, outcome: DataFrame) -> DataFrame:
    """Take the run's status per file (``file_id, status``); other files keep theirs."""
    run = outcome.select("file_id", F.col("status").alias("_new"))
    return manifest.join(run, "file_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def upsert_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones of the same (file, table)."""
    return old.join(new.select(*TABLE), TABLE, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Headers by (file, table, schema): a superseded header stays, with ``is_current`` false, and rows of its time can be named by it."""
    key = [*TABLE, "schema_hash"]
    kept = old.join(new.select(*key), key, "left_anti").join(new.select(*TABLE).distinct().withColumn("_new", F.lit(True)), TABLE, "left")
    kept = kept.withColumn("is_current", F.when(F.col("_new"), F.lit(False)).otherwise(F.coalesce("is_current", F.lit(True)) if "is_current" in old.columns else F.lit(True)))
    return kept.drop("_new").unionByName(new.withColumn("is_current", F.lit(True)), allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Audit rows where a known table's hash differs: columns added and removed (both may be empty)."""
    before = old.select(*TABLE, F.col("schema_hash").alias("old_hash"), F.col("header").alias("_old"))
    after = new.select(*TABLE, F.col("schema_hash").alias("new_hash"), F.col("header").alias("_new"))
    return _audit(after.join(before, TABLE))


def history_changes(versions: DataFrame, version: str) -> DataFrame:
    """Audit rows of a whole history: every version (an integer) against the one before it."""
    state = versions.select(
        *TABLE, version, "schema_hash", "header", F.struct(F.col("schema_hash").alias("h"), F.col("header").alias("c")).alias("_s")
    )
    seen = previous_value(state, TABLE, version, "_s", "_p").select(
        *TABLE, version, F.col("schema_hash").alias("new_hash"), F.col("header").alias("_new"),
        F.col("_p.h").alias("old_hash"), F.col("_p.c").alias("_old"),
    )
    return _audit(seen)


def _audit(pairs: DataFrame) -> DataFrame:
    keep = [c for c in pairs.columns if c not in ("_old", "_new")]
    return pairs.filter("old_hash is not null and old_hash <> new_hash").select(
        *keep, F.array_except("_new", "_old").alias("added"), F.array_except("_old", "_new").alias("removed")
    )


def latest_changes(audit: DataFrame, tables: DataFrame, manifest: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The newest changes with their counts of added and removed columns."""
    named = audit.join(tables.select(*TABLE), TABLE).join(manifest.select("file_id", "name"), "file_id")
    return (
        named.orderBy(F.desc(order), "file_id", "table_name")
        .limit(n)
        .select("name", "table_name", order, F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))
    )


def schema_listing(tables: DataFrame, manifest: DataFrame, order: str, distinct: bool = False) -> DataFrame:
    """Known schemas, newest first: hash, file, table, rows."""
    listed = tables.filter("schema_hash is not null").join(manifest.select("file_id", "name"), "file_id")
    rows = listed.select("schema_hash", "name", "table_name", "n_rows", order)
    return (rows.distinct() if distinct else rows).orderBy(F.desc(order), "name", "table_name")


def tables_of_file(tables: DataFrame, file_id: int) -> DataFrame:
    return tables.filter(F.col("file_id") == file_id)
