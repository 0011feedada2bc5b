"""Health of the layers: diagnosis, de-duplication, retention, purge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gridloom.operators.blocks import first_rows
from gridloom.operators.grid import TABLE
from gridloom.session import shared_folder

FACT_KEY = ["file_id", "date_key", "column_key", "schema_hash", "sheet", "line_no"]
KEEP_AUDIT = 50
#: Hashes of repeated keys that are sent to every task at most; beyond it whole rows are grouped.
SENT = 4_000_000
#: Facts to a task that counts keys: each is held unpacked, with its key.
COUNTED = 1 << 19
#: Tasks that the facts of a key, or the rows of a schema, are dealt to at most.
WAYS = 256


def _of_schemas(raw: DataFrame, fact: DataFrame, how: str) -> DataFrame:
    """Rows with (or without) a schema that has facts. A schema may hold all rows, so they meet copies of its hash in ``WAYS`` tasks."""
    place = [c for c in (*TABLE, "sheet", "line_no") if c in raw.columns]
    known = fact.select("schema_hash").distinct().withColumn("_way", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(WAYS - 1).cast("bigint"))))
    return raw.withColumn("_way", F.pmod(F.xxhash64(*place), F.lit(WAYS).cast("bigint"))).join(known, ["schema_hash", "_way"], how).drop("_way")


def transformed(raw: DataFrame, fact: DataFrame) -> DataFrame:
    """Raw rows whose schema already has facts."""
    return _of_schemas(raw, fact, "left_semi")


def purge(raw: DataFrame, fact: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Raw rows that remain after the transformed ones are dropped."""
    return raw if keep_raw else _of_schemas(raw, fact, "left_anti")


def duplicate_groups(fact: DataFrame) -> DataFrame:
    """Keys with more than one fact; null dates group together.

    Nearly all keys differ, so an aggregate before the shuffle would hold a whole
    split of the file. Facts are dealt by key first, to as many tasks as they ask
    for; those of one key come from many splits and go to ``WAYS`` tasks.
    """
    rest = [c for c in fact.columns if c not in FACT_KEY]
    way = F.pmod(F.xxhash64(F.spark_partition_id(), *rest), F.lit(WAYS)).alias("_way")
    tasks = fact.count() // COUNTED + 1
    part = fact.select(*FACT_KEY, way).repartition(tasks, *FACT_KEY, "_way").groupBy(*FACT_KEY, "_way").agg(F.count("*").alias("n"))
    return part.repartition(tasks, *FACT_KEY).groupBy(*FACT_KEY).agg(F.sum("n").alias("n")).filter("n > 1")


def _first_of_key(fact: DataFrame) -> DataFrame:
    """A minimum combines on the map side, so even a key with a third of all copies never gathers in one task, as it would under a window."""
    rest = ["load_no", "value_num", "value_text", "value_date"]
    return fact.groupBy(*FACT_KEY).agg(F.min(F.struct(*rest)).alias("_first")).select(
        *[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in fact.columns]
    )


def dedupe(fact: DataFrame, sent: int = SENT) -> DataFrame:
    """Keep the earliest fact of each key (value not part of it).

    First only the keys' hashes are counted, a hash aggregate over eight bytes a
    row. Rows whose hash occurs once are surely single and stay where they are;
    the others are grouped whole, so two keys that share a hash do no harm. Hashes
    that occur more often are written and counted: up to ``sent`` of them go to
    every task, with more all rows are grouped. The result is the same.
    """
    spark = fact.sparkSession
    hashed = fact.withColumn("_key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in FACT_KEY]))
    path = shared_folder(spark, "repeated")
    hashed.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key").write.parquet(path)
    repeated = spark.read.schema("_key bigint").parquet(path)
    if repeated.count() > sent:
        return _first_of_key(fact)
    few = F.broadcast(repeated)  # ``sent`` rows at most
    single = hashed.join(few, "_key", "left_anti").select(*fact.columns)
    return single.unionByName(_first_of_key(hashed.join(few, "_key", "left_semi").select(*fact.columns)))


def retain(audit: DataFrame, order: list[Column], keep: int = KEEP_AUDIT, keys: list[str] = TABLE, spread: list[str] | None = None) -> DataFrame:
    """The first ``keep`` rows of each table in ``order`` (newest first)."""
    return first_rows(audit, keys, order, keep, spread or audit.columns, "_rank").drop("_rank")


def _count(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "n")


def _one_row(counts: list[DataFrame], names: list[str]) -> DataFrame:
    together = counts[0]
    for other in counts[1:]:
        together = together.unionByName(other)
    return together.agg(*[F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in names])


def diagnostic(raw: DataFrame, audit: DataFrame, fact: DataFrame) -> DataFrame:
    """What could be cleaned: transformed raw rows, audit rows, duplicate groups."""
    names = ["raw_transformed", "audit_total", "duplicates"]
    parts = [transformed(raw, fact), audit, duplicate_groups(fact)]
    return _one_row([_count(p, m) for p, m in zip(parts, names)], names)


def stats(raw: DataFrame, audit: DataFrame, fact: DataFrame, keep_raw: bool = False, keep: int = KEEP_AUDIT) -> DataFrame:
    """Rows each cleaning step removes, from aggregates alone: no layer is ordered or rewritten for it."""
    per_table = audit.groupBy(*TABLE).agg(F.count("*").alias("n"))
    surplus = per_table.agg(F.coalesce(F.sum(F.greatest(F.col("n") - keep, F.lit(0))), F.lit(0)).alias("n"))
    copies = duplicate_groups(fact).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    gone = _count(transformed(raw, fact) if not keep_raw else raw.limit(0), "removed_raw")
    names = ["removed_raw", "removed_audit", "removed_duplicates"]
    return _one_row(
        [
            gone,
            surplus.select(F.lit("removed_audit").alias("metric"), "n"),
            copies.select(F.lit("removed_duplicates").alias("metric"), "n"),
        ],
        names,
    )


def clean(
    raw: DataFrame, audit: DataFrame, fact: DataFrame, path: str, order: list[Column],
    keep_raw: bool = False, keep: int = KEEP_AUDIT, spread: list[str] | None = None,
) -> DataFrame:
    """Purge, retain and dedupe in one run: writes the layers anew below ``path`` (``raw``, ``audit``, ``fact``); returns ``stats`` of it.

    What stays is counted by the tasks that write it (an ``Observation`` on the
    last stage, where a repeated task counts once); what was there is the layer's
    own count, which Parquet keeps in its footers. A layer that is written in place of
    the old one is the caller's rename: nothing here touches the input.
    """
    steps = {
        "raw": (raw, purge(raw, fact, keep_raw)),
        "audit": (audit, retain(audit, order, keep, spread=spread)),
        "fact": (fact, dedupe(fact)),
    }
    removed = {}
    for name, (before, after) in steps.items():
        seen = Observation(name)
        after.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/{name}")
        removed[name] = before.count() - (seen.get.get("n") or 0)
    row = (removed["raw"], removed["audit"], removed["fact"])
    return raw.sparkSession.createDataFrame([row], "removed_raw bigint, removed_audit bigint, removed_duplicates bigint")
