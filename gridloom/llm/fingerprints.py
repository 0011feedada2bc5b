"""SimHash fingerprints and permuted block tables, in DataFrame functions only.

A text's terms are its distinct words (split at white space, lower case), each
weighted by its length, so that words of few letters, which all texts share,
hardly vote. Bit j of the fingerprint is the weighted majority of bit j of the
terms' 64-bit hashes. Two bits are counted in one long: a text's weights sum to
less than 2**31, since no term weighs more than it has letters.

Fingerprints within ``radius`` bits are found in tables: the 64 bits are cut
into blocks, and for every choice of as many blocks as must agree, whatever
``radius`` bits differ, those blocks lead a permuted fingerprint and are the
key of a table. Only distinct fingerprints enter the tables.

Likeness is the cosine that the share of differing bits stands for, 0 from half
the bits on.

Neighbours in descending id are found in ranges of ids, each of which also gets
the first rows of the range after it, so that no window spans all rows and text
is shuffled once. Nulls: a null text is empty and has fingerprint 0; null ids
come last. Rows of equal id are ordered by the text's hash, then text. A single
row is its own neighbour. No rows give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.arrow import partitions, stored

LOWEST = -(2**63)
PAIR = (1 << 32) + 1  # two counters in a long
HALF = (1 << 32) - 1


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.lower(text), "\n\t\r\x0b\x0c", "     "), " "))


def weight(term: Column) -> Column:
    return F.least(F.greatest(F.length(term) - 2, F.lit(1)), F.lit(12)).cast("long")


def simhash(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and ``fingerprint`` (long) of each group of rows that share the keys; keys must tell texts apart."""
    words = df.select(*keys, F.explode(terms(F.col(text))).alias("t")).select(*keys, F.xxhash64("t").alias("h"), F.when(F.col("t") != "", weight(F.col("t"))).otherwise(F.lit(0).cast("long")).alias("w"))
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(PAIR)) * F.col("w")).alias(f"v{j}") for j in range(32)]
    counted = words.groupBy(*keys).agg(F.sum("w").alias("w"), *votes)

    def bit(count: Column, j: int) -> Column:
        return F.when(2 * count > F.col("w"), F.lit(1 << j if j < 63 else LOWEST)).otherwise(F.lit(0))

    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(f"v{j}", 32)
        out = out.bitwiseOR(bit(low, j)).bitwiseOR(bit(high, j + 32))
    return counted.select(*keys, out.alias("fingerprint"))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * differing(a, b) / 64))


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the tables: any two fingerprints within the radius agree under at least one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) - (1 << 64) if sum(c) >= 1 << 63 else sum(c) for c in combinations(masks, blocks - radius)]


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Distinct pairs (query, fingerprint) that differ in at most ``radius`` bits. Inputs: a column ``fingerprint`` each."""

    def tabled(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(block_tables(radius, blocks))])
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.explode(keys).alias("k")).select(name, "k.table", "k.key")

    near = tabled(queries, "query").join(tabled(fingerprints, "found"), ["table", "key"]).filter(differing(F.col("query"), F.col("found")) <= radius)
    return near.select("query", "found").distinct()


def neighbours(documents: DataFrame) -> DataFrame:
    """Rows in descending id, each with its successor: range, place, again, doc_id, text, n_chars, next (null for rows that only end a range).

    ``again`` marks the rows that a range gets from the one after it. An id (or null)
    that fills several ranges by itself is cut by its texts' hashes, the order inside it.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.lit(LOWEST))
    n = 4 * partitions(documents.sparkSession)
    edges = rows.select(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    full = {e: m for e, m in Counter(edges).items() if m > 1}  # ids that hold m - 1 ranges' rows and more
    edges = sorted(set(edges))
    # The count of edges below the id: first among every side-th edge, then in the stretch after it.
    held, side = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), max(1, int(len(edges) ** 0.5))
    below = lambda some: F.size(F.filter(some, lambda e: e < key))
    stretch = below(F.array(*[F.lit(e) for e in edges[side - 1 :: side]]).cast("array<bigint>"))
    range_ = stretch * side + below(F.slice(held, stretch * side + 1, F.lit(side))) if edges else F.lit(0)
    if full:
        # Inside such an id the lower hash comes first, so it has the higher number; the ids below it in its range have part 0.
        parts = F.create_map(*[F.lit(v).cast("long") for pair in full.items() for v in pair])[key]
        part = parts - F.least(parts - 1, F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts))
        range_ = range_ * (n + 1) + F.coalesce(part, F.lit(0)).cast("int")
    rows = rows.withColumn("range", range_)
    first = rows.groupBy("range").agg(F.max(F.struct(key.alias("k"), F.bitwise_not("h").alias("m"))).alias("f"))
    first = [(r["range"], r["f"]["k"], ~r["f"]["m"]) for r in first.orderBy("range").collect()]  # a row per range
    ghosts = []
    for i, (_, k, h) in enumerate(first):
        ghosts.append((first[i + 1][0] if i + 1 < len(first) else first[0][0], k, h))
    if not ghosts:
        return rows.withColumns({"again": F.lit(False), "place": F.lit(0), "n_chars": F.length("text"), "next": F.col("text")})
    spark = documents.sparkSession
    small = F.broadcast(spark.createDataFrame(ghosts, "range int, k long, h long"))  # a row per range
    again = rows.drop("range").withColumn("k", key).join(small, ["k", "h"]).select("doc_id", "text", "h", "range", F.lit(True).alias("again")).distinct()
    both = rows.select("doc_id", "text", "h", "range", F.lit(False).alias("again")).unionByName(again)
    order = W.partitionBy("range").orderBy("again", F.desc_nulls_last("doc_id"), "h", "text")
    return both.select("*", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("place"), F.length("text").cast("long").alias("n_chars"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its text with the last third replaced by its successor's beginning; their likeness, and that to the successor."""
    rows = neighbours(documents)
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left(F.coalesce("next", F.lit("")), cut))
    # Of a range's end only the first row counts, and of it only the text.
    texts = F.when(F.col("again"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))
    )
    sha = F.when(~F.col("again"), F.unhex(F.sha2(edited, 256)))
    keys = ["range", "place", "again", "doc_id", "n_chars", "sha"]
    split = rows.select("range", "place", "again", "doc_id", "n_chars", sha.alias("sha"), F.explode(texts).alias("x")).select(*keys, "x.kind", "x.t")
    prints = simhash(split, [*keys, "kind"], "t")
    both = prints.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited"))
    order = W.partitionBy("range").orderBy("place")
    done = both.select("*", F.lead("own").over(order).alias("next")).filter(~F.col("again"))
    return done.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "own", "edited", likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def fingerprinted(documents: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """``edited_fingerprints`` in hexadecimal, and for documents whose id is divisible by ``every``: n_near, the other documents within the radius."""
    rows = stored(edited_fingerprints(documents), "fingerprints")
    counts = rows.groupBy(F.col("own").alias("fingerprint")).agg(F.count("*").alias("n"))
    asked = F.col("doc_id") % every == 0
    pairs = within(rows.filter(asked).select(F.col("own").alias("fingerprint")), counts, radius)
    near = pairs.join(counts.withColumnRenamed("fingerprint", "found"), "found").groupBy(F.col("query").alias("own")).agg((F.sum("n") - 1).alias("n_near"))
    out = rows.join(near, "own", "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"), "near_edited", "near_next", F.when(asked, F.col("n_near")).alias("n_near"))
