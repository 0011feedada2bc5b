"""N-gram Jaccard join: documents whose sets of word shingles are alike, by T-occurrence search.

Two documents link when their sets' intersection is at least ``percent`` of
their union. The components of these links are
exact, in these steps; no step sees all pairs of a group:

1. Sets. Each text's distinct shingles; documents of equal sets form a *class*.
   The same pass fills a fixed-size sketch of how often shingles occur, which
   gives one global order: rare shingles first, then by hash.
2. Short lists. Linked sets share a shingle of their prefixes in that order, so
   prefixes alone are dealt out, packed in numpy by buckets of shingles. Frequent
   shingles' lists are spread over several buckets.
3. Pairs from the lists: short lists give all pairs whose sizes and positions in
   the prefixes allow a link; each longer list joins its members to one of them.
   Whatever these links leave apart is then paired across: with a few members of
   each component first, and at last with all that still are apart. Members
   carry a folded bitmap, so pairs that it rules out are never made.
4. Bounds. Each class has a parity bitmap; bits in which two differ bound the
   sets' difference from below and drop most pairs.
5. Search. Sets of the remaining pairs meet in blocks of one query and a bounded
   number of others; only the documents that stand for a wanted class are cut into
   shingles again. A block has inverted lists of its sets; the query merges its
   short lists by counting and probes its long ones by binary search (DivideSkip),
   and keeps those that reach the overlap they need.
6. Links join classes to components by hooking and contraction.

Exact are the components. Links inside one aren't enumerated: once members of a
list are joined, their other pairs are never tested, so there are neither pairs
nor counts of links to read off. Candidates come from prefix lists, stars in
them and bitmaps; DivideSkip judges only those that are left.

Nulls: a null text has no words; documents without words link with nothing and
are their own component. Rows with a null id take part; a component's id is the
smallest id that is not null. Repeated rows are in one class. No rows give no
rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import blocks, partitions, stored, text_of
from gridloom.llm.words import GRAPHIC, mix, shingles, words

READ = 1 << 19  # bytes of text that are cut into shingles at a time
SKETCH = 1 << 23  # counters; a fixed size
PIECE = 1 << 17  # counters in a row of the sketch
TOLD = 500_000  # pairs that a task remembers, so as not to name them again
SALTS = 8  # buckets that a frequent shingle's list is spread over
BUCKET = 2_000_000  # prefix entries that a bucket should hold
DIRECT = 8  # lists of so many members give their pairs at once
CHUNK = 2_000  # members in a row of a list
ADDED = 1 << 20  # shingles that are counted in the sketch at a time
CROSSED = 1 << 18  # pairs of list members that a task looks at a time
BLOCK = 255  # sets that a query meets at a time
PARTNERS = 4  # of a component, that one member meets before it meets the rest
BRIEF = 64  # bytes of the folded bitmaps that list members carry
WANTED = 1 << 24  # bits that tell which documents' sets to send
MU = 0.02  # DivideSkip's weight of a probe against a merge
U = np.uint64


def sets(block: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Row, set (in ascending order) and signature of each text with words."""
    row, h = shingles(words(text_of(block.column("text")), GRAPHIC), size)
    at = np.searchsorted(row, np.arange(block.num_rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, at = h[new], np.append(0, np.cumsum(new))[at].tolist()
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if a < b:
            yield i, h[a:b], hashlib.blake2b(h[a:b], digest_size=16).digest()


def class_of(signature: bytes) -> int:
    return int.from_bytes(signature[:8], "little", signed=True)


def parity(own: np.ndarray) -> bytes:
    """Bit j: whether an odd number of shingles falls on it. About a bit for each shingle, 8 * BRIEF at least."""
    bits = max((8 * BRIEF - 1).bit_length(), int(len(own) - 1).bit_length())
    count = np.bincount((own & U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """At least so many shingles are in one set only, for each pair of bitmaps. The larger is folded to the smaller's size."""
    out, sizes = np.zeros(len(a), np.int64), np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == (m, n)).all(axis=1))
        x, y = (np.frombuffer(b"".join([v[r] for r in rows]), np.uint8).reshape(len(rows), -1) for v in (a, b))
        x, y = (np.bitwise_xor.reduce(v.reshape(len(rows), -1, min(m, n)), axis=1) for v in (x, y))
        out[rows] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in one set only, at most, of linked sets with so many together."""
    return total - 2 * -(-percent * total // (100 + percent))


def briefs(known: DataFrame) -> DataFrame:
    """cls and its bitmap folded to BRIEF bytes: a bound of the same kind, weaker for large sets, of one size for all."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "brief": [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, BRIEF), axis=0).tobytes() for x in b["bitmap"]]})

    return known.select("cls", "bitmap").mapInPandas(fold, "cls long, brief binary")


def needed(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def counted(sketch: np.ndarray, at: np.ndarray) -> None:
    """Adds one to a counter for each time it is named, up to 255; in the counters' order, which memory likes better."""
    at.sort()
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    at, times = at[first], np.diff(np.append(first, len(at)))
    sketch[at] = np.minimum(sketch[at] + times, 255)


def classes(documents: DataFrame, size: int) -> DataFrame:
    """kind 0: a row per document (doc_id, hash of its text, n, signature, cls, bitmap of the task's first document of a class); kind 1: pieces of the task's sketch, cls being the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, made, held = np.zeros(SKETCH, "u1"), [], 0
        for block in blocks(batches, "text", READ):
            n, signature, cls, bitmap = ([None] * block.num_rows for _ in range(4))
            n = [0] * block.num_rows
            for i, own, sig in sets(block, size):
                n[i], signature[i], cls[i], bitmap[i] = len(own), sig, class_of(sig), parity(own)
                made.append((own % U(SKETCH)).astype("<u4"))
                held += len(own)
            if held >= ADDED:
                counted(sketch, np.concatenate(made))
                made, held = [], 0
            k = block.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), block.column("doc_id"), block.column("text_hash"), pa.array(n, pa.int64()), pa.array(signature, pa.binary()), pa.array(cls, pa.int64()), pa.array(bitmap, pa.binary())], names)
        if made:
            counted(sketch, np.concatenate(made))
        if sketch.any():
            parts = [sketch[i : i + PIECE].tobytes() for i in range(0, SKETCH, PIECE)]
            k = len(parts)
            none, task = pa.array([None] * k, pa.int64()), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none, none, pa.array(np.arange(k)), pa.array(parts, pa.binary()), pa.array(np.full(k, task)), pa.array([None] * k, pa.binary())], names)

    names = ["kind", "doc_id", "text_hash", "n", "signature", "cls", "bitmap"]
    return texts(documents).mapInArrow(run, "kind int, doc_id long, text_hash long, n long, signature binary, cls long, bitmap binary")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (piece, way) added up, of rows sorted by both: one piece is held at a time."""

    def out(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([int(total.sum())]), pa.array([np.minimum(total, 2**31 - 1).astype("<u4").tobytes()], pa.binary())], ["piece", "way", "total", "counts"])

    now, total = None, np.zeros(PIECE, np.int64)
    for batch in batches:
        for i, key in enumerate(zip(batch.column("piece").to_pylist(), batch.column("way").to_pylist())):
            if now not in (None, key):
                yield out(now, total)
                total[:] = 0
            now, own = key, batch.column("counts")[i].as_buffer()
            total += np.frombuffer(own, "u1" if own.size == PIECE else "<u4")
    if now is not None:
        yield out(now, total)


def frequent(table: DataFrame) -> np.ndarray:
    """Bits of the sketch whose count stands out, as one packed bitmap of fixed size.

    Every task has its own sketch: they are added in as many streams a piece as each stream has sketches, then those streams.
    """
    spark = table.sparkSession
    ways = math.isqrt((table.filter("kind = 1").agg(F.max("cls")).first()[0] or 0) + 1)
    added = table.filter("kind = 1").select(F.col("n").alias("piece"), F.pmod("cls", F.lit(ways)).alias("way"), F.lit(0).cast("long").alias("total"), F.col("signature").alias("counts"))
    for way in ("way", F.lit(0).cast("long").alias("way")):
        some = added.select("piece", way, "counts").repartition(partitions(spark), "piece", "way").sortWithinPartitions("piece", "way")
        added = some.mapInArrow(summed, "piece long, way long, total long, counts binary")
    added = stored(added, "sketch")
    mean = (added.agg(F.sum("total")).first()[0] or 0) / SKETCH
    limit = mean + 8 * math.sqrt(mean) + 10

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(np.frombuffer(c.as_buffer(), "<u4") > limit, bitorder="little").tobytes() for c in b.column(1)], pa.binary())], ["piece", "bits"])

    out = np.zeros(SKETCH // 8, np.uint8)
    for r in added.select("piece", "counts").mapInArrow(bits, "piece long, bits binary").collect():  # SKETCH bits in all
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def stands_out(h: np.ndarray, flags: np.ndarray) -> np.ndarray:
    at = h % U(SKETCH)
    return (flags[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1) > 0


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def lists(documents: DataFrame, often, buckets: int, size: int, percent: int) -> DataFrame:
    """bucket, and packed prefix entries: per class its id, size and number of entries; per entry shingle (32 bits) and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, held, seen, count = often.value, [], set(), 0

        def flush() -> pa.RecordBatch:
            h, cls, n, pos = (np.concatenate(c) for c in zip(*held))
            base = ((h >> U(32)) % U(buckets)).astype(np.int64)
            hot = stands_out(h, flags)
            bucket = base * (SALTS + 1) + np.where(hot, 1 + (cls.view(U) % U(SALTS)).astype(np.int64), 0)
            order = np.argsort(bucket, kind="stable")
            bucket, h, cls, n, pos = (v[order] for v in (bucket, h.astype("<u4"), cls, n, pos))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first[1:], len(bucket))
            rows = []
            for a, b in zip(first, ends):
                new = np.flatnonzero(np.append(True, cls[a:b][1:] != cls[a:b][:-1]))
                rows.append((int(bucket[a]), cls[a:b][new].tobytes(), n[a:b][new].tobytes(), np.diff(np.append(new, b - a)).astype("<i4").tobytes(), h[a:b].tobytes(), pos[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], ["bucket", "cls", "n", "entries", "h", "pos"])

        for block in blocks(batches, "text", READ):
            for _, own, sig in sets(block, size):
                if sig in seen:
                    continue
                seen.add(sig)
                n = len(own)
                k = prefix_length(n, percent)
                front = own[:k]
                if stands_out(front, flags).any():
                    hot = stands_out(own, flags)
                    front = np.concatenate([own[~hot], own[hot]])[:k]
                held.append((front, np.full(k, class_of(sig)), np.full(k, n, "<i4"), np.arange(k, dtype="<i4")))
                count += k
                if count >= READ:
                    yield flush()
                    held, count = [], 0
                    seen = seen if len(seen) < 50_000 else set()
        if held:
            yield flush()

    return documents.select("text").mapInArrow(run, "bucket long, cls binary, n binary, entries binary, h binary, pos binary")


MEMBERS = "list long, whole boolean, cls array<long>, n array<int>, pos array<int>, other array<long>"


def may_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m with a first common shingle at i and j can share enough."""
    return (100 + percent) * np.minimum(n - i, m - j).astype(np.int64) >= percent * (n.astype(np.int64) + m)


def members(packed: DataFrame, percent: int) -> DataFrame:
    """Lists of more than DIRECT members and all parts of spread ones, in rows of bounded size; pairs of shorter lists (cls, other), without a list."""

    def unpack(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        read = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
        entries = read("entries", "<i4")
        cls, n = np.repeat(read("cls", "<i8"), entries), np.repeat(read("n", "<i4"), entries)
        h, pos = read("h", "<u4"), read("pos", "<i4")
        base, salt = divmod(bucket, SALTS + 1)
        order = h.astype(np.uint64) << U(32) | np.arange(len(h), dtype=np.uint64)  # fewer than 2**32 entries: a bucket holds some BUCKET
        order.sort()
        h, order = (order >> U(32)).astype("<u4"), (order & U(0xFFFFFFFF)).astype(np.int64)
        if not salt:  # shingles of one entry give no list
            same = h[1:] == h[:-1]
            more = np.append(same, False) | np.append(False, same)
            h, order = h[more], order[more]
        cls, n, pos = cls[order], n[order], pos[order]
        order = np.lexsort((cls, h))
        h, cls, n, pos = h[order], cls[order], n[order], pos[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n, pos = h[keep], cls[keep], n[keep], pos[keep]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        size = np.diff(np.append(first, len(h)))
        rows, known = [], {}
        found = [np.zeros((0, 2), np.int64)]
        for k in range(2, 1 + DIRECT if not salt else 2):
            own = first[size == k]
            x, y = (own[:, None] + i for i in np.triu_indices(k, 1))
            x, y = x.ravel(), y.ravel()
            fits = may_link(n[x], pos[x], n[y], pos[y], percent)
            found.append(np.unique(np.column_stack([cls[x[fits]], cls[y[fits]]]), axis=0))
        found = np.unique(np.concatenate(found), axis=0)
        for i in range(0, len(found), CHUNK):
            rows.append((None, True, found[i : i + CHUNK, 0], [], [], found[i : i + CHUNK, 1]))
        many = size >= (1 if salt else DIRECT + 1)
        for a, k in zip(first[many].tolist(), size[many].tolist()):
            same = cls[a : a + k].tobytes()
            if not salt and k <= CHUNK:
                if same in known:  # equal lists: the earliest positions allow whatever any of them allows
                    np.minimum(known[same], pos[a : a + k], out=known[same])
                    continue
                known[same] = pos[a : a + k].copy()
                rows.append((base << 32 | int(h[a]), True, cls[a : a + k], n[a : a + k], known[same], []))
            else:
                rows.extend((base << 32 | int(h[a]), False, cls[i : min(i + CHUNK, a + k)], n[i : min(i + CHUNK, a + k)], pos[i : min(i + CHUNK, a + k)], []) for i in range(a, a + k, CHUNK))
        return pd.DataFrame(rows, columns=["list", "whole", "cls", "n", "pos", "other"])

    return packed.groupBy("bucket").applyInPandas(unpack, MEMBERS)


def first_pairs(table: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b: those of short lists, and each longer list's members with its smallest."""
    two = table.filter("list is null").select(F.explode(F.arrays_zip("cls", "other")).alias("p")).select(F.col("p.cls").alias("a"), F.col("p.other").alias("b"))
    some = table.filter("list is not null")
    head = F.struct(F.col("cls")[0].alias("cls"), F.col("n")[0].alias("n"))
    parts = some.filter("not whole")
    heads = parts.groupBy("list").agg(F.min(head).alias("head"))
    all_ = some.filter("whole").withColumn("head", head).select("head", "cls", "n").unionByName(parts.join(heads, "list").select("head", "cls", "n"))
    star = all_.select("head", F.explode(F.arrays_zip("cls", "n")).alias("m")).filter("m.cls != head.cls")
    small, large = F.least("m.n", "head.n"), F.greatest("m.n", "head.n")
    star = star.filter(100 * small >= percent * large).select(F.col("head.cls").alias("a"), F.col("m.cls").alias("b"))
    return two.unionByName(star).distinct()


def later_pairs(table: DataFrame, components: DataFrame, known: DataFrame, before: DataFrame, percent: int, partners: int | None, part: int = 1000) -> DataFrame:
    """Distinct pairs of members of one list that no link has joined yet, where sizes, positions and folded bitmaps allow a link.

    partners: of each component that a list holds apart, a member outside it
    meets so many at first; None for all.
    """
    each = table.filter("list is not null").select("list", F.explode(F.arrays_zip("cls", "n", "pos")).alias("m")).select("list", "m.cls", "m.n", "m.pos")
    each = each.join(components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    split = each.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k")).filter("lo != hi").select("list", F.ceil(F.col("k") / part).cast("int").alias("parts"))
    open_ = each.join(split, "list").join(briefs(known), "cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # Parts i and j of a list meet in the group (i, j).
    spread = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    spread = spread.select("list", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "cls", "n", "pos", "component", "brief")

    keys = ["list", "i", "j"]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = tuple(np.zeros(0, t) for t in (U, np.int64, np.int64))  # pairs of this task so far, which other lists hold as well
        for rows in whole(batches, keys):
            found = []
            for a, b in across(rows, keys, percent, partners):
                found.append((a, b))
                if sum(len(a) for a, _ in found) >= CROSSED:
                    told, a, b = untold(told, *(np.concatenate(c) for c in zip(*found)))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    found = []
            if found:
                told, a, b = untold(told, *(np.concatenate(c) for c in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    made = spread.repartition(partitions(table.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(cross, "a long, b long")
    return made.distinct().join(before, ["a", "b"], "left_anti")


def starts(*columns: np.ndarray) -> np.ndarray:
    """The first row of each run of rows that are equal in all columns."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of batches sorted by keys, those of equal keys together; holds a batch and one such run at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        first = starts(*(batch.column(k).to_numpy() for k in keys)).tolist()
        if held and len(first) > 1:
            yield pa.Table.from_batches([*held, batch.slice(0, first[1])]).combine_chunks()
            held, batch, first = [], batch.slice(first[1]), [f - first[1] for f in first[1:]]
        if first[-1]:
            yield pa.Table.from_batches([batch.slice(0, first[-1])])
        held.append(batch.slice(first[-1]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def across(rows: pa.Table, keys: list[str], percent: int, partners: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of members of different components in one run of keys that may link; of an i and a j that differ, those of different parts."""
    i, j, cls, n, pos, com, own = (rows.column(c).to_numpy() for c in ("i", "j", "cls", "n", "pos", "component", "own"))
    brief = np.frombuffer(b"".join(rows.column("brief").to_pylist()), np.uint64).reshape(len(cls), -1)
    first = starts(*(rows.column(k).to_numpy() for k in keys))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cls))))
    order = np.lexsort((com, group))
    run = starts(group[order], com[order])
    size = np.diff(np.append(run, len(cls)))
    order = order[np.lexsort((com[order], np.repeat(size, size), group[order]))]  # members of smaller components look for larger ones
    group, one, cls, n, pos, com, own, brief = (c[order] for c in (group, i == j, cls, n, pos, com, own, brief))
    run = starts(group, com)
    begin = np.repeat(np.append(run[1:], len(cls)), np.diff(np.append(run, len(cls))))  # those after a member's own component
    count = np.append(first[1:], len(cls))[group] - begin
    upto = np.cumsum(count)
    at = 0
    while at < len(cls):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - count[at] + CROSSED, "right")))
        x = np.repeat(np.arange(at, to), count[at:to])
        y = np.arange(len(x)) + np.repeat(begin[at:to] - (upto[at:to] - count[at:to] - (upto[at] - count[at])), count[at:to])
        at = to
        fits = may_link(n[x], pos[x], n[y], pos[y], percent) & (one[x] | (own[x] != own[y]))
        x, y = x[fits], y[fits]
        fits = np.bitwise_count(brief[x] ^ brief[y]).sum(axis=1) <= most_apart(n[x].astype(np.int64) + n[y], percent)
        x, y = x[fits], y[fits]
        if partners is not None and len(x):
            by = np.lexsort((mix((cls[y] ^ cls[x]).view(U)), com[y], x))
            x, y = x[by], y[by]
            new = starts(x, com[y])
            few = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x)))) < partners
            x, y = x[few], y[few]
        if len(x):
            yield np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])


def untold(told: tuple, a: np.ndarray, b: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Distinct pairs that told (their hashes in order, a, b) doesn't hold, and told with them. Pairs whose hashes collide may be told again."""

    def ordered(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        by = np.argsort(key, kind="stable")
        return key[by], a[by], b[by]

    new = ordered(mix(a.view(U) ^ mix(b.view(U))), a, b)
    first = starts(*new[1:]) if len(a) else np.zeros(0, np.int64)
    new = tuple(c[first] for c in new)
    at = np.minimum(np.searchsorted(told[0], new[0]), max(len(told[0]) - 1, 0))
    seen = np.logical_and.reduce([t[at] == c for t, c in zip(told, new)]) if len(told[0]) else np.zeros(len(first), bool)
    new = tuple(c[~seen] for c in new)
    told = ordered(*(np.concatenate(c) for c in zip(told, new))) if len(told[0]) < TOLD else new
    return told, new[1], new[2]


def search(query: np.ndarray, others: list[np.ndarray], percent: int) -> list[int]:
    """Which of the others share enough with the query: T-occurrence over their inverted lists by DivideSkip."""
    n, k = len(query), len(others)
    due = np.array([needed(n, len(o), percent) for o in others])
    least = int(due.min())
    entries = []
    for i, o in enumerate(others):
        at = np.searchsorted(query, o)
        at[at == n] = 0
        entries.append(at[query[at] == o] * k + i)
    entries = np.sort(np.concatenate(entries))  # the inverted lists, one after the other: place in the query, member
    place, member = np.divmod(entries, k)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    if len(first) < least:
        return []
    size = np.diff(np.append(first, len(place)))
    by_size = np.argsort(size, kind="stable")
    long_ = min(least - 1, int(least / (MU * math.log2(size.max() + 1) + 1)))
    short, probed = by_size[: len(size) - long_], place[first[by_size[len(size) - long_ :]]] * k
    merged = np.zeros(len(size), bool)
    merged[short] = True
    count = np.bincount(member[np.repeat(merged, size)], minlength=k)  # short lists: how many of them hold each member
    out = []
    for now in np.flatnonzero(count >= due - long_).tolist():  # long lists: a binary search in each
        at = np.minimum(np.searchsorted(entries, probed + now), len(entries) - 1)
        if count[now] + (entries[at] == probed + now).sum() >= due[now]:
            out.append(now)
    return out


def links(documents: DataFrame, known: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are alike. known: cls, n, bitmap, and doc_id and text_hash of one document of each class."""
    spark = documents.sparkSession

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = b["n"].to_numpy() + b["m"].to_numpy()
            keep = apart(b["x"].tolist(), b["y"].tolist()) <= most_apart(total, percent)
            yield b.loc[keep, ["a", "b"]]

    ends = known.select(F.col("cls").alias("a"), "n", F.col("bitmap").alias("x")), known.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    left = stored(pairs.join(ends[0], "a").join(ends[1], "b").mapInPandas(close, "a long, b long"), "pairs")
    # Bits of the documents whose sets are wanted, one of each class: WANTED / 64 rows at most, whatever their number. The others' texts aren't read by Python.
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(WANTED)).alias("bit")
    wanted = known.join(left.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls").select(bit)
    flags = wanted.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", READ):
            made = [(class_of(sig), own.tobytes()) for _, own, sig in sets(block, size)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["cls", "own"])

    rows = texts(documents).select("text", bit).join(F.broadcast(flags), F.shiftright("bit", 6) == F.col("word"))
    rows = rows.filter("shiftrightunsigned(bits, int(bit & 63)) & 1 = 1").select("text")
    sets_ = rows.mapInArrow(keyed, "cls long, own binary").dropDuplicates(["cls"])
    count = left.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    asked = left.join(count, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("cls"))
    asked = asked.unionByName(count.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("cls")))
    met = asked.join(sets_, "cls").repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches, ["a", "salt"]):
            a, cls, own = rows.column("a").to_numpy(), rows.column("cls").to_numpy(), rows.column("own")
            first = starts(a, rows.column("salt").to_numpy())
            out = []
            for i, j in zip(first.tolist(), np.append(first[1:], len(a)).tolist()):
                met_ = {c: np.frombuffer(own[k].as_buffer(), "<u8") for k, c in enumerate(cls[i:j].tolist(), i)}
                query = met_.pop(int(a[i]))
                ids = list(met_)
                if ids:
                    out.extend((int(a[i]), ids[k]) for k in search(query, [met_[c] for c in ids], percent))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return met.mapInArrow(find, "a long, b long")


def connected(links_: DataFrame) -> DataFrame:
    """cls and component (one of its members) of every class in links (a, b).

    Every vertex hooks to its smallest neighbour; links between the hooked
    vertices go on to the next round, which has half as many vertices at most.
    """
    edges = stored(links_.select("a", "b").filter("a != b"), "links")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct().withColumn("component", F.col("cls")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")), "hooks")
        from_, to = hook.select("a", F.col("to").alias("x")), hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = stored(edges.join(from_, "a").join(to, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a != b").distinct(), "links")
        step = hook.select(F.col("a").alias("component"), F.col("to").alias("then"))
        labels = stored(labels.join(step, "component", "left").select("cls", F.coalesce("then", "component").alias("component")), "labels")
    return labels


def labelled(documents: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every document, and ``first_hash``: that of the component's first row by id (nulls last), then text hash; null without words."""
    spark = documents.sparkSession
    table = stored(classes(documents, size), "classes")
    docs = table.filter("kind = 0").select("doc_id", "text_hash", "n", "signature", "cls", "bitmap")
    known = docs.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash", "n", "bitmap")).alias("r")).select("cls", "r.doc_id", "r.text_hash", "r.n", "r.bitmap")
    known = stored(known, "known")
    often = spark.sparkContext.broadcast(frequent(table))
    entries = known.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-int(entries) // BUCKET))
    packed = lists(documents, often, buckets, size, percent)
    found = stored(members(packed, percent), "lists")
    before = stored(first_pairs(found, percent), "pairs")
    made = stored(links(documents, known, before, size, percent), "found")
    joined = connected(made)
    for partners in (PARTNERS, None):
        later = stored(later_pairs(found, joined, known, before, percent, partners), "pairs")
        if later.isEmpty():  # partners that were all tested before say nothing of the others
            continue
        made = stored(made.unionByName(links(documents, known, later, size, percent)), "found")
        joined, before = connected(made), before.unionByName(later)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    groups = docs.filter("cls is not null").groupBy("cls").agg(first).join(joined, "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("first"))
    ids = groups.select("cls", "component").join(smallest, "component").select("cls", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    out = docs.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls").join(ids, "cls", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "first_hash")


def similar(documents: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every document."""
    return labelled(documents, percent, size).select("doc_id", "n_shingles", "component_id")


def one_of_each(documents: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """One row of each component, with its columns: the first by id (nulls last), then by the text's hash; rows without words all stay.

    Ids needn't tell rows apart: a row is known by its id and its text's hash.
    Of rows equal in both one stays.

    Hashes of the rows that go, or that are repeated, set bits of a table of fixed
    size, which every task gets. Rows on a bit that isn't set stay where they are;
    only the others, with their texts, are shuffled to meet those rows themselves.
    """
    table = stored(labelled(documents, percent, size), "similar").filter("n_shingles > 0")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    marks = table.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.bool_or(~first).alias("_gone")).filter("_gone or n > 1")
    marks = stored(marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_gone"), "marks")
    flags = marks.select(F.pmod(F.xxhash64("_id", "_hash"), F.lit(WANTED)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("_bits"))
    # The whole row goes along as one column, so that no name of its own can clash.
    keyed = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own_id"), F.xxhash64(F.col("text").cast("string")).alias("_own_hash"))
    # WANTED / 64 rows at most, whatever the number of rows.
    marked = keyed.withColumn("_bit", F.pmod(F.xxhash64("_own_id", "_own_hash"), F.lit(WANTED))).join(F.broadcast(flags), F.shiftright("_bit", 6) == F.col("_word"), "left")
    marked = marked.withColumn("_maybe", F.coalesce(F.expr("shiftrightunsigned(_bits, int(_bit & 63)) & 1") == 1, F.lit(False)))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    stay, maybe = marked.filter(~F.col("_maybe")), marked.filter("_maybe")
    left = stay.select("_row").unionByName(maybe.join(marks, same, "left_anti").select("_row"))
    again = marks.filter("not _gone")
    if not again.isEmpty():
        left = left.unionByName(maybe.join(again, same).dropDuplicates(["_own_id", "_own_hash"]).select("_row"))
    return left.select("_row.*")
