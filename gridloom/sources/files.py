"""File listing and typed table sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.functions.text import CELL
from gridloom.operators.unpivot import rows_of_wide

# The file types that are looked for.
EXTENSIONS = ("xlsx", "xlsb", "xlsm", "csv", "parquet")
# A CSV text that is a plain number, hence no code with leading zeros.
NUMBER_TEXT = r"\A-?(?:0|[1-9]\d*)(?:\.\d+)?\z"


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``name, path, mtime, size`` of all matching files below a folder. Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(folder)
    )
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")
    )


def _field(s: str) -> str:
    """A field with the separator before it; quoted ones may hold separators, line breaks and doubled quotes."""
    return rf'{s}(?:"[^"]*+(?:""[^"]*+)*+"|[^{s}]*+)'


def csv_cells(record: Column, sep: str = ";", numbers: bool = True) -> Column:
    """Cells of one CSV record, of any width. Null if a quoted field isn't closed, or has text after its closing quote: no text is lost silently."""
    s = "\\" + sep
    whole = F.concat(F.lit(sep), record)  # each field follows a separator, so an empty first one is found as the others are
    raw = F.regexp_extract_all(whole, F.lit(_field(s)), F.lit(0))

    def cell(token: Column) -> Column:
        body = F.substring(token, F.lit(2), F.length(token))
        quoted = body.startswith('"')
        text = F.when(
            quoted, F.replace(F.substring(body, F.lit(2), F.length(body) - F.lit(2)), F.lit('""'), F.lit('"'))
        ).otherwise(body)
        number = F.lit(numbers) & ~quoted & text.rlike(NUMBER_TEXT)
        return F.struct(
            F.when(text == "", "blank").when(number, "number").otherwise("text").alias("kind"),
            F.when(number, text.try_cast("double")).alias("num"),
            text.alias("txt"),
        )

    cells = f"array<{CELL.simpleString()}>"
    sound = rf'\A(?:{s}(?:"[^"]*+(?:""[^"]*+)*+"|(?!")[^{s}]*+))*+\z'
    broken = record.contains('"') & ~whole.rlike(sound)
    return F.when(broken, F.lit(None).cast(cells)).when(record == "", F.array().cast(cells)).otherwise(F.transform(raw, cell))


#: What a line does to the reader: it may start outside a quoted field or inside one, and ends outside or inside.
_STAYS, _OUT, _IN, _TURNS = 0, 1, 2, 3  # as it began; outside, or inside, however it began; the other way


def line_effect(line: Column, sep: str = ";") -> Column:
    """One of the four, from the line alone. A line without quotes leaves things as they are."""
    s = "\\" + sep
    closed = rf'{s}(?:"[^"]*+(?:""[^"]*+)*+"[^{s}]*+|(?!")[^{s}]*+)'
    ends_open = rf'(?:{closed})*+{s}"[^"]*+(?:""[^"]*+)*+\z'
    rest = F.regexp_replace(line, r'\A[^"]*+(?:""[^"]*+)*+', "")  # from the quote that closes a field begun before, if there is one
    from_out = F.concat(F.lit(sep), line).rlike(r"\A" + ends_open)
    after = F.regexp_replace(rest, rf'\A"[^{s}]*+', "")
    from_in = (rest == "") | after.rlike(r"\A" + ends_open)
    # 1 + 2 * from_out - from_in: each test is made once.
    effect = F.lit(_OUT) + from_out.cast("int") * (_TURNS - _OUT) - from_in.cast("int")
    return F.when(line.contains('"'), effect).otherwise(_STAYS).cast("tinyint")


def _states(effect: np.ndarray, start: int) -> np.ndarray:
    """Whether each line begins inside a quoted field, and at the end whether the next would: the effects composed in order."""
    n = len(effect)
    turned = np.append(0, np.cumsum(effect == _TURNS))
    fixed = np.append(0, np.where((effect == _OUT) | (effect == _IN), np.arange(1, n + 1), 0))
    last = np.maximum.accumulate(fixed)
    base = np.where(last > 0, np.append(start, effect == _IN)[last], start)
    return (base + turned - turned[last]) % 2


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for a start outside and inside: where it ends, and how many records begin in it."""
    now, ends, begun = None, [0, 1], [0, 0]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, ends[0], ends[1], begun[0], begun[1])], ["path", "_start", "out_to", "in_to", "out_n", "in_n"])

    for batch in batches:
        for key, at in _splits(batch):
            if now not in (None, key):
                yield out()
                ends, begun = [0, 1], [0, 0]
            now = key
            effect = batch.column("effect").to_numpy()[at]
            for start in (0, 1):
                inside = _states(effect, ends[start])
                begun[start] += int((inside[:-1] == 0).sum())
                ends[start] = int(inside[-1])
    if now is not None:
        yield out()


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], slice]]:
    """Stretches of one split: lines come in order, split after split."""
    start, path = batch.column("_start").to_numpy(), batch.column("path")
    encoded = path.dictionary_encode().indices.to_numpy() if batch.num_rows else np.zeros(0)
    cut = np.flatnonzero((np.diff(start) != 0) | (np.diff(encoded) != 0)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        if a < b:
            yield (path[int(a)].as_py(), int(start[a])), slice(int(a), int(b))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split by number. A record that runs over the split's edge is given in pieces: one a split, by its place.

    Records of several lines leave together, a batch of them for each batch of lines.
    """
    names = ["path", "row_no", "piece", "edge", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    now, held, number = None, [], 0
    inside, begins_inside = 0, False
    made = []

    def close(open_end: bool) -> None:
        made.append((now[0], number, now[1], begins_inside or open_end, "\n".join(held)))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)
        made.clear()
        return batch

    for batch in batches:
        for key, at in _splits(batch):
            part = batch.slice(at.start, at.stop - at.start)
            if key != now:
                if held:
                    close(bool(inside))
                now, held = key, []
                inside, number = part.column("_inside")[0].as_py(), part.column("_before")[0].as_py()
                begins_inside = bool(inside)
            states = _states(part.column("effect").to_numpy(), inside)
            inside = int(states[-1])
            begin, over = states[:-1] == 0, states[1:] == 1
            # Lines that are whole records go on as they are; only records of several lines are put together here.
            alone = begin & ~over
            if held and begin[0]:
                close(False)
                held, begins_inside = [], False
            numbers = number + np.cumsum(begin)
            if alone.any():
                own = np.flatnonzero(alone)
                lines = part.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([lines.column("path"), pa.array(numbers[own]), lines.column("_start"), pa.array(np.zeros(len(own), bool)), lines.column("value")], names)
            rest = np.flatnonzero(~alone)
            texts = part.column("value").take(pa.array(rest)).to_pylist()
            for text, nth, begun, goes_on in zip(texts, numbers[rest].tolist(), begin[rest].tolist(), over[rest].tolist()):
                if begun:
                    held, begins_inside = [], False
                number = nth
                held.append(text)
                if not goes_on:
                    close(False)
                    held, begins_inside = [], False
            number = int(numbers[-1])
        if made:
            yield out()
    if held:
        close(bool(inside))
    if made:
        yield out()


def scan_csv(spark: SparkSession, path: str, sep: str = ";", numbers: bool = True, glob: str = "*.csv") -> DataFrame:
    """CSV files as grids: ``path, sheet, row_no, cells, error``; blank lines are kept, they part tables.

    A quoted field may hold line breaks, and a file of any size is read in
    splits: each line is a small automaton (inside or outside a quoted field),
    each split the composition of its lines, and splits compose by file. So every
    split knows whether it begins inside a field and how many records come before
    it; only records that run over a split's edge are shuffled. A record that no
    cells can be made of has an ``error`` in their place; other files go on.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value", line_effect(F.col("value"), sep).alias("effect"),
    )
    splits = lines.select("path", "_start", "effect").mapInArrow(_summaries, "path string, _start long, out_to long, in_to long, out_n long, in_n long")
    # Compose splits of a file: a reset, or a turn of what came before.
    order = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("out_to") == F.col("in_to"), F.struct(F.col("out_to").alias("to"), F.col("_turns").alias("at")))
    turned = splits.withColumn("_turns", F.coalesce(F.sum(F.when((F.col("out_to") == 1) & (F.col("in_to") == 0), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    turned = turned.withColumn("_last", F.last(fixed, ignorenulls=True).over(order)).withColumn("_upto", F.coalesce(F.lag("_turns").over(Window.partitionBy("path").orderBy("_start")), F.lit(0)))
    state = F.pmod(F.coalesce("_last.to", F.lit(0)) + F.col("_upto") - F.coalesce("_last.at", F.lit(0)), F.lit(2))
    begun = turned.withColumn("_inside", state.cast("long")).withColumn("_n", F.when(F.col("_inside") == 1, F.col("in_n")).otherwise(F.col("out_n")))
    placed = begun.select("path", "_start", "_inside", F.coalesce(F.sum("_n").over(order), F.lit(0)).cast("long").alias("_before"))
    # One row for each split (128 MB of text as a rule): a millionth of what is read, so it is sent to every task, and lines stay in order.
    told = lines.join(F.broadcast(placed), ["path", "_start"]).select("path", "_start", "effect", "value", "_inside", "_before")
    pieces = told.mapInArrow(_records, "path string, row_no long, piece long, edge boolean, text string")
    whole = pieces.filter("not edge").select("path", "row_no", "text")
    joined = pieces.filter("edge").groupBy("path", "row_no").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    records = whole.unionByName(joined.select("path", "row_no", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    text = F.rtrim(F.col("text"), F.lit("\r"))
    text = F.when(F.col("row_no") == 1, F.ltrim(text, F.lit("﻿"))).otherwise(text)
    sheet = F.regexp_replace(F.substring_index("path", "/", -1), r"\.csv$", "")
    made = records.select("path", sheet.alias("sheet"), "row_no", text.alias("_text"), csv_cells(text, sep, numbers).alias("cells"))
    problem = F.concat(F.lit("CSV record with an unclosed quoted field or text after one: "), F.substring("_text", 1, 200))
    return made.select("path", "sheet", "row_no", "cells", F.when(F.col("cells").isNull(), problem).alias("error"))


def read_csv_grid(spark: SparkSession, path: str, sep: str = ";", numbers: bool = True, glob: str = "*.csv") -> DataFrame:
    """``scan_csv`` for files that must be sound: a record without cells ends the job."""
    rows = scan_csv(spark, path, sep, numbers, glob)
    return rows.withColumn("cells", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast(rows.schema["cells"].dataType)).otherwise(F.col("cells"))).drop("error")


def read_csv_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """CSV with a header as a wide DataFrame of text columns."""
    return spark.read.option("sep", sep).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_parquet_rows(spark: SparkSession, path: str, file_id: Column) -> tuple[DataFrame, list[str]]:
    """Parquet files of one schema as raw rows, with their header. No shuffle: the reader knows row numbers.

    ``file_id`` is an expression that may use ``path`` (the file's address).
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    header = df.columns
    located = df.select(
        "*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("_row")
    )
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.parquet$", "")
    return rows_of_wide(located, file_id, name, F.col("_row") + 2, header), header
