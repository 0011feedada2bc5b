"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a bounded block of documents. Benchmark words get numbers; the
shard's text is reduced to the stretches whose neighbouring words are also
neighbours in some benchmark item, since no window can lie elsewhere. Over
these stretches the task builds a suffix array, its Burrows-Wheeler transform
and a wavelet matrix; all windows are searched backwards at once by rank
queries, and occurrences are located by walking to sampled suffix positions.
Hits merge into removal spans. Nothing is shuffled.

The benchmark is sent to tasks in groups of bounded size, one pass after the
other, so it may be of any size.

A word is a maximal run of ASCII letters and digits and of characters beyond
ASCII; A-Z count as a-z. A window is ``window`` consecutive words of an item,
or all words of a shorter item.

Nulls: a null text has no words; a null item id reads as an empty id. Repeated
documents are judged each, repeated item ids count once. No items: no hits. No
documents: no rows. Columns that have the name of a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.arrow import annotated, blocks, text_of
from gridloom.llm.words import Words, words

#: Bytes of benchmark text that one pass sends to the tasks.
GROUP_BYTES = 8 << 20
SAMPLE = 16  # every 16th suffix position is kept
ADDED = "n_words long, n_hit long, items array<string>, hit_from array<int>, hit_to array<int>, span_from array<int>, span_to array<int>"


@dataclass
class Phrases:
    """Windows of a group of items, as word numbers from 2."""

    hashes: np.ndarray  # of words, ascending
    spelled: list[str]  # in the same order
    windows: np.ndarray  # a row each, filled with 0 at the end
    lengths: np.ndarray
    items: list[list[str]]  # of each window
    pairs: np.ndarray  # neighbours, ascending
    singles: np.ndarray  # is a window by itself, by word number


def phrases(items: list[tuple[str, str]], window: int) -> Phrases:
    w = words(pa.array([t for _, t in items], pa.large_string()))
    hashes, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
    number = number.astype(np.int64) + 2
    found: dict[tuple, set] = {}
    for k, (item, _) in enumerate(items):
        own = number[w.first[k] : w.first[k + 1]].tolist()
        for i in range(max(len(own) - window + 1, min(len(own), 1))):
            found.setdefault(tuple(own[i : i + window]), set()).add(item)
    keys = list(found)
    lengths = np.array([len(k) for k in keys], np.int64)
    table = np.zeros((len(keys), window), np.int64)
    for i, k in enumerate(keys):
        table[i, : len(k)] = k
    both = (table[:, 1:] > 0).ravel()
    pairs = np.unique((table[:, :-1] * (len(hashes) + 2) + table[:, 1:]).ravel()[both])
    singles = np.zeros(len(hashes) + 2, bool)
    singles[table[lengths == 1, 0]] = True
    return Phrases(hashes, [w.word(int(a)) for a in at], table, lengths, [sorted(found[k]) for k in keys], pairs, singles)


def among(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the ascending array, and where it would stand."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def stretches(w: Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all stretches that may hold a window, each followed by 1; and the word each comes from."""
    is_known, at = among(w.hash, p.hashes)
    number = np.where(is_known, at + 2, 0)
    code = number[:-1] * (len(p.hashes) + 2) + number[1:]
    joined = (number[:-1] > 0) & (number[1:] > 0) & (w.row[:-1] == w.row[1:])
    joined[joined] = among(code[joined], p.pairs)[0]
    inside = p.singles[number]
    inside[:-1] |= joined
    inside[1:] |= joined
    place = np.flatnonzero(inside)
    wrong = [k for k in place.tolist() if w.word(k) != p.spelled[number[k] - 2]]  # another word of equal hash
    number[wrong] = 1
    last = np.append(place[1:] != place[:-1] + 1, True) if len(place) else np.zeros(0, bool)
    last[:-1] |= ~joined[place[:-1]] if len(place) else False
    out = np.ones(len(place) + int(last.sum()), np.int64)
    source = np.full(len(out), -1, np.int64)
    spot = np.arange(len(place)) + np.cumsum(last) - last
    out[spot], source[spot] = number[place], place
    return out, source


class FMIndex:
    """Of a sequence of numbers from 1; 0 ends it."""

    def __init__(self, sequence: np.ndarray):
        s = np.append(sequence, 0)
        self.size = n = len(s)
        rank, step = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            step *= 2
        bwt = s[order - 1]
        self.top = int(s.max()).bit_length()
        self.less = np.append(0, np.cumsum(np.bincount(s, minlength=(1 << self.top) + 1)))
        self.ones, self.zeros = [], []
        for level in range(self.top - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        kept = order % SAMPLE == 0
        self.kept = np.append(0, np.cumsum(kept))
        self.position = order[kept]

    def before(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The row that the symbol before has: count of smaller symbols, plus its rank up to row."""
        low, high = np.zeros_like(row), row
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.top - 1 - level)) & 1 > 0
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return self.less[symbol] + high - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[row + 1] - ones[row]
            row = np.where(bit > 0, zeros + ones[row], row - ones[row])
            out = out * 2 + bit
        return out

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; low = high if it doesn't occur."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((low < high) & (lengths > step))
            c = table[live, lengths[live] - 1 - step]
            fits = c < (1 << self.top)
            high[live[~fits]] = low[live[~fits]]
            live, c = live[fits], c[fits]
            low[live], high[live] = self.before(c, low[live]), self.before(c, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
        row = row.copy()
        while len(open_):
            there = self.kept[row[open_] + 1] > self.kept[row[open_]]
            done = open_[there]
            out[done] = self.position[self.kept[row[done]]] + steps[done]
            open_ = open_[~there]
            row[open_] = self.before(self.symbol(row[open_]), row[open_])
            steps[open_] += 1
        return out


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Values of ascending rows as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values, kind))


def judged(texts: pa.Array, p: Phrases, prior: list[pa.Array] | None) -> list[pa.Array]:
    """The columns of ADDED for a block; ``prior``: items, hit_from and hit_to found with other items."""
    w, rows = words(texts), len(texts)
    number, source = stretches(w, p)
    change = np.zeros(len(w.hash) + 1, np.int64)
    found: set[tuple[int, str]] = set()
    if len(number):
        index = FMIndex(number)
        low, high = index.search(p.windows, p.lengths)
        which = np.repeat(np.arange(len(low)), high - low)
        first = np.cumsum(high - low) - (high - low)
        begin = source[index.locate(np.arange(len(which)) - first[which] + low[which])]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + p.lengths[which], -1)
        for row, k in set(zip(w.row[begin].tolist(), which.tolist())):
            found.update((row, item) for item in p.items[k])
    if prior:
        for row, (items, begins, ends) in enumerate(zip(*(c.to_pylist() for c in prior))):
            found.update((row, item) for item in items)
            np.add.at(change, w.first[row] + np.array(begins, np.int64), 1)
            np.add.at(change, w.first[row] + np.array(ends, np.int64), -1)
    hit = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(hit) + 1, bool)
    edge[w.first] = True
    begin = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
    last = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)))
    row = w.row[begin]
    per_row = np.bincount(w.row[hit], minlength=rows)
    chars = np.append(0, np.cumsum((w.data & 0xC0) != 0x80))
    start = chars[np.append(0, np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1])))] if rows else chars
    pairs = sorted(found)
    return [
        pa.array(np.diff(w.first)),
        pa.array(per_row),
        lists([i for _, i in pairs], np.array([r for r, _ in pairs], np.int64), rows, pa.string()),
        lists((begin - w.first[row]).astype(np.int32), row, rows, pa.int32()),
        lists((last + 1 - w.first[row]).astype(np.int32), row, rows, pa.int32()),
        lists((chars[w.begin[begin]] - start[row]).astype(np.int32), row, rows, pa.int32()),
        lists((chars[w.end[last]] - start[row]).astype(np.int32), row, rows, pa.int32()),
    ]


def grouped(benchmark: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """Items, and in how many groups of ``group_bytes`` of text they are sent."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return items, max(1, -(-total // group_bytes))


def sent(items: DataFrame, groups: int, k: int, window: int):
    own = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(groups)) == k)
    return items.sparkSession.sparkContext.broadcast(phrases([tuple(r) for r in own.collect()], window))  # group_bytes of text


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """documents with n_words, n_hit, items (ids with windows in the text, as strings), hit words and removal spans (code points), contaminated."""
    items, groups = grouped(benchmark, group_bytes)
    out = documents
    for k in range(groups):
        out = one_pass(out, text, sent(items, groups, k, window), k > 0)
    hit = F.col("n_hit")
    return out.withColumn("contaminated", (hit > 0) & (20 * hit >= F.col("n_words")))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with their own columns, whatever their names. Texts are sent to Python once."""
    items, groups = grouped(benchmark, group_bytes)
    if groups > 1:  # hits of all groups count together, so they go along
        rows = documents.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
        return decontaminate(rows, benchmark, window, "_text", group_bytes).filter(~F.col("contaminated")).select("_row.*")
    held = sent(items, groups, 0, window)

    def run(batches):
        for block in blocks(batches, text):
            n_words, n_hit = (c.to_numpy() for c in judged(text_of(block.column(text)), held.value, None)[:2])
            yield block.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return documents.mapInArrow(run, documents.schema)


def one_pass(df: DataFrame, text: str, held, again: bool) -> DataFrame:
    prior = ["items", "hit_from", "hit_to"]
    if not again:
        def make():
            return lambda block: judged(text_of(block.column(text)), held.value, None)

        return annotated(df, text, ADDED, make)
    df = df.withColumnsRenamed({c: f"_{c}" for c in prior})

    def make_again():
        return lambda block: judged(text_of(block.column(text)), held.value, [block.column(f"_{c}") for c in prior])

    return annotated(df, text, ADDED, make_again).drop(*(f"_{c}" for c in prior))
