"""Secret scans: patterns of keys, and literals assigned to names that hold secrets.

Base kinds are patterns over the whole text, leftmost and non-overlapping for
each kind: ``assign``, ``access``, ``hex``. On top of them an assignment-aware
lexer reads source and configuration syntax into pairs of name and value:
quoted literals, bare words, names, and sums of them. Literals of constants are
carried to the names that use them; a literal is scored by the most telling
name it reaches and by its look, and becomes a span of kind ``literal``. A sum
is scored by its joined value, each part is a span; a sum of more than
``PARTS`` parts is scored part by part. Quoted literals with blanks count where
the name is strong (``STRONG``) and they hold a digit, or the name says passphrase.

All spans are half-open, in code points. Texts are read whole, row by row, in
tasks without a shuffle. Nulls: a null text is empty and has no spans. Repeated
rows are scanned each; no rows give no rows. Columns that have the name of a
result give way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.arrow import annotated, text_of

KINDS = ["assign", "access", "hex", "literal"]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

#: How telling a word in a name is; words of a name add up.
NAMES = {
    "password": 2.0, "passwd": 2.0, "passphrase": 2.0, "pwd": 2.0, "secret": 2.0, "token": 1.5, "apikey": 2.0, "credential": 1.5,
    "credentials": 1.5, "pass": 1.0, "auth": 1.0, "bearer": 1.0, "private": 0.75, "access": 0.5, "api": 0.75, "key": 1.0, "pin": 0.75, "signature": 0.75,
}
NAME_WORD = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
TARGET = re.compile(r"""(?<![\w.$-])(?P<name>[A-Za-z_$][\w$.-]*)(?:["']?\]?)[ \t]*(?::=|=>|=(?!=)|:(?![/:]))""", re.ASCII)
OPERAND = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9+/_.=$-]+))""")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*", re.ASCII)
PLUS = re.compile(r"[ \t]*\+")
THRESHOLD = 2.5
STRONG = 2.0
PARTS = 64

Literal = tuple[int, int, bool]  # begin, end, quoted


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def name_weight(name: str) -> float:
    return sum({w: NAMES[w] for w in map(str.lower, NAME_WORD.findall(name)) if w in NAMES}.values())


def literal_weight(text: str, quoted: bool, name: str = "") -> float:
    """0 to 2: long, mixed and irregular literals weigh more. A bare word needs a digit, one with blanks a strong name too."""
    digit = re.search("[0-9]", text)
    if len(text) < 6 or not quoted and not digit:
        return 0.0
    if " " in text and not (quoted and ("passphrase" in name.lower() or digit and name_weight(name) >= STRONG)):
        return 0.0
    classes = sum(bool(re.search(c, text)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(2.0, 0.5 * (len(text) >= 8) + 0.5 * (entropy(text) >= 2.5) + 0.25 * classes)


def pairs(text: str) -> list[tuple[str, list[tuple[Literal | None, str | None]]]]:
    """Assignments in order: name, and the summed operands; each a literal, the name of a value, or (a word with a digit) both."""
    out, at = [], 0
    while (m := TARGET.search(text, at)) is not None:
        operands, p = [], m.end()
        while (o := OPERAND.match(text, p)) is not None:
            k = o.lastindex or 3
            word = o[k] or ""
            name = word if k == 3 and IDENTIFIER.fullmatch(word) else None
            literal = (o.start(k), o.end(k), k < 3) if name is None or re.search("[0-9]", word) else None
            operands.append((literal, name))
            p = o.end()
            if (plus := PLUS.match(text, p)) is None:
                break
            p = plus.end()
        out.append((m["name"], operands))
        at = p
    return out


def values(operands: list[tuple[Literal | None, str | None]], held: dict[str, set[tuple[Literal, ...]]]) -> set[tuple[Literal, ...]]:
    """The values that a sum may have, as runs of literals: one joined run where each operand has one value, else those of each."""
    each = [held[name] if name in held else {(literal,)} if literal else set() for literal, name in operands]
    if all(len(e) == 1 for e in each):
        joined = tuple(part for e in each for run in e for part in run)
        if len(joined) <= PARTS:
            return {joined} if joined else set()
        return {(part,) for part in joined}
    return set().union(*each)


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, by themselves or through constants."""
    if "=" not in text and ":" not in text:
        return []
    held: dict[str, set[tuple[Literal, ...]]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, operands in pairs(text):
        held[name] = values(operands, held)
        if weight := name_weight(name):
            for run in held[name]:
                own = literal_weight("".join(text[begin:end] for begin, end, _ in run), any(q for _, _, q in run), name)
                for begin, end, _ in run if own else ():
                    if end > begin:
                        best[begin, end] = max(best.get((begin, end), 0.0), weight + own)
    return sorted(s for s, score in best.items() if score >= THRESHOLD)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, in that order."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(base + [(a, 3, b) for a, b in literal_spans(text) if not any(s <= a and b <= e for s, _, e in base)])


ADDED = "span_kind array<string>, span_from array<int>, span_to array<int>"


def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with its secrets as parallel arrays: kind, begin and end, by begin and then by kind."""

    def make():
        def of(block: pa.RecordBatch) -> list[pa.Array]:
            found = [scan(t) for t in text_of(block.column(text)).to_pylist()]
            return [pa.array([[KINDS[k] for _, k, _ in f] for f in found], pa.list_(pa.string())), pa.array([[a for a, _, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[b for _, _, b in f] for f in found], pa.list_(pa.int32()))]

        return of

    return annotated(df, text, ADDED, make, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with each secret, or run of overlapping ones, replaced by the mark. Null texts stay null."""

    def cleared(value: str | None) -> str | None:
        if value is None:
            return None
        out, at = [], 0
        for begin, _, end in scan(value):
            if begin >= at:
                out.append(value[at:begin] + mark)
            at = max(at, end)
        return "".join(out) + value[at:]

    def make():
        return lambda block: [pa.array([cleared(t) for t in block.column(text).to_pylist()], pa.string())]

    return annotated(df, text, f"`{text}` string", make).select(*df.columns)
