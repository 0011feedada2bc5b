"""Token ids of texts by a public tokenizer file, whole texts, each distinct word encoded once per Python worker.

Byte-pair merges stay inside the pieces that the tokenizer's pre-tokenizer
cuts, so the ids of a text are the ids of its parts between safe cuts. A worker
keeps a bounded cache of parts; parts it doesn't hold are encoded together.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from gridloom.llm.words import words

#: White space other than blank and line feed, by which the library may cut otherwise.
RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: One word of Latin letters with marks after it: two pieces for the pre-tokenizer at most.
PLAIN = re.compile("([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")
JOINED = 4000  # other missing parts encoded in one call
HELD = 1_000_000  # parts that a worker keeps as arrays, of some 50 bytes each
#: Bytes of parts where white space is dropped: all but blank and line feed.
PART = np.ones(256, bool)
PART[[32, 10]] = False


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one stretch after the other."""
    upto = np.cumsum(length)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - length), length)


class Parts:
    """Distinct parts and their ids as flat arrays, found by the parts' hashes in order. All are compared by their bytes, too."""

    def __init__(self, dtype: np.dtype):
        self.hash, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of the hash; number of the part
        self.data, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.first = np.zeros(0, dtype), np.zeros(1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the parts with these hashes, -1 where there is none."""
        if not len(self.hash):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[k] == h, self.at[k], -1)

    def add(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        """More parts, in order of their hashes."""
        place = np.searchsorted(self.hash, h)
        self.hash, self.at = np.insert(self.hash, place, h), np.insert(self.at, place, len(self.at) + np.arange(len(h)))
        self.data, self.begin = np.append(self.data, data), np.append(self.begin, begin[1:] + len(self.data))
        self.ids, self.first = np.append(self.ids, ids), np.append(self.first, first[1:] + len(self.ids))


class Encoder:
    """Ids of texts as little-endian unsigned integers.

    ``cut``: "blank" for byte-level files that join one blank to the part
    after it, "space" for files that drop white space, None to give the library
    whole texts. ``cache``: parts kept.
    """

    def __init__(self, path: str, cut: str | None, cache: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut, self.limit, self.known = cut, cache, {}
        self.model, self.letters, self.marks = self.tokenizer.model, byte_letters(), {"": b""}
        self.held, self.recent = Parts(self.dtype), Parts(self.dtype)
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        vocabulary = self.tokenizer.get_vocab() if cut == "blank" else {}
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def parts(self, text: str) -> list[str] | None:
        """A leading blank marks the first part of a text, which has no blank before it."""
        if self.cut == "space":
            return [p for p in text.replace("\n", " ").split(" ") if p]
        if self.cut is None or "  " in text or "\n " in text or " \n" in text or text[-1:] == " " or RARE_SPACE.search(text):
            return None
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def piece(self, text: str) -> bytes:
        """Ids of one piece that the pre-tokenizer would give to the model."""
        mapped = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def plain(self, part: str) -> bytes | None:
        """Ids of a part that is a word of Latin letters with marks after it."""
        found = PLAIN.fullmatch(part)
        if not found:
            return None
        word, marks = found.groups()
        if marks not in self.marks:
            self.marks[marks] = self.piece(marks)
        own = self.known.get(word) if marks else None
        return (own or self.piece(" " + word if self.cut == "blank" else word.lower())) + self.marks[marks]

    def encoded(self, parts: list[str]) -> dict[str, bytes]:
        out = {p: self.whole(p[1:]) for p in parts if p[:1] == " "} if self.cut == "blank" else {}
        out.update((p, ids) for p in parts if p[:1] != " " and (ids := self.plain(p)) is not None)
        rest = [p for p in parts if p not in out]
        for i in range(0, len(rest), JOINED):
            some = rest[i : i + JOINED]
            if self.cut == "blank":
                found = self.tokenizer.encode_batch_fast(["".join([" " + p for p in some])], add_special_tokens=False)[0]
                ids = np.array(found.ids, self.dtype)
                edges = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            else:
                found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids = np.array(found.ids, self.dtype)
                ends = np.cumsum([len(p) + 1 for p in some])
                edges = np.append(0, np.searchsorted([o[0] for o in found.offsets], ends))
            if len(edges) != len(some) + 1:  # a part the cuts don't hold for
                out.update((p, self.whole((self.cut == "blank") * " " + p)) for p in some)
                continue
            data, k = ids.tobytes(), self.dtype.itemsize
            out.update((p, data[a * k : b * k]) for p, a, b in zip(some, edges[:-1].tolist(), edges[1:].tolist()))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        waiting, missing, get = [], set(), self.known.get
        for i, text in enumerate(texts):
            parts = self.parts(text)
            if parts is None:
                out[i] = self.whole(text)
                continue
            values = list(map(get, parts))
            if not all(values):
                waiting.append((i, parts, values))
                missing.update([p for p, v in zip(parts, values) if v is None])
            else:
                out[i] = b"".join(values)
        new = self.encoded(list(missing)) if missing else {}
        for i, parts, values in waiting:
            out[i] = b"".join([new[p] if v is None else v for p, v in zip(parts, values)])
        if len(self.known) < self.limit:
            self.known.update(new)
        return out


    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (64-bit offsets, no nulls) one after the other, and where each text's ids begin and the last's end.

        Where white space is dropped, all is done on arrays: letters of ASCII are
        made small, as the tokenizer does, and each distinct part is looked up once.
        """
        if self.cut == "space" and (found := self.looked_up(texts)):
            return found
        made = self.ids(texts.to_pylist())
        return np.frombuffer(b"".join(made), self.dtype), np.cumsum([0, *map(len, made)]) // self.dtype.itemsize

    def looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """None if different parts have one hash."""
        w = words(texts, PART)
        size = w.end - w.begin
        order = np.argsort(w.hash)
        new = np.ones(len(order), bool)
        new[1:] = w.hash[order][1:] != w.hash[order][:-1]
        part = np.empty(len(order), np.int64)  # of each word, among the distinct ones
        part[order] = np.cumsum(new) - 1
        one = order[new]
        if not self.equal(w.data, w.begin, size, w.data, w.begin[one][part], size[one][part]):
            return None
        h, begin, size = w.hash[one], w.begin[one], size[one]
        ids, first, length = [], np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        missing, held = np.ones(len(h), bool), 0
        for known in (self.held, self.recent):
            at = known.find(h)
            own = np.flatnonzero(at >= 0)
            at = at[own]
            if not self.equal(w.data, begin[own], size[own], known.data, known.begin[at], np.diff(known.begin)[at]):
                return None
            first[own], length[own] = known.first[at] + held, np.diff(known.first)[at]
            missing[own] = False
            ids.append(known.ids)
            held += len(known.ids)
        rest = np.flatnonzero(missing)
        if len(rest):
            data = w.data.tobytes()
            names = [data[a:b].decode() for a, b in zip(begin[rest].tolist(), (begin + size)[rest].tolist())]
            made = self.encoded(names)
            made = [made[x] for x in names]
            ids.append(np.frombuffer(b"".join(made), self.dtype))
            length[rest] = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
            upto = np.append(0, np.cumsum(length[rest]))
            first[rest] = upto[:-1] + held
            if len(self.held.at) + len(self.recent.at) < HELD:
                self.recent.add(h[rest], w.data[spread(begin[rest], size[rest])], np.append(0, np.cumsum(size[rest])), ids[-1], upto)
                if 4 * len(self.recent.at) > len(self.held.at):  # so that the many aren't moved each time
                    self.keep()
        of = np.concatenate(ids)[spread(first[part], length[part])]
        return of, np.append(0, np.cumsum(length[part]))[w.first]

    def keep(self) -> None:
        """Recent parts go to the others."""
        own = self.recent
        order = own.at
        size, length = np.diff(own.begin)[order], np.diff(own.first)[order]
        self.held.add(own.hash, own.data[spread(own.begin[order], size)], np.append(0, np.cumsum(size)), own.ids[spread(own.first[order], length)], np.append(0, np.cumsum(length)))
        self.recent = Parts(self.dtype)

    @staticmethod
    def equal(data: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray, its_begin: np.ndarray, its_size: np.ndarray) -> bool:
        return np.array_equal(size, its_size) and np.array_equal(data[spread(begin, size)], other[spread(its_begin, its_size)])


_encoders: dict = {}


def encoder(path: str, cut: str | None) -> Encoder:
    """One for each file and Python worker."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]
