"""Corpus operators against brute force on small rows with nulls, empty and long texts, repeated rows and clashing columns."""

import dataclasses
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontaminate, fingerprints, jaccard, language, learning, packing, quality, secret_scan, token_files, tokens, toxicity
from gridloom.llm.arrow import text_of
from gridloom.llm.queries import tokenizer
from gridloom.llm.tokens import Encoder
from gridloom.llm.words import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name, cut", [("byte_bpe_50k.json", "blank"), ("word_bpe_49k.json", "space")])
def test_parts_encode_as_the_whole(name, cut):
    rng = random.Random(1)
    own = Encoder(tokenizer(name), cut)
    alphabet = ["a", "B", "é", " ", "\n", "'", "s", "1", "!", "日", "́", "\t", "  ", "Σ", "\xa0", ".", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 15))) for _ in range(1500)]
    assert own.ids(texts) == [own.whole(t) for t in texts]


def test_blocks_encode_as_the_whole(monkeypatch):
    """Ids of blocks of texts as flat arrays; each distinct part is encoded once, whatever its capitals."""
    rng = random.Random(2)
    own = Encoder(tokenizer("word_bpe_49k.json"), "space")
    alphabet = ["a", "B", "é", "É", " ", "\n", "'", "s", "1", "!", "日", "́", "\t", "  ", "Σ", "\xa0", ".", "<|endoftext|>", "İ", "The", "the,"]
    encoded, real = Counter(), own.encoded
    monkeypatch.setattr(own, "encoded", lambda parts: encoded.update(parts) or real(parts))
    for n in (0, 1, 40, 400, 400):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 15))) for _ in range(n)]
        ids, at = own.flat(text_of(pa.array(texts, pa.string())))
        assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == [own.whole(t) for t in texts] and len(at) == n + 1
    assert set(encoded.values()) == {1} and "the" in encoded and "The" not in encoded


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    own = Encoder(tokenizer("word_bpe_49k.json"), "space")
    monkeypatch.setattr(tokens, "words", lambda *a: dataclasses.replace(w := words(*a), hash=w.hash & np.uint64(1)))
    for texts in (["one two", "three"], ["four one five"]):
        ids, at = own.flat(text_of(pa.array(texts)))
        assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == [own.whole(t) for t in texts]


def test_chat_round_trip(spark):
    rows = [(1, 1, "user", "[INST] <\\/s> </s>"), (1, 0, "sys\\n\nx", None), (1, 1, "user", "[INST] <\\/s> </s>"), (1, 2, "assistant", "é[/INST]"), (None, None, None, "x"), (2, 0, "assistant", "y" * 5000)]
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = [r for r in rows if r[0] == 1]
    turns.sort(key=lambda r: (r[1], r[2], r[3] or ""))
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].n_turns) == (4, 8, 5000, 1)
    assert got[1].loss_sha256 == hashlib.sha256("é[/INST]".encode()).hexdigest()
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_orders_ties_over_ranges(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("aé日Z <\\", k=rng.randint(0, 6))) for _ in range(600)] + ["same " * 60 + str(i) for i in range(60)]
    rows = [(None, None, "assistant", t) for t in texts]
    parts = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).persist()
    (got,) = chat.digest(parts).collect()
    texts.sort(key=str.encode)
    assert parts.select(F.shiftright("part", 32)).distinct().count() > 1
    assert (got.n_turns, got.loss_sha256) == (660, hashlib.sha256("".join(texts).encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256("".join(f"assistant\n{t}\n" for t in texts).encode()).hexdigest()


def brute_hits(text, items, window=13):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        for i in range(max(len(v) - window + 1, min(len(v), 1))):
            p = v[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("group_bytes", [8 << 20, 60])
def test_decontamination(spark, corpus, group_bytes):
    rows = corpus.collect()
    words = rows[7].text.split(" ")
    items = [("7", " ".join(words[3:25])), ("8", words[0].upper() + "," + words[1]), ("9", None), ("", rows[6].text), ("10", "absent words only")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(corpus, bench, group_bytes=group_bytes).select("doc_id", "text", "n_words", "n_hit", "items", "span_from", "span_to").collect()
    for r in got:
        assert (r.n_words, r.n_hit, sorted(r["items"])) == brute_hits(r.text, items), r.doc_id
        for a, b in zip(r.span_from, r.span_to):
            assert re.fullmatch(r"[^ ].*[^ ]|[^ ]", r.text[a:b], re.S)
    assert len(got) == len(rows)


def test_index_finds_every_run():
    s = np.array(random.Random(4).choices(range(1, 6), k=400))
    index = decontaminate.FMIndex(s)
    for n in (1, 2, 5):
        table = np.unique([s[i : i + n] for i in range(400 - n)], axis=0)
        low, high = index.search(table, np.full(len(table), n))
        for p, a, b in zip(table, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(401 - n) if (s[i : i + n] == p).all()]


def test_packing(spark, corpus):
    path = tokenizer("word_bpe_49k.json")
    whole = Encoder(path, None)
    rows = packing.pack(corpus, path, size=256).collect()
    texts = Counter(np.append(np.frombuffer(whole.whole(r.text or ""), "<u2"), 1).astype("<u2").tobytes() for r in corpus.collect())
    pieces = {}
    for r in rows:
        assert len(r.ids) == 2 * r.length and r.offset + r.length <= 256
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in pieces.values():
        assert [a for a, _ in sorted(spans)] == np.append(0, np.cumsum([n for _, n in sorted(spans)]))[:-1].tolist()
    assert sum(r.length for r in rows) == sum(len(t) // 2 * k for t, k in texts.items()) and sorted(pieces) == list(range(len(pieces)))
    assert packing.pack(corpus.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_patterns_serve_every_piece(seed):
    demand = np.random.default_rng(seed).integers(0, 60, 32)
    found = packing.solve(demand)
    assert (sum(p * t for p, t in found) == demand).all() and all((p * np.arange(1, 33)).sum() <= 32 for p, _ in found)
    assert sum(t for _, t in found) <= (demand * np.arange(1, 33)).sum() / 32 + 33


def test_token_files(spark, corpus):
    path = tokenizer("byte_bpe_50k.json")
    own = Encoder(path, None)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_files(spark, corpus, path).collect())
    assert [g[1] is None for g in got[:3]] == [True, True, False] and [g[1] for g in got[2:]] == sorted(g[1] for g in got[2:])
    ids = Counter(zlib.crc32(np.append(np.frombuffer(own.whole(r.text or ""), "<u2"), 2).astype("<u4").tobytes()) for r in corpus.collect())
    assert Counter(g[3] for g in got) == ids
    assert [g[0] for g in got] == np.append(0, np.cumsum([g[2] for g in got]))[:-1].tolist()


def test_secrets_by_constants():
    text = 'seed = "Zx81-qP0mv"\nother = "plain words"\nclient_secret_key = seed\nlink = "http://a.b/c"\n'
    kinds = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.scan(text)]
    assert ("literal", "Zx81-qP0mv") in kinds and not any("plain" in t or "http" in t for _, t in kinds)
    assert [secret_scan.KINDS[k] for _, k, _ in secret_scan.scan("Token: abcdef AKIA" + "A" * 16 + " " + "0a" * 12 + " token=short")] == ["assign", "access", "hex"]
    assert secret_scan.scan("") == [] and secret_scan.scan("ſecret = abcdefg") == []


def brute_base(text):
    """Base spans without patterns: for each kind leftmost, non-overlapping."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    run = lambda at, some: next((k for k in range(at, len(text)) if text[k] not in some), len(text))

    def assigned(at):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(n)].translate(LOWER) == n), None)
        if name is None:
            return None
        p = at + len(name)
        p = run(p + (text[p : p + 1] in ('"', "'")), " ")
        if text[p : p + 1] not in (":", "="):
            return None
        p = run(p + 1, " ")
        p += text[p : p + 1] in ('"', "'")
        end = run(p, value)
        return (end, end - p >= 6) if end > p else None

    def access(at):
        end = run(at + 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") if text.startswith("AKIA", at) else at
        return (end, True) if end - at >= 20 else None

    def hexadecimal(at):
        end = run(at, "0123456789abcdef")
        return (end, True) if end - at >= 24 else None

    out = []
    for kind, of in enumerate((assigned, access, hexadecimal)):
        at = 0
        while at < len(text):
            found = of(at)
            if found and found[1]:
                out.append((at, kind, found[0]))
            at = found[0] if found else at + 1
    return sorted(out)


def test_base_spans_by_brute_force():
    rng = random.Random(11)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apiKey", "api-key", "=", ":", " = ", ": ", " ", '"', "'", "AKIA", "ABC123XYZ9876543", "Z", "0a1b2c3d4e5f", "abcdef", "x9", "é", "ſ", "\n", "\t", "+/", "_."]
    n = Counter()
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        got = [s for s in secret_scan.scan(text) if s[1] < 3]
        assert got == brute_base(text), text
        n.update(k for _, k, _ in got)
    assert min(n[k] for k in range(3)) > 20


def test_redaction_keeps_rows(spark, corpus):
    got = secret_scan.redact(corpus)
    assert got.columns == corpus.columns and got.count() == corpus.count()
    assert got.filter("text like '%abcdef123456%'").count() == 0 and got.filter("text is null").count() == corpus.filter("text is null").count()


def test_fingerprints(spark, corpus):
    rows = fingerprints.edited_fingerprints(corpus).collect()
    order = sorted(corpus.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    known = [r for r in order if r.doc_id is not None]
    by_id = {r.doc_id: r for r in rows}
    for r, n in zip(known, known[1:]):
        t, k = r.text or "", len(r.text or "") // 3
        if r.doc_id != 7 and n.doc_id != 7:
            assert by_id[r.doc_id].edited_sha256 == hashlib.sha256((t[: len(t) - k] + (n.text or "")[:k]).encode()).hexdigest()
    assert len(rows) == len(order) and by_id[3].own == by_id[4].own and all(0 <= r.near_next <= 1 for r in rows)
    prints = [random.Random(i).getrandbits(63) for i in range(60)]
    prints += [p ^ (1 << 5) ^ (1 << 40) for p in prints[:20]]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    expect = {(a, b) for a in prints for b in prints if bin(a ^ b).count("1") <= 3}
    assert {tuple(r) for r in fingerprints.within(df, df).collect()} == expect
    assert fingerprints.edited_fingerprints(corpus.limit(0)).count() == 0


def brute_components(rows):
    sets = []
    for r in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {g: min((rows[i].doc_id for i in range(len(rows)) if group[i] == g and rows[i].doc_id is not None), default=None) for g in group}
    return sorted(((r.doc_id, len(s), first[g]) for r, s, g in zip(rows, sets, group)), key=repr)


def test_jaccard_join(spark, corpus):
    rng = random.Random(8)
    base = [str(rng.randint(0, 400)) for _ in range(120)]
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"x{rng.randint(0, 9)}"
        near.append((100 + i, " ".join(w)))
    more = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = sorted((tuple(r) for r in jaccard.similar(more).collect()), key=repr)
    assert got == brute_components(more.collect())
    kept = jaccard.one_of_each(more)
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({c for i, _, c in got if i is not None})


def test_last_pass_follows_an_empty_one(spark, monkeypatch):
    """A chain in which only neighbours link, whose lists give only pairs with their first members; the pass of few partners gives none."""
    monkeypatch.setattr(jaccard, "DIRECT", 1)
    monkeypatch.setattr(jaccard, "PARTNERS", 0)
    words = [f"w{i}" for i in range(400)]
    rows = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(30)], "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.similar(rows).collect()), key=repr) == brute_components(rows.collect())


def test_one_row_of_each_component(spark):
    rng = random.Random(10)
    prose = lambda: " ".join(str(rng.randint(0, 900)) for _ in range(60))
    a, b, c, d, e, f, g = (prose() for _ in range(7))
    rows = [(1, a), (5, a + " x"), (5, b), (5, c), (None, c + " x"), (None, a), (None, d), (None, e), (None, e), (None, f + " x"), (None, f), (5, ""), (5, None), (5, ""), (None, ""), (None, None), (7, g), (7, g), (7, g + " x"), (8, d.upper() + " Q")]
    documents = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long")
    kept = jaccard.one_of_each(documents).collect()
    places = {r.place for r in kept}
    assert len(places) == len(kept) and all(rows[r.place] == (r.doc_id, r.text) for r in kept)
    texts = Counter((r.doc_id, r.text) for r in kept)
    either = [texts.pop((None, f), 0) + texts.pop((None, f + " x"), 0), texts.pop((7, g), 0) + texts.pop((7, g + " x"), 0)]
    assert either == [1, 1]
    assert texts == Counter([(1, a), (5, b), (5, c), (None, e), (8, d.upper() + " Q"), (5, ""), (5, None), (5, ""), (None, ""), (None, None)])


def test_only_wanted_texts_are_cut_again(spark, monkeypatch):
    """All texts are cut into shingles for their classes and for the prefix lists; then only those of candidate pairs."""
    rng = random.Random(12)
    prose = [" ".join(rng.choices("abcdefghijklmnopqrst", k=80)) for _ in range(300)]
    rows = [*enumerate(prose), (900, prose[7] + " x"), (901, prose[7] + " x y")]
    cut, real = spark.sparkContext.accumulator(0), jaccard.sets

    def counting(block, size):
        cut.add(block.num_rows)
        return real(block, size)

    monkeypatch.setattr(jaccard, "sets", counting)
    got = {i: c for i, _, c in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, c in got.items() if i != c] == [900, 901] and got[900] == got[901] == 7
    assert 2 * len(rows) < cut.value < 2.2 * len(rows)


@pytest.mark.parametrize("partners", [None, 2])
def test_pairs_across_components(monkeypatch, partners):
    """Whole lists at a time, whatever their place in the batches, in bounded steps; told pairs aren't told again."""
    monkeypatch.setattr(jaccard, "CROSSED", 50)
    rng = np.random.default_rng(4)
    rows = []
    for key in sorted((int(rng.integers(3)), i, j) for i, j in ((0, 0), (0, 1), (1, 1))):
        for _ in range(int(rng.integers(1, 40))):
            cls = int(rng.integers(-90, 90))
            part = key[1] if key[1] == key[2] else int(rng.integers(2))
            rows.append((*key, part, cls, 20 + cls % 9, cls % 4, cls % 5, np.full(jaccard.BRIEF, cls % 3 * 127, np.uint8).tobytes()))
    names = ["list", "i", "j", "own", "cls", "n", "pos", "component", "brief"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 7]]) for k in range(0, len(rows), 7)]
    found = []
    for some in jaccard.whole(iter(batches), names[:3]):
        found.extend(p for a, b in jaccard.across(some, names[:3], 75, partners) for p in zip(a.tolist(), b.tolist()))
    expect = set()
    for x in rows:
        for y in rows:
            if x[:3] == y[:3] and x[7] != y[7] and (x[1] == x[2] or x[3] != y[3]) and x[8] == y[8]:
                if min(x[5] - x[6], y[5] - y[6]) >= jaccard.needed(x[5], y[5], 75):
                    expect.add((min(x[4], y[4]), max(x[4], y[4])))
    assert set(found) == expect if partners is None else set(found) < expect
    told = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
    half = len(found) // 2
    out = []
    for some in (found[:half], found[half:], found):
        told, a, b = jaccard.untold(told, *np.array(some, np.int64).T)
        out.extend(zip(a.tolist(), b.tolist()))
    assert len(out) == len(set(out)) and set(out) == set(found)


@pytest.mark.parametrize("seed", range(20))
def test_divide_skip(seed):
    rng = np.random.default_rng(seed)
    query = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
    others = [np.unique(np.where(rng.random(len(query)) < rng.random() * 0.4, rng.integers(0, 200, len(query)), query).astype(np.uint64)) for _ in range(30)]
    expect = [k for k, o in enumerate(others) if 100 * len(set(o) & set(query)) >= 75 * len(set(o) | set(query))]
    assert sorted(jaccard.search(query, others, 75)) == expect
    bits = [jaccard.parity(x) for x in (query, *others)]
    bound = jaccard.apart([bits[0]] * len(others), bits[1:])
    assert all(b <= len(set(query) ^ set(o)) for b, o in zip(bound, others))


def test_quality_and_toxicity_learn():
    rng = random.Random(5)
    good = [" ".join("".join(rng.choices("abcdeo", k=rng.randint(2, 8))) for _ in range(60)) + "." for _ in range(60)]
    bad = [g.upper().replace(" ", "!! ") for g in good]
    x = quality.statistics(text_of(pa.array(good + bad + ["", None])))
    model = quality.fit(x[:-2], np.array([1.0] * 60 + [0.0] * 60))
    score = model.score(x)
    assert (score[:60] >= 0.3).all() and (score[60:120] < 0.3).all() and ((0 <= score) & (score <= 1)).all()
    assert quality.fit(x[:0], np.zeros(0)).score(x[:2]).tolist() == [1.0, 1.0]
    samples = [g + (" vile" * (1 + i % 5) if i % 2 else "") for i, g in enumerate(good + good)]
    made = [toxicity.terms(text_of(pa.array([s]))) for s in samples]
    ordinal = toxicity.fit([(h, n) for _, h, n in made], np.array([i % 2 for i in range(len(samples))], float))
    above = np.concatenate([ordinal.chances(*m, 1) for m in made])
    assert ((above[:, 0] > 0.5) == [bool(i % 2) for i in range(len(samples))]).all() and (np.diff(above, axis=1) <= 0).all()


def test_language_families():
    rng = random.Random(6)
    letters = {"aa": "abcd", "ab": "abce", "xx": "uvwx", "xy": "uvwz"}
    text = lambda k: " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(30))
    train = [(text(k), k) for k in letters for _ in range(40)]
    model = language.fit(language.shares(text_of(pa.array([t for t, _ in train]))), [k for _, k in train])
    assert [sorted(model.names[i] for i in f) for f in model.families] == [["aa", "ab"], ["xx", "xy"]]
    test = [(text(k), k) for k in letters for _ in range(20)]
    names, scores = model.predict(text_of(pa.array([t for t, _ in test] + ["", "12 !", None])))
    assert np.mean([a == b for a, (_, b) in zip(names, test)]) > 0.95 and names[-3:] == ["und"] * 3 and all(0 <= s <= 1 for s in scores)


def test_filters_keep_columns(spark, corpus):
    labels = spark.createDataFrame([(3, 1), (5, None), (None, 0)], "doc_id long, quality int")
    kept = quality.accepted(corpus, labels)
    assert kept.columns == corpus.columns and kept.count() == corpus.count()
    assert quality.score_quality(corpus, quality.train(corpus, labels)).filter(F.col("score").isNull()).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the operators' own come out as they went in, rows that stay are whole."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    item = " ".join(words[:30])
    texts = [item, " ".join(rng.choices(words, k=400)), " ".join(words[50:90]), " ".join(words[50:90]), None, "", "x " + " ".join(words[100:140]) + " " + item]
    names = ["items", "n_words", "_id", "_bit", "_word", "_own_id", "_own_hash", "_maybe", "_hash", "_gone", "_bits", "_row", "_text", "contaminated"]
    rows = [(i if i != 3 else None, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([("a", item), ("b", " ".join(words[140:170])), (None, None)], "item_id string, text string")
    clean = [r for r in rows if not brute_judged(r[1], [("a", item), ("b", " ".join(words[140:170]))])]
    for size in (1 << 20, 60):
        assert sorted(map(tuple, decontaminate.clean(df, bench, group_bytes=size).collect()), key=repr) == sorted(clean, key=repr)
    kept = [tuple(r) for r in jaccard.one_of_each(df).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r[0] is not None], key=repr)


def brute_judged(text, items):
    n_words, hit, _ = brute_hits(text, items)
    return hit > 0 and 20 * hit >= n_words


def test_sketches_add_up(spark):
    """Rows of one shingle in many tasks: the sums stand out as those of one task do."""
    hot = "a b c d e"
    docs = spark.createDataFrame([(i, f"{hot} {' '.join(f'w{i}x{j}' for j in range(30))}") for i in range(300)], "doc_id long, text string")
    flags = [jaccard.frequent(jaccard.classes(docs.repartition(n), 5).persist()) for n in (1, 90)]
    assert (flags[0] == flags[1]).all() and int(np.unpackbits(flags[0]).sum()) == 1
    h = jaccard.shingles(jaccard.words(text_of(pa.array([hot])), jaccard.GRAPHIC), 5)[1]
    assert jaccard.stands_out(h, flags[1]).all()


@pytest.mark.parametrize("gap", [0.0, 0.5, 50.0, 5000.0])
def test_calibration_of_separable_scores(gap):
    """Classes that a threshold parts get chances on its two sides, whatever their distance and sizes."""
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.86).astype(float)
    raw = rng.standard_normal(4000) + gap * (2 * y - 1)
    slope, intercept = learning.platt(raw, y)
    p = learning.sigmoid(slope * raw + intercept)
    assert slope > 0 if gap else True
    assert abs(p.mean() - y.mean()) < 0.01
    if gap >= 50:
        assert (p[y == 1] > 0.9).all() and (p[y == 0] < 0.1).all()
