"""Secrets in sums and phrases, ids that hold a third of the rows, and classifiers on odd rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import fingerprints, language, quality, secret_scan, toxicity


def literals(text):
    return [text[a:b] for a, k, b in secret_scan.scan(text) if secret_scan.KINDS[k] == "literal"]


def test_phrases_and_sums():
    assert literals('db_passphrase = "two words 81"') == ["two words 81"]
    assert literals('passphrase: "no digits at all"') == ["no digits at all"]
    assert literals('api_secret = "Ab3x" + "9Zq7"') == ["Ab3x", "9Zq7"]
    assert literals('a = "Ab3x"\nb = "9Zq7"\nclient_secret = a + b\n') == ["Ab3x", "9Zq7"]
    assert literals('password: "enter your password here"\nkey = "two words 81"\ntitle = "chapter 12 of it"') == []
    assert literals('secret = "" + "Ab3x9Zq7"') == ["Ab3x9Zq7"] and literals('secret = "" + ""') == []
    assert literals('x = y\ny = x\npassword = x') == []


def test_long_sums_are_scored_by_part():
    parts = ["Zx81qP0m"] * (secret_scan.PARTS + 1)
    assert literals("secret_key = " + " + ".join(f'"{p}"' for p in parts)) == parts
    grown = 'v = "Ab3x"\n' + 'v = v + "9Zq7"\n' * 3 + "auth_token = v\n"
    assert literals(grown) == ["Ab3x", "9Zq7", "9Zq7", "9Zq7"]


def test_whole_phrase_is_redacted(spark):
    texts = ['a password = "correct horse battery 42" b', 'x api_secret = "Ab3x" + "9Zq7" y', None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, span_kind int")
    got = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert got == {0: 'a [secret]" b', 1: 'x api_secret = "[secret]" + "[secret]" y', 2: None, 3: ""}


def test_hot_ids_are_cut_by_text(spark):
    """Null ids, and one id, hold a third of the rows each; some texts are equal."""
    rows = [(None, f"null text {i // 2} and more") for i in range(600)] + [(700, f"same id {i} " * (i % 5)) for i in range(600)] + [(i, f"own {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_fingerprints(df).collect())
    assert got == want
    sizes = [r["count"] for r in fingerprints.neighbours(df).groupBy("range").count().collect()]
    assert sum(sizes) >= len(rows) and max(sizes) <= len(rows) / 5


@pytest.fixture(scope="module")
def taught(spark, corpus):
    """The odd rows, and rows to learn from: two languages, two qualities, toxic ones."""
    good, bad = "The committee reviewed the annual report and approved it . ", "buy now !!! cheap cheap $$$ click "
    rows = [(1000 + i, (good if i % 2 else bad) * (2 + i % 7) + ("you vile filthy moron " if i % 3 == 0 else ""), "aa" if i % 2 else "bb", None, None, None, None) for i in range(240)]
    docs = corpus.unionByName(spark.createDataFrame(rows, corpus.schema))
    labels = [(r[0], r[0] % 2, int((r[0] - 1000) % 3 == 0)) for r in rows] + [(None, 1, 1), (1001, None, None), (1002, 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_odd_rows(spark, taught):
    docs, labels = taught
    n = docs.count()
    told = quality.classify(docs, labels).collect()
    assert len(told) == n and all(0 <= r.score <= 1 for r in told)
    assert all(r.predicted == r.doc_id % 2 for r in told if (r.doc_id or 0) >= 1000)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 1000").count() == 120
    graded = toxicity.severities(docs, labels).collect()
    assert len(graded) == n and all(0 <= r.severity <= 3 for r in graded)
    assert all(r.predicted == int((r.doc_id - 1000) % 3 == 0) for r in graded if (r.doc_id or 0) >= 1000)
    named = language.identify(docs, language.learn(docs.withColumn("lang", F.when(F.col("doc_id") >= 1000, F.col("lang")))), keep=["doc_id", "n_words"]).collect()
    assert len(named) == n and all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in named if (r.doc_id or 0) >= 1000)
    assert {r.lang_pred for r in named if r.doc_id in (0, 1, 2)} == {"und"}


def test_classifiers_on_empty_tables(spark, taught):
    docs, labels = taught
    none = docs.limit(0)
    assert quality.classify(none, labels).count() == toxicity.severities(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert language.identify(docs, language.learn(none), keep=["doc_id"]).filter("lang_pred <> 'und'").count() == 0
