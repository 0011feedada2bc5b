import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls in every column, empty texts, ties and repeated rows, a long text, clashing names."""
    import random

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base = prose(80)
    near = base.split(" ")
    near[40] = "CHANGED"
    texts = [None, "", " \n", base, base, " ".join(near), prose(3), prose(40), prose(9000), "É " + prose(30), 'token = "abcdef123456" ' + prose(5), prose(12) + "\n" + prose(12)]
    rows = [(i, t, "en", "s", len(t or ""), None, None) for i, t in enumerate(texts)]
    rows += [rows[7], (None, prose(20), None, None, None, 1.0, 2), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, KIND)
