"""The registered queries of this package, with SQL where SQL says the same."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bit_codes, centroids, chat, decontaminate, fingerprints, hard_negatives, jaccard, language, packing, quality, secret_scan, token_files, toxicity
from gridloom.llm.tokens import encoder


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


CONTROL_CHAT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CHAT).alias("text"))
    return chat.digest(chat.format_chat(own.unionByName(more)))


OP1_SQL = r"""
WITH own AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(19 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/s>|/?INST\])', '\1\\\2\3', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*)(/s>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM own GROUP BY conv_id
"""


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.decontaminate(documents(spark, folder).select("doc_id", "text"), table(spark, folder, "benchmark"))
    items = F.array_sort("items")
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT item, len(w) AS n, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, least(n, 13) AS k, array_to_string(w[i : i + least(n, 13) - 1], ' ') AS s FROM bw
), sizes AS (SELECT DISTINCT k FROM windows),
dw AS (
    SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k
), hits AS (
    SELECT r, i, windows.k AS k, item FROM (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM dw) x JOIN windows ON windows.k = x.k AND windows.s = x.s
), words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
), found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    return packing.digest(packing.pack(documents(spark, folder), path), encoder(path, "space").dtype.str)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.severities(documents(spark, folder), table(spark, folder, "labels"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, folder))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, folder), keep=["doc_id"])
    spans = F.arrays_zip("span_kind", "span_from", "span_to")
    text = lambda s: F.concat_ws(":", s["span_kind"], s["span_from"].cast("string"), s["span_to"].cast("string"))
    count = lambda kind: F.size(F.filter("span_kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter(spans, lambda s: s["span_kind"] != "literal"), text), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(spans, text), ",").alias("spans"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    out = language.identify(docs, language.learn(docs), keep=["doc_id"])
    return out.select("doc_id", (language.remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(spark, documents(spark, folder), tokenizer("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(documents(spark, folder), table(spark, folder, "labels"))


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(documents(spark, folder))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", turned))


_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
OP11_SQL = f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}
), s AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score
    FROM v a JOIN v ON len(a.c) = len(v.c) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT a, anchor_id, own, vec_id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k
    FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY k <= 5
)
SELECT anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY a, k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (a, anchor_id, own) WHERE s.label <> own AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""


def op12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return bit_codes.nearest(table(spark, folder, "embeddings"))


#: The exact neighbours: what the search finds as long as no estimate passes its bound.
OP12_SQL = f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c
    FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM (
    SELECT q.r, q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.c, v.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
    FROM v q JOIN v ON len(q.c) = len(v.c) AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
QUALIFY rank <= 10
"""


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))


def _centroid_sql(rounds: int = 3) -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, embedding) - 1 AS n, c FROM v QUALIFY n < 16)",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, m % 16 AS n, m // 16 AS distance FROM (SELECT r, min(16 * CAST(list_dot_product(v.c, v.c) - 2 * list_dot_product(v.c, k.c) + list_dot_product(k.c, k.c) AS BIGINT) + n) AS m FROM v, c{i} k GROUP BY r))"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS (SELECT n, list(CAST((s - ((s % k) + k) % k) // k AS DOUBLE) ORDER BY j) AS c FROM (SELECT n, j, CAST(sum(c[j]) AS BIGINT) AS s, count(*) AS k FROM a{i} JOIN v USING (r), range(1, 65) t(j) GROUP BY n, j) GROUP BY n)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (n))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(n AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c{rounds}.c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (n)"""


OP13_SQL = _centroid_sql()


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_chat_format": (op1_chat_format, OP1_SQL),
    "op2_decontaminate": (op2_decontaminate, OP2_SQL),
    "op3_packing": (op3_packing, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_simhash": (op5_simhash, None),
    "op6_secret_scan": (op6_secret_scan, None),
    "op7_language": (op7_language, None),
    "op8_token_files": (op8_token_files, None),
    "op9_quality": (op9_quality, None),
    "op10_jaccard": (op10_jaccard, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_nearest": (op12_nearest, OP12_SQL),
    "op13_centroids": (op13_centroids, OP13_SQL),
    "pipeline": (pipeline, None),
}
