"""Thin queries over the driver's tables: each applies one operator to its whole table and derives its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import collocations, decontaminate, html, lexical, licenses, mixing, pii, pitman_yor, quality, repeats, sharding, simhash, topk
from terrane.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return near.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", topk.whole(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3, shards=8).digest()


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.kept_words(table(spark, sf_dir, "documents"), window=13, texts_too=False).drop("kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_pitman_yor, op3_simhash, op4_topk, op5_sharding, op6_mixing, op7_html, op8_quality, op9_repeats, op10_decontaminate, op11_lexical, op12_licenses, op13_collocations, pipeline)}

#: Only what DuckDB can express over whole tables; the others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS vector FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op9_repeats": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, unnest(generate_series(1, len(words) - 12)) AS pos, words FROM d WHERE len(words) >= 13
        ), g AS (
            SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS gram FROM w
        ), f AS (SELECT gram, min(doc_id) AS source FROM g GROUP BY gram),
        hit AS (SELECT g.doc_id, g.pos FROM g JOIN f USING (gram) WHERE f.source < g.doc_id),
        gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(generate_series(pos, pos + 12)) AS p FROM hit) GROUP BY doc_id),
        k AS (
            SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
                CASE WHEN places IS NULL THEN words ELSE list_filter(list_transform(words, lambda x, i: CASE WHEN list_contains(places, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS kept
            FROM d LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op11_lexical": r"""
        WITH t AS (
            SELECT d.rowid AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d
        ), f AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY row),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
        q AS (
            SELECT item, item_id, term, count(*) AS times FROM (
                SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
            ) GROUP BY ALL
        ), scored AS (
            SELECT item, item_id, row, f.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
            FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (row), s GROUP BY ALL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p
        ), g AS (
            SELECT lang, k, unnest(list_transform(generate_series(1, len(words) - k + 1), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
            FROM w, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(words) >= k
        ), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
        cut AS (
            SELECT c.*, i, array_to_string(words[1:i], ' ') AS head, array_to_string(words[i + 1:], ' ') AS tail
            FROM c, (SELECT unnest(generate_series(1, 4)) AS i) WHERE i < size
        ), s AS (
            SELECT cut.lang, size, cut.phrase, a, i, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail JOIN n ON n.lang = cut.lang
        ), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        sub AS (
            SELECT lang, inner_phrase, max(a) AS most FROM (
                SELECT c.lang, a, unnest(list_transform(generate_series(1, size - m + 1), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS inner_phrase
                FROM c, (SELECT unnest(generate_series(2, 4)) AS m) WHERE m < size
            ) GROUP BY ALL
        ), kept AS (
            SELECT best.* FROM best LEFT JOIN sub ON sub.lang = best.lang AND inner_phrase = phrase WHERE most IS NULL OR most < a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
        FROM kept QUALIFY rank <= 2000
    """,
}
