"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from tablescour.llm import (
    backtracking,
    decontaminate,
    derivatives,
    kneser_ney,
    lm_scores,
    mixing,
    personal,
    prefix_trie,
    sequences,
    setsketch,
    spelling,
    vectors,
    wordpieces,
)
from tablescour.session import shared_dir


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_sequences(spark, sf_dir):
    folder = shared_dir(spark, "sequences")
    docs = _table(spark, sf_dir, "documents")
    sequences.write_sequences(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return sequences.read_documents(spark, folder)


def op2_language_model_scores(spark, sf_dir):
    return lm_scores.score_documents(_table(spark, sf_dir, "documents"))


def op3_word_piece_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return wordpieces.piece_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_duplicates(spark, sf_dir):
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark, sf_dir):
    return vectors.top_k(_table(spark, sf_dir, "embeddings"))


def op7_warc_derivatives(spark, sf_dir):
    return derivatives.build(_table(spark, sf_dir, "pages"))


def op8_personal_data(spark, sf_dir):
    return personal.find_personal(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_source_mix(spark, sf_dir):
    thin = mixing.sized(_table(spark, sf_dir, "documents"))
    rows = mixing.drawn(thin, *mixing.plan(thin))
    taken = F.col("whole_draws") * F.col("size") + F.col("part_words")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op11_bpe_round_trip(spark, sf_dir):
    rows = backtracking.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_conversation_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_token_sequences, op2_language_model_scores, op3_word_piece_counts, op4_near_duplicates,
    op5_benchmark_decontamination, op6_exact_top_k, op7_warc_derivatives,
    op8_personal_data, op9_quality_classifier, op10_source_mix, op11_bpe_round_trip,
    op12_conversation_prefix_trie, op13_spelling_variants,
)}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The table of CRC-32 and the checksum of a list ``b`` of bytes.
_CRC_TABLE = """
    SELECT list(c ORDER BY n) AS crc FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
        FROM range(256) t(n))
"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, {b}), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])))"
ORACLE: dict[str, str] = {
    "op4_near_duplicates": rf"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
            FROM docs
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), paths AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM docs
            UNION SELECT reached.a, paths.b FROM reached JOIN paths ON reached.b = paths.a
        ), least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY 1)
        SELECT docs.doc_id, coalesce(sizes.n, 0) AS n_shingles, least.component_id,
               docs.doc_id = least.component_id AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) JOIN least ON least.a = docs.doc_id
    """,
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_conversation_prefix_trie": f"""
        WITH crc AS ({_CRC_TABLE}
        ), turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   {_CRC.format(b="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM turns), crc
        ), sizes AS (SELECT conv_id AS base, count(*) AS m FROM turns GROUP BY 1
        ), built AS (
            SELECT convs.conv_id, p AS d, role, text FROM convs JOIN turns ON turns.conv_id = base WHERE p <= h
            UNION ALL
            SELECT conv_id, p - h + least(h, coalesce(m, 0)), role, text
            FROM turns JOIN convs USING (conv_id) LEFT JOIN sizes USING (base) WHERE p > h
        ), steps AS (
            SELECT conv_id, d, len(text) AS chars,
                   concat(len(role), ':', role, len(text), ':', text) AS step FROM built
        ), prefixes AS (
            SELECT conv_id, 0 AS d, '' AS k, NULL AS parent, 0 AS chars FROM convs
            UNION ALL
            SELECT conv_id, d, string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY d),
                   coalesce(string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
                   chars FROM steps
        ), nodes AS (
            SELECT d, k, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars
            FROM prefixes GROUP BY 1, 2
        ), kids AS (SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
        ), sums AS (
            SELECT above.d, above.k, count(*) FILTER (kids.k IS NULL) AS n_leaves,
                   CAST(sum((below.n_convs - 1) * below.chars) AS BIGINT) AS saved_tokens
            FROM nodes below LEFT JOIN kids USING (d, k)
            JOIN prefixes above ON above.conv_id = below.conv_id AND above.d <= below.d GROUP BY 1, 2
        ), ends AS (
            SELECT d, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
            FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS most FROM prefixes) WHERE d = most GROUP BY 1, 2
        )
        SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs,
               coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM nodes JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k)
        LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.k = nodes.parent
    """,
    "op13_spelling_variants": rf"""
        WITH RECURSIVE crc AS ({_CRC_TABLE}
        ), runs AS (
            SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
            ) GROUP BY 1, 2
        ), hashed AS (
            SELECT run, n, {_CRC.format(b="flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))")} AS h
            FROM runs, crc
        ), words AS (
            SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % len(run)), substr(run, h % len(run) + 2)) ELSE run END AS word,
                   CAST(sum(n) AS BIGINT) AS n
            FROM hashed GROUP BY 1
        ), kept AS (SELECT word, n FROM words WHERE len(word) >= 5 AND n >= 3
        ), shorter AS (
            SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest
            FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM kept)
        ), near AS (
            SELECT DISTINCT a.word, b.word AS other, b.n FROM shorter a JOIN shorter b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT s.word, k.word, k.n FROM shorter s JOIN kept k ON s.rest = k.word
            UNION SELECT k.word, s.word, s.n FROM shorter s JOIN kept k ON s.rest = k.word
        ), best AS (
            SELECT word, other, n AS m, count(*) OVER (PARTITION BY word) AS n_near,
                   row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place
            FROM near
        ), linked AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
            FROM kept LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (word)
        ), chains AS (
            SELECT word, coalesce(form, word) AS at FROM linked
            UNION SELECT chains.word, linked.form FROM chains JOIN linked ON linked.word = chains.at WHERE linked.form IS NOT NULL
        )
        SELECT linked.word, linked.form, chains.at AS root, linked.n, linked.n_near, linked.form_n
        FROM linked JOIN chains USING (word) JOIN linked last ON last.word = chains.at AND last.form IS NULL
    """,
}
