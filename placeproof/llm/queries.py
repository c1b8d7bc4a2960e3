"""The registered queries of this package: thin digests of what the operators return."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.llm import chat, fim, language, linededup, mixing, negatives, neighbours, packing, quality, setjoin, tokenids, topk, warc
from placeproof.llm.base import id_remainder, table

#: What both turns of conversation -7 say.
ODD_TURN = "</s>[INST] ok [/INST]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op2_quality_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(id_remainder("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@register
def op3_mix_sources(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@register
def op8_language_kernel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.filter(id_remainder("doc_id", 3) != 1))
    return language.predict(docs, model).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@register
def op9_length_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@register
def op1_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"))


@register
def op7_near_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


@register
def op10_fuzzy_lines(spark, sf_dir):
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_kept", F.char_length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"))


@register
def op6_sketch_join(spark, sf_dir):
    return setjoin.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, num=85, den=100)


@register
def op4_huffman_ids(spark, sf_dir):
    import public_tokenizers
    folder = tokenids.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenids.read_corpus(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op5_warc_revisits(spark, sf_dir):
    folder = warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    found = warc.read_archives(spark, folder, with_payload=False).filter("kind = 'record'")
    def page(c):
        h = F.regexp_extract(c, warc.RECORD_ID.pattern, 1), F.regexp_extract(c, warc.RECORD_ID.pattern, 2)
        return F.conv(F.nullif(F.concat(*h), F.lit("")), 16, -10).cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


@register
def op11_fill_in_middle(spark, sf_dir):
    return fim.verify(fim.assemble(table(spark, sf_dir, "documents", "doc_id", "text")))


@register
def op12_chat_round_trip(spark, sf_dir):
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(odd)
    return chat.read_back(chat.format_conversations(rows)).drop("exact")


@register
def op13_hard_negatives(spark, sf_dir):
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("label", turned)
    return negatives.hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


SQL["op5_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS origin FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (5 * i + 1)::INT, 5))::INT >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM g"""

SQL["op1_exact_top_k"] = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

SQL["op6_sketch_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN a IS NULL OR len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
             ELSE list_distinct(list_transform(range(1, (len(a) - 2)::BIGINT), lambda i: array_to_string(list_slice(a, i, i + 3), ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS x FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY ALL"""

SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
             ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(list_slice(u, 1, least(a, b)), '') AS pre, array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS mid,
             array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS suf FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""

SQL["op12_chat_round_trip"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(<)(\\*/?s>)|(\[)(\\*(?:/?SYS|/?INST|/?ROLE|END)\])', '\1\3_\2\4', 'g')) AS shown,
             CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
                  ELSE 20 + length(regexp_replace(role, '(<)(\\*/?s>)|(\[)(\\*(?:/?SYS|/?INST|/?ROLE|END)\])', '\1\3_\2\4', 'g')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(shown + marks))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

SQL["op13_hard_negatives"] = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
w AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5"""
