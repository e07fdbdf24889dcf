"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanbook.llm import (ann, chat, exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, phrases,
                          ranking, token_counts, token_output, toxicity)
from loanbook.llm.encoding import vocabulary_path
from loanbook.llm.tables import kept, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"),
                                      pattern=token_counts.MASKED, with_text=False)


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


ORACLE["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"), end_id=0)
    return token_output.read_tokens(spark, path)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1,
                        size=2048, with_ids=False)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the dropped ones, and the SHA-256 of the text that stays."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), with_spans=False)


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op11_phrases"] = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (
    SELECT lang, list_slice(w, i, i + k - 1) AS g, count(*) AS f
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest(range(1, 6)) AS k)
    WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= 100 AND len(g) > 1),
held AS (
    SELECT DISTINCT s.lang, s.g
    FROM (SELECT lang, f, list_slice(g, i, i + k - 1) AS g
          FROM (SELECT *, unnest(range(1, len(g))) AS i FROM c), (SELECT unnest(range(2, 5)) AS k)
          WHERE i + k - 1 <= len(g) AND k < len(g)) s
    JOIN c ON c.lang = s.lang AND c.g = s.g AND 100 * s.f >= 100 * c.f),
cuts AS (SELECT *, unnest(range(1, len(g))) AS k FROM c ANTI JOIN held USING (lang, g)),
scored AS (
    SELECT cuts.lang, cuts.g, k, cuts.f AS a, x.f AS l, y.f AS r, n.n,
           ((1000::HUGEINT * cuts.f * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = list_slice(cuts.g, 1, k)
    JOIN f y ON y.lang = cuts.lang AND y.g = list_slice(cuts.g, k + 1, len(cuts.g)) JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score
FROM (SELECT *, array_to_string(g, ' ') AS phrase,
             row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
WHERE rank <= 2000
"""


@query
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLE["op12_ranking"] = """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tot AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, nn),
s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), tot GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


@query
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("""SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                           FROM VALUES (0L, 'user'), (1L, 'assistant') AS t (turn, role)""")
    return chat.digests(kept(chat.render(chat.fold(chat.replay(rows.union(control)))), "chat"))


#: the length of a turn in the template: its text with a backslash more for every control string, and the marks around it
ORACLE["op13_chat"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|/?ROLE\])')) AS body,
           CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7
                ELSE 20 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|/?ROLE\])')) END AS marks
    FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
