"""Registered queries of this package, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgrid.llm import bpe, collocations, exact_dedup, langid, mixture, pieces, quality, simhash, spelling, token_counts, topk, training_order, warc
from gapgrid.llm.common import read_table

#: Whole-number weights of nodes among their siblings; names not listed weigh 1.
MIX_WEIGHTS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2}, "source": {"src0": 1}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 50, 4, 42


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = langid.identify(docs, ~held)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.graded(docs.select("doc_id", "text"), labels).select("doc_id", "expected_grade", "tail_probability", "selected")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode_documents(pieces.encode_documents(read_table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_language_id, op3_simhash, op4_training_order, op5_mixture, op6_exact_dedup, op7_token_counts, op8_top_k, op9_quality,
                            op10_byte_bpe, op11_spelling, op12_collocations, op13_sentencepiece, pipeline)}


def _weight(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(level, {}).items()) + " ELSE 1 END"


def _level(name: str, children: str, parent: str, level: str) -> str:
    """SQL of one level of the tree: ``children`` has capacity and budget of the parent."""
    by = f"PARTITION BY {parent}" if parent else "PARTITION BY 1"
    before = f"OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_w AS (SELECT *, {_weight(level)} AS w, capacity / ({_weight(level)}) AS ratio FROM {children}),
{name}_l AS (SELECT *, (budget - coalesce(sum(capacity) {before}, 0)) / (sum(w) OVER ({by}) - coalesce(sum(w) {before}, 0)) AS lvl FROM {name}_w),
{name}_f AS (SELECT *, max(CASE WHEN lvl <= ratio THEN lvl END) OVER ({by}) AS water FROM {name}_l),
{name} AS (SELECT * EXCLUDE (w, ratio, lvl, water, budget), CAST(CASE WHEN water IS NULL OR ratio <= water THEN capacity ELSE least(capacity, floor(water * w)) END AS BIGINT) AS budget FROM {name}_f)"""


MIX_SQL = f"""WITH d AS (SELECT doc_id, 'domain' || CAST((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4 AS VARCHAR) AS domain,
 coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS capacity FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, CAST((SELECT sum(tokens) FROM leaf) * {MIX_PERCENT} // 100 AS BIGINT) AS budget FROM leaf GROUP BY ALL),
{_level("a1", "n1", "", "domain")},
n2 AS (SELECT l.domain, l.lang, CAST(sum(l.capacity) AS BIGINT) AS capacity, any_value(a1.budget) AS budget FROM leaf l JOIN a1 USING (domain) GROUP BY l.domain, l.lang),
{_level("a2", "n2", "domain", "lang")},
n3 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, a2.budget FROM leaf l JOIN a2 USING (domain, lang)),
{_level("a3", "n3", "domain, lang", "source")},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM a3),
o AS (SELECT d.*, epochs, rest, substr(md5('{MIX_SEED}:' || CAST(epochs AS VARCHAR) || ':' || CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 15) AS h FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS cum FROM o)
SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c"""

#: A phrase of several words starts at each place of the table of words; its parts are looked up by their text.
PHRASE_SQL = """WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda w: w <> '') AS w FROM d),
t AS (SELECT lang, count(*)::HUGEINT AS n FROM (SELECT lang, unnest(w) FROM p) GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS a FROM p, range(1, 6) s(m), LATERAL unnest(range(1, len(w) - m + 2)) u(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT g.lang, phrase, m, a, k, array_to_string((string_split(phrase, ' '))[:k], ' ') AS front, array_to_string((string_split(phrase, ' '))[k + 1:], ' ') AS back FROM g, range(1, 5) s(k) WHERE k < m),
s AS (SELECT c.lang, c.phrase, c.m, c.a, x.a AS l, y.a AS r, t.n, k, 1000 * c.a * t.n // (x.a * y.a) AS score FROM c JOIN t USING (lang)
 JOIN g x ON x.lang = c.lang AND x.phrase = front JOIN g y ON y.lang = c.lang AND y.phrase = back),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
e AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = b.lang AND g.m > b.m AND 100 * g.a >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM e)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op12_collocations": PHRASE_SQL,
    "op5_mixture": MIX_SQL,
    "op6_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
