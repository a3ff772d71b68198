"""The registered queries over the llm operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, ctph, html_blocks, merkle, mixing, passages, pii, quality, simhash, toxicity, urls, whitening
from quire.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under SimHash of 3-word shingles at two bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality counts and verdicts of all documents."""
    return quality.score(table(spark, sf_dir, "documents"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(more))


ORACLES["op4_chat"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(8 + length(regexp_replace(role || text, '[\[\]<\\]', '..', 'g'))) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role, '>' ORDER BY turn, role, text), '(system>)?user>assistant(>user>assistant)*') AS valid
FROM turns GROUP BY conv_id
"""


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of all documents."""
    return pii.digests(table(spark, sf_dir, "documents"))


@query
def op5_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise-hash fingerprints of all documents and of their edited texts."""
    return ctph.edited_likeness(table(spark, sf_dir, "documents"))


@query
def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share, exact or nearly."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language, and each document's proof against it; every seventh id or so claims one more character."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, F.expr("try_add(n_chars, 1)")).otherwise(F.col("n_chars"))
    return merkle.manifest(table(spark, sf_dir, "documents"), claimed={"n_chars": claim})


ORACLES["op11_merkle"] = """
WITH RECURSIVE fields AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, n_chars,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail,
           list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
               lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc
    FROM documents
), leaves AS (
    SELECT r, doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
           sha256(head || coalesce(strlen(CAST(n AS VARCHAR)) || ':' || n, '-') || tail) AS claim
    FROM (SELECT *, CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM fields)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), lower_levels AS (
    SELECT 0 AS level, g, pos, n, leaf AS node FROM placed
    UNION ALL
    SELECT level + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_levels WHERE n > 1 GROUP BY level, g, pos // 2, n
), tops AS (
    SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM lower_levels WHERE n = 1
), upper_levels AS (
    SELECT 0 AS level, pos, n, node FROM tops
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_levels WHERE n > 1 GROUP BY level, pos // 2, n
), heights AS (
    SELECT g, max(level) AS high FROM lower_levels GROUP BY g
), steps AS (
    SELECT p.r, l.level AS step, (p.pos >> l.level) AS at, s.node
    FROM placed p JOIN (SELECT DISTINCT g, level FROM lower_levels WHERE n > 1) l ON l.g = p.g
    LEFT JOIN lower_levels s ON s.g = p.g AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
    UNION ALL
    SELECT p.r, h.high + u.level, (t.pos >> u.level), s.node
    FROM placed p JOIN tops t ON t.g = p.g JOIN heights h ON h.g = p.g CROSS JOIN (SELECT DISTINCT level FROM upper_levels WHERE n > 1) u
    LEFT JOIN upper_levels s ON s.level = u.level AND s.pos = xor(t.pos >> u.level, 1)
), folds AS (
    SELECT p.r, 0 AS step, p.claim AS node FROM placed p
    UNION ALL
    SELECT f.r, f.step + 1, sha256(CASE WHEN s.node IS NULL THEN f.node WHEN s.at % 2 = 0 THEN f.node || s.node ELSE s.node || f.node END)
    FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step
), proofs AS (
    SELECT r, sha256(coalesce(string_agg(node, '' ORDER BY step), '')) AS proof_sha256, count(*) AS high FROM steps GROUP BY r
)
SELECT p.doc_id, p.leaf, t.node AS subroot, u.node AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = u.node AS verified
FROM placed p JOIN tops t ON t.g = p.g JOIN upper_levels u ON u.n = 1 LEFT JOIN proofs q ON q.r = p.r JOIN folds f ON f.r = p.r AND f.step = coalesce(q.high, 0)
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
