"""The registered queries of the corpus operators and their SQL, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.llm.common import importable
from netquill.llm.exact_dedup import exact_duplicates
from netquill.llm.langid import identify
from netquill.llm.license_scan import scan as scan_licenses
from netquill.llm.license_scan import sql as license_sql
from netquill.llm.lm_score import held_fold
from netquill.llm.lm_score import score as score_texts
from netquill.llm.near_dedup import near_duplicates
from netquill.llm.ngram_join import similar_components
from netquill.llm.packing import pack
from netquill.llm.piece_sampling import round_trip
from netquill.llm.suffix_dedup import removal_report
from netquill.llm.topk_search import top_k
from netquill.llm.toxicity import fit as fit_toxicity
from netquill.llm.toxicity import score as score_toxicity
from netquill.llm.turn_repair import damaged, report
from netquill.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it lies in the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""


@query("op4_exact_dedup", EXACT_SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""


@query("op10_exact_topk", TOPK_SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op6_toxicity_chain")
def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op7_license_scan", license_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


@query("op8_piece_sampling")
def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query("op3_curve_packing")
def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def components_sql(words: int, kept: str = "") -> str:
    """Components of documents whose sets of ``words``-word shingles link, compared pair by pair and followed link by link."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
every AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' '))
                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
sets AS (SELECT DISTINCT doc_id, s FROM every),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id{kept}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id
"""


@query("op1_near_dedup", components_sql(5, ", min(r.root) = d.doc_id AS kept"))
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), held_fold())


@query("op13_ngram_join", components_sql(4))
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


REPAIR_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (
  SELECT *, (4294967295 - list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT))) % 20 AS code FROM named),
hit AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM coded WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS copy,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hit),
faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 1 WHEN copy > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last FROM faults GROUP BY conv_id),
machine(q, letter, role, q2) AS (VALUES (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
walk(conv_id, pos, q, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'kept': CAST([] AS VARCHAR[])} FROM counts
  UNION ALL
  SELECT conv_id, pos, q, min(best) FROM (
    WITH none AS (SELECT w.conv_id, w.pos, w.q, w.best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.pos < c.last),
    one AS (SELECT n.conv_id, n.pos, m.q2 AS q, {'cost': n.best.cost + 5, 'audit': n.best.audit || 'I', 'kept': n.best.kept || [m.role || ':']} AS best FROM none n JOIN machine m ON m.q = n.q),
    two AS (SELECT n.conv_id, n.pos, m.q2 AS q, {'cost': n.best.cost + 5, 'audit': n.best.audit || 'I', 'kept': n.best.kept || [m.role || ':']} AS best FROM one n JOIN machine m ON m.q = n.q),
    ready AS (SELECT * FROM none UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two),
    facing AS (SELECT r.conv_id, r.q, r.best, f.pos, f.role, f.text, f.initial, f.fault, CASE WHEN f.fault = 3 THEN 5 ELSE 0 END AS extra, m.letter, m.role AS wanted, m.q2
               FROM ready r JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.pos = r.pos + 1 JOIN machine m ON m.q = r.q)
    SELECT conv_id, pos, q, {'cost': best.cost + 2, 'audit': best.audit || 'D', 'kept': best.kept} AS best FROM facing
    UNION ALL SELECT conv_id, pos, q2, {'cost': best.cost + 1 + extra, 'audit': best.audit || 'R', 'kept': best.kept || [wanted || ':' || text]} FROM facing WHERE fault NOT IN (1, 2)
    UNION ALL SELECT conv_id, pos, q2, {'cost': best.cost + extra, 'audit': best.audit || 'K', 'kept': best.kept || [role || ':' || text]} FROM facing WHERE fault NOT IN (1, 2) AND initial = letter
    UNION ALL SELECT conv_id, pos, 1, {'cost': best.cost + extra, 'audit': best.audit || 'K', 'kept': best.kept || [role || ':' || text]} FROM facing WHERE fault NOT IN (1, 2) AND initial = 's' AND q = 0
  ) GROUP BY conv_id, pos, q),
ended AS (
  SELECT w.conv_id, min(CASE w.q WHEN 1 THEN {'cost': best.cost + 10, 'audit': best.audit || 'II', 'kept': best.kept || ['user:', 'assistant:']}
                                 WHEN 2 THEN {'cost': best.cost + 5, 'audit': best.audit || 'I', 'kept': best.kept || ['assistant:']} ELSE best END) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.last = w.pos GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_turn_repair", REPAIR_SQL)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present=F.col("present"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
