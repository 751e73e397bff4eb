"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.byte_bpe import bpe_query
from scorelake.llm.byte_cnn import language_query
from scorelake.llm.common import table
from scorelake.llm.merkle import verified
from scorelake.llm.pitman_yor import language_model_query
from scorelake.llm.quality_rules import quality_query
from scorelake.llm.secret_scan import secrets_query
from scorelake.llm.simhash_groups import simhash_query
from scorelake.llm.source_mixing import mixing_query
from scorelake.llm.spaced_seeds import decontamination_query
from scorelake.llm.surrogates import surrogate_query
from scorelake.llm.token_shards import token_output
from scorelake.llm.warc_segments import warc_query
from scorelake.llm.whitening import whitening_query


def op1_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogate_query(table(spark, folder, "documents"))


def op2_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return language_model_query(table(spark, folder, "documents"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_query(table(spark, folder, "documents"))


def op4_adaptive_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_query(table(spark, folder, "documents"))


def op5_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    return warc_query(table(spark, folder, "pages"))


def op6_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_query(table(spark, folder, "documents"))


def op7_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination_query(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return language_query(table(spark, folder, "documents"))


def op9_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return token_output(table(spark, folder, "documents"))


def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_query(table(spark, folder, "documents"))


def op11_weighted_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening_query(table(spark, folder, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verified(table(spark, folder, "documents"), keep_proof=False)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_query(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii_surrogates, op2_pitman_yor, op3_secret_scan, op4_adaptive_quality, op5_warc_segments, op6_temperature_mixing, op7_spaced_seeds,
        op8_byte_cnn, op9_token_shards, op10_simhash_groups, op11_weighted_whitening, op12_merkle_manifest,
        op13_byte_bpe)
}

# Quality rules: the measures from words and lines as lists, the sketches as counts, the fences from their quartiles.
_FLOOR = "CASE WHEN {b} < 32 THEN {b} ELSE (32 + ({b} + 128) % 32)::BIGINT << (({b} + 128) // 32 - 5)::INTEGER END"
_QUALITY_SQL = r"""WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, source, coalesce(text, '') t FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls FROM d),
 g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) c FROM (
  SELECT rid, i, array_to_string(ws[i:i + 4], chr(1)) v FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) i FROM w WHERE len(ws) >= 5))),
 rep AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 5)) p FROM g WHERE c > 1) GROUP BY rid),
 m AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words, len(ls)::BIGINT n_lines, len(regexp_extract_all(t, '\p{Lu}'))::BIGINT n_capitals
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM m),
 r AS (SELECT rid, lang, source, unnest([{measure: 'word_length', v: 1000 * word_chars // n_words}, {measure: 'symbols', v: 1000 * n_symbols // n_words}, {measure: 'capitals', v: 1000 * n_capitals // n_words},
  {measure: 'dup_lines', v: 1000 * n_dup_lines // n_lines}, {measure: 'repeats', v: 1000 * n_repeat_words // n_words}], recursive := true) FROM f WHERE NOT base_failed),
 b AS (SELECT *, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 1) * 32 + ((v >> greatest(length(bin(v)) - 6, 0)::INTEGER) & 31) - 128 END bucket FROM r),
 own AS (SELECT lang, source, measure, max(n) n, min(bucket) FILTER (upto * 4 >= n) b1, min(bucket) FILTER (upto * 4 >= n * 3) b3 FROM (
  SELECT lang, source, measure, bucket, count(*) OVER (PARTITION BY lang, source, measure ORDER BY bucket) upto, count(*) OVER (PARTITION BY lang, source, measure) n FROM b) GROUP BY ALL),
 bylang AS (SELECT lang, measure, max(n) n, min(bucket) FILTER (upto * 4 >= n) b1, min(bucket) FILTER (upto * 4 >= n * 3) b3 FROM (
  SELECT lang, measure, bucket, count(*) OVER (PARTITION BY lang, measure ORDER BY bucket) upto, count(*) OVER (PARTITION BY lang, measure) n FROM b) GROUP BY ALL),
 overall AS (SELECT measure, min(bucket) FILTER (upto * 4 >= n) b1, min(bucket) FILTER (upto * 4 >= n * 3) b3 FROM (
  SELECT measure, bucket, count(*) OVER (PARTITION BY measure ORDER BY bucket) upto, count(*) OVER (PARTITION BY measure) n FROM b) GROUP BY ALL),
 pick AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= 50 THEN o.b1 WHEN l.n >= 50 THEN l.b1 ELSE a.b1 END p1, CASE WHEN o.n >= 50 THEN o.b3 WHEN l.n >= 50 THEN l.b3 ELSE a.b3 END p3
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN overall a ON o.measure = a.measure),
 q AS (SELECT lang, source, measure, FLOOR1 q1, FLOOR3 q3 FROM pick),
 z AS (SELECT lang, source, measure, CASE WHEN measure = 'word_length' THEN q1 - greatest(3 * (q3 - q1), 1500) END lo,
  q3 + greatest(3 * (q3 - q1), CASE measure WHEN 'word_length' THEN 2500 WHEN 'symbols' THEN 150 WHEN 'capitals' THEN 600 WHEN 'dup_lines' THEN 300 ELSE 160 END) hi FROM q),
 bad AS (SELECT DISTINCT rid FROM r JOIN z ON r.lang IS NOT DISTINCT FROM z.lang AND r.source IS NOT DISTINCT FROM z.source AND r.measure = z.measure WHERE v > hi OR v < lo)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) kept FROM f"""

# WARC: the digest in base 32, five hexadecimal digits to four letters, and the page that answers for a payload.
_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), a AS (SELECT *, max(page_id) OVER (PARTITION BY h) answer, sha1(h) x FROM p)
 SELECT page_id, octet_length(encode(h))::BIGINT payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(x, (k // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') payload_digest,
  CASE WHEN answer IS NULL OR page_id = answer THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id IS DISTINCT FROM answer THEN answer END refers_to FROM a"""


def _merkle_sql(levels: int = 16) -> str:
    """Merkle manifest: per tree the lists of all levels, then the siblings and the folded digest level by level; up to 3^levels nodes a tree."""
    field = "coalesce(octet_length(encode({0}))::VARCHAR||':'||{0}, '-')"
    fields = [field.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")]
    leaf = lambda text: "sha256(" + "||".join([*fields, field.format(text)]) + ")"
    # CRC-32 of the digits, bit by bit; only its lowest bit is asked for.
    byte = "list_reduce(list_concat([xor(crc, ascii(c)::BIGINT)], range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    digits = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295], {digits}), lambda crc, c: {byte.replace('ascii(c)::BIGINT', 'c')}), 4294967295)"
    nodes = lambda l: f"CASE WHEN len({l}) = 1 THEN {l} ELSE list_transform(range(0, (len({l}) + 2) // 3), lambda i: sha256(array_to_string({l}[3 * i + 1:3 * i + 3], ''))) END"
    out = [f"""WITH d AS (SELECT doc_id, source, coalesce('+'||source, '') tree, {leaf('text')} leaf,
     CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END tampered FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rnk FROM d),
     s0 AS (SELECT tree, list(leaf ORDER BY rnk) l0 FROM r GROUP BY tree)"""]
    out += [f"s{k + 1} AS (SELECT *, {nodes(f'l{k}')} l{k + 1} FROM s{k})" for k in range(levels)]
    out.append(f"subs AS (SELECT *, l{levels}[1] subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS srnk FROM s{levels})")
    out.append("t0 AS (SELECT list(subroot ORDER BY srnk) h0 FROM subs)")
    out += [f"t{k + 1} AS (SELECT *, {nodes(f'h{k}')} h{k + 1} FROM t{k})" for k in range(levels)]
    out.append(f"f0 AS (SELECT r.doc_id, r.leaf, subs.subroot, t.h{levels}[1] root, r.tampered fold, '' proof, r.rnk, subs.srnk, {', '.join(f'l{k}, h{k}' for k in range(levels))} FROM r JOIN subs USING (tree) CROSS JOIN t{levels} t)")
    number = 0
    for kind, rank in (("l", "rnk"), ("h", "srnk")):
        for k in range(levels):
            place = f"({rank} // {3 ** k})"
            before, after = (f"array_to_string({kind}{k}[{a}:{b}], '')" for a, b in ((f"{place} // 3 * 3 + 1", place), (f"{place} + 2", f"{place} // 3 * 3 + 3")))
            out.append(f"f{number + 1} AS (SELECT * REPLACE (CASE WHEN len({kind}{k}) = 1 THEN fold ELSE sha256({before}||fold||{after}) END AS fold, CASE WHEN len({kind}{k}) = 1 THEN proof ELSE proof||{before}||{after} END AS proof) FROM f{number})")
            number += 1
    return ", ".join(out) + f" SELECT doc_id, leaf, subroot, root, sha256(proof) proof_sha256, fold folded_root, fold = root AS verified FROM f{number}"


CHECKS: dict[str, str] = {
    "op12_merkle_manifest": _merkle_sql(),
    "op4_adaptive_quality": _QUALITY_SQL.replace("FLOOR1", _FLOOR.format(b="p1")).replace("FLOOR3", _FLOOR.format(b="p3")),
    "op5_warc_segments": _WARC_SQL,
}
