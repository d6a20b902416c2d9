"""The numbered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import bpe, chat, decontaminate, language, lexical, minhash, pii, repeats, sharding, simhash, token_files, topk, turns
from strideframe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = f"'{UPPER}', '{UPPER.lower()}'"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read(spark, sf_dir, "documents"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


ORACLES["op3_topk"] = """WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20"""


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


ORACLES["op11_minhash"] = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x20\x09-\x0D]+') AS words FROM documents),
  p AS (SELECT row, len(words) AS many, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
  q AS (SELECT row, many, pos, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g FROM p WINDOW o AS (PARTITION BY row ORDER BY pos)),
  g AS (SELECT DISTINCT row, g FROM q WHERE pos = 1 OR pos <= many - 4),
  n AS (SELECT row, count(*) AS n FROM g GROUP BY row),
  c AS (SELECT a.row AS x, b.row AS y, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.row <> b.row GROUP BY a.row, b.row),
  e AS (SELECT x, y FROM c JOIN n a ON a.row = x JOIN n b ON b.row = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
  r AS (SELECT row, row AS root FROM w UNION SELECT y, root FROM r JOIN e ON row = x),
  m AS (SELECT r.row, min(w.doc_id) AS component_id FROM r JOIN w ON w.row = r.root GROUP BY r.row)
  SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM w JOIN m USING (row) LEFT JOIN n USING (row)"""


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents"))


ORACLES["op12_lexical"] = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
  c AS (SELECT (count(*) FILTER (len(terms) > 0))::BIGINT AS many, sum(len(terms))::BIGINT AS total FROM d),
  p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * any_value(many) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term),
  i AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * many) // total)))))::BIGINT AS score
    FROM i JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op13_turns"] = r"""WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
  k AS (SELECT row_number() OVER () AS row, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
  d AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
  a AS (SELECT row, copy, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d, range(2) x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
  o AS (SELECT *, coalesce(conv_id, -1) AS conv, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, row, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, row, copy) AS said FROM a),
  f AS (SELECT *, CASE WHEN z = '' THEN 3 WHEN said > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY conv ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS illegal FROM o),
  i(s, q, price, ins, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:'),
    (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
  e(act, price, q, t, need) AS (VALUES ('D', 2, 0, 0, NULL), ('D', 2, 1, 1, NULL), ('D', 2, 2, 2, NULL), ('D', 2, 3, 3, NULL), ('R', 1, 0, 2, NULL), ('R', 1, 1, 2, NULL), ('R', 1, 3, 2, NULL), ('R', 1, 2, 3, NULL),
    ('K', 0, 0, 1, 's'), ('K', 0, 0, 2, 'u'), ('K', 0, 1, 2, 'u'), ('K', 0, 3, 2, 'u'), ('K', 0, 2, 3, 'a')),
  w AS (SELECT conv, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS way FROM f GROUP BY conv
    UNION ALL SELECT conv, pos, state, min(way) FROM (
      SELECT f.conv, f.pos, e.t AS state, {'cost': w.way.cost + i.price + e.price + CASE WHEN f.fault = 1 AND act <> 'D' THEN 5 ELSE 0 END, 'audit': w.way.audit || ins || act,
        'lines': w.way.lines || i.lines || CASE act WHEN 'D' THEN '' ELSE chr(10) || CASE act WHEN 'K' THEN f.role WHEN 'R' THEN CASE e.t WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || f.text END} AS way
      FROM w JOIN f ON f.conv = w.conv AND f.pos = w.pos + 1 JOIN i ON i.s = w.state JOIN e ON e.q = i.q WHERE (act = 'D' OR fault < 2) AND (need IS NULL OR need = f.i)) GROUP BY conv, pos, state),
  b AS (SELECT conv, min({'cost': w.way.cost + i.price, 'audit': w.way.audit || ins, 'lines': w.way.lines || i.lines}) AS way FROM w JOIN i ON i.s = w.state WHERE i.q IN (0, 3) AND w.pos = (SELECT max(pos) FROM f WHERE f.conv = w.conv) GROUP BY conv),
  g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv)
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(way.lines[2:], '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv = coalesce(c.conv_id, -1) LEFT JOIN b ON b.conv = coalesce(c.conv_id, -1)"""


@query
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.audit_damaged(read(spark, sf_dir, "conversations"))
