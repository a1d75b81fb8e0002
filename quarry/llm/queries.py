"""Registered queries of this subpackage and their DuckDB oracles.

Each ``opN_<name>`` applies one operator, with production parameters, to its
whole table; what SQL cannot express is tested against brute force in
``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import conversations, decontam, fingerprint, licences, lm, negatives, packing, pii, quality, shards, simhash, urls, warc
from quarry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset fingerprints of every document and its edited copy."""
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


@_query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or boosted-tree verdict for every page url."""
    return urls.judge(table(spark, sf_dir, "pages"))


@_query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes by histogram sort."""
    placed = shards.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing packing of all documents into sequences of 4096 tokens."""
    import public_tokenizers

    _, places = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return places


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard WARC archives and read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""


@_query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and random-field spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train_on(docs))


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all documents."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact benchmark windows in every document, and items gathered in one place, through the positional index."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, stretch=2)


# Words of an ASCII-lowered text; windows of the lengths that the items have, joined on their text.
ORACLE["op6_decontamination"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM bw, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
wins AS (SELECT DISTINCT size, win FROM items),
spot AS (
  SELECT d.r, t.i, s.size, array_to_string(d.w[t.i : t.i + s.size - 1], ' ') AS win
  FROM dw d, (SELECT DISTINCT size FROM wins) s, unnest(range(1, len(d.w) - s.size + 2)) AS t(i)),
hit AS (SELECT spot.r, spot.i, spot.size, spot.win FROM spot JOIN wins ON spot.size = wins.size AND spot.win = wins.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT hit.r, CAST(items.item_id AS VARCHAR) AS item FROM hit JOIN items ON hit.size = items.size AND hit.win = items.win) GROUP BY r),
need AS (SELECT k, item_id, 2 * len(w) AS width, len(list_distinct(w)) AS n, unnest(list_distinct(w)) AS word FROM bw WHERE len(w) > 0),
pos AS (SELECT r, i, w[i] AS word FROM dw, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i] IN (SELECT word FROM need)),
able AS (SELECT p.r, need.k FROM (SELECT DISTINCT r, word FROM pos) p JOIN need ON p.word = need.word GROUP BY p.r, need.k, need.n HAVING count(*) = need.n),
place AS (SELECT able.r, able.k, need.item_id, need.width, need.n, pos.i, pos.word FROM able JOIN need ON able.k = need.k JOIN pos ON pos.r = able.r AND pos.word = need.word),
close AS (
  SELECT a.r, a.k, a.item_id FROM place a JOIN place b ON a.r = b.r AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.width
  GROUP BY a.r, a.k, a.item_id, a.i, a.n HAVING count(DISTINCT b.word) = a.n),
near AS (SELECT r, count(*) AS n_near FROM (SELECT DISTINCT r, item_id FROM close) GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(named.n_items, 0) AS n_items,
  sha256(coalesce(named.items, '')) AS items_sha256, words.n_hit IS NOT NULL AS contaminated, coalesce(near.n_near, 0) AS n_near
FROM dw LEFT JOIN words USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)
"""


@_query
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-mixing log-probabilities of all documents."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_query
def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return licences.report(licences.scan(table(spark, sf_dir, "documents")), len(licences.PHRASES))


def _licence_sql() -> str:
    """Templates as rows (number, label, least words in place, word, position, is key), then line-ups by plain joins."""
    rows = []
    for t in licences.Index((*licences.PHRASES, *licences.NOTICES)).templates:
        vocabulary = licences.words_of((*licences.PHRASES, *licences.NOTICES)[t.number].text)
        rows += [f"({t.number}, '{t.label}', {t.least}, '{w.decode()}', {i}, {str(i in t.key).lower()})" for i, w in enumerate(vocabulary)]
    return r"""
WITH t(tmpl, label, least, word, pos, key) AS (VALUES """ + ",\n".join(rows) + r"""),
size AS (SELECT tmpl, label, least, count(*) AS words, count(*) FILTER (WHERE key) AS keys FROM t GROUP BY ALL),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT r, w[i] AS word, i - 1 AS pos FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] IN (SELECT word FROM t)),
entry AS (SELECT DISTINCT ON (tmpl) tmpl, word, pos FROM t WHERE key ORDER BY tmpl, pos),
starts AS (SELECT r, tmpl, f.pos - entry.pos AS start FROM f JOIN entry ON f.word = entry.word),
met AS (
  SELECT s.r, s.tmpl, s.start, count(*) AS hits, count(*) FILTER (WHERE t.key) AS keys
  FROM starts s JOIN t ON t.tmpl = s.tmpl JOIN f ON f.r = s.r AND f.pos = s.start + t.pos AND f.word = t.word GROUP BY ALL),
place AS (
  SELECT met.r, met.tmpl, size.label, greatest(met.start, 0) AS start, met.hits / size.words AS share
  FROM met JOIN size ON met.tmpl = size.tmpl WHERE met.keys = size.keys AND met.hits >= size.least),
doc AS (
  SELECT r, count(*) FILTER (WHERE tmpl < 3) AS n_base, min(start) FILTER (WHERE tmpl < 3) AS first_word, max(start) FILTER (WHERE tmpl < 3) AS last_word, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE tmpl < 3) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM place GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN doc ON d.r = doc.r
"""


ORACLE["op12_licences"] = _licence_sql()


@_query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least repair of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_report(rows, conversations.damage(rows))


def _conversation_sql() -> str:
    """A forward pass per row: the best (cost, audit, repaired rows) of the four states."""
    def put(state: str, cost: str, letter: str, line: str | None) -> str:
        out = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}}"

    def best(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def free(state: str, cost: str, letter: str, line: str, when: str = "true") -> str:
        return f"CASE WHEN NOT must_go AND {when} THEN {put(state, cost, letter, line)} ELSE {none} END"

    none = "{'c': 1000000000, 'a': '', 'o': []::VARCHAR[]}"
    user, assistant, own = "'user:' || text", "'assistant:' || text", "role || ':' || text"
    closed = f"SELECT conv, i, n0 AS s0, n1 AS s1, e2 AS s2, {best('n3', put('e2', '2', 'I', chr(39) + 'assistant:' + chr(39)))} AS s3 FROM (SELECT *, {best('n2', *[put(s, '2', 'I', chr(39) + 'user:' + chr(39)) for s in ('n0', 'n1', 'n3')])} AS e2 FROM ("
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS VARCHAR) AS k FROM conversations),
{_CRC_SQL}
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM d JOIN crc USING (k) WHERE f <> 0),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (
  SELECT ids.conv, turn, role, text, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS body, row_number() OVER (PARTITION BY ids.conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
flagged AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS earlier FROM numbered),
lines AS (SELECT *, blank OR again AS must_go, CAST(cut AS INTEGER) AS pays FROM flagged),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT again) AS truncated, count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM lines GROUP BY conv),
walk AS (
  {closed}SELECT conv, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS n0, {none} AS n1, {none} AS n2, {none} AS n3 FROM ids))
  UNION ALL
  {closed}SELECT lines.conv, lines.i, {put('s0', '3', 'D', None)} AS n0,
    {best(put('s1', '3', 'D', None), free('s0', 'pays', 'K', own, "initial = 's'"))} AS n1,
    {best(put('s2', '3', 'D', None), *[w for s in ('s0', 's1', 's3') for w in (free(s, 'pays', 'K', own, "initial = 'u'"), free(s, '2 + pays', 'R', user))])} AS n2,
    {best(put('s3', '3', 'D', None), free('s2', 'pays', 'K', own, "initial = 'a'"), free('s2', '2 + pays', 'R', assistant))} AS n3
  FROM walk JOIN lines ON lines.conv = walk.conv AND lines.i = walk.i + 1))),
final AS (SELECT conv, i, {best('s0', 's3')} AS s FROM walk)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(final.s.c AS BIGINT) AS cost, final.s.a AS audit, sha256(array_to_string(final.s.o, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv = ids.conv JOIN final ON final.conv = ids.conv AND final.i = coalesce(counts.n, 0)
"""


# crc32 modulo 20 of every distinct key, bit by bit: 8 steps per character
_CRC_SQL = """keys AS (SELECT DISTINCT k FROM d),
bits(k, step, v) AS (
  SELECT k, 0, 4294967295::BIGINT FROM keys
  UNION ALL
  SELECT k, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT k, step, CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(k, step // 8 + 1, 1))) ELSE v END AS x FROM bits WHERE step < 8 * length(k))),
crc AS (SELECT k, xor(v, 4294967295) % 20 AS f FROM bits WHERE step = 8 * length(k)),"""

ORACLE["op13_conversations"] = _conversation_sql()


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


# Anchors against all rows; list_sum of products of whole numbers is exact in doubles.
ORACLE["op11_hard_negatives"] = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS pn FROM s WHERE same) WHERE pn <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.pn ORDER BY s.score DESC, s.vec_id, s.br) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
