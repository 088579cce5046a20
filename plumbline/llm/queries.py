"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import (languages, licenses, lines, manifest, mixing, near_dups, nearest, personal_data, quality, ranked,
               repeats, rules, sentencepieces)
from .common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.train_and_identify(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove(read(spark, sf_dir, "documents")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(sentencepieces.encode(read(spark, sf_dir, "documents")))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find(read(spark, sf_dir, "documents")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups(read(spark, sf_dir, "documents"), words=4)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, quality.ratings_of(read(spark, sf_dir, "labels")))
    return quality.grade(docs, model)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest.leaves(docs, {"n_chars": F.col("n_chars") + 1}, tampered)
    return manifest.digests(manifest.manifest(found))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_license_scan, op3_nearest_neighbours, op4_repeated_bytes, op5_sentencepiece,
    op6_personal_data, op7_source_mix, op8_quality_rules, op9_near_duplicates, op10_quality_classifier,
    op11_manifest, op12_ranked_search, op13_line_dedup)}
QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {}

# The words that the schedule takes of a document follow from its place in its source's stream: the
# stream's first ``quota`` words, the stream repeating. Limits of three times the size are shared
# again once here, in the order of limit per weight, as the operator does.
SQL["op7_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
whole AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
cut AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) OVER w, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS others
  FROM whole
  WINDOW w AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, least(lim, coalesce(max(CASE WHEN rest / others * weight <= lim
    THEN rest / others END) OVER () * weight, lim)) AS target
  FROM cut),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY
    md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized),
joined AS (
  SELECT doc_id, size, source_size, target, b, floor(target + 1e-6)::BIGINT AS quota
  FROM placed JOIN aims ON placed.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(b + size, quota) - b, 0)
   + greatest(least(b + size, quota - source_size) - b, 0)
   + greatest(least(b + size, quota - 2 * source_size) - b, 0))::BIGINT AS taken
FROM joined
"""

SQL["op13_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT keyed.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone
  FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

# A leaf's way up: the sibling at each level, first in the group's tree, then in that of the groups' roots.
SQL["op11_manifest"] = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, lang, text, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 AS tampered
  FROM documents),
base AS (
  SELECT doc_id, lang, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN
      sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
  FROM parts WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST)),
tree AS (
  SELECT lang, 0 AS lvl, pos, leaf AS d, total FROM base
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (total + 1) // 2
  FROM tree WHERE total > 1 GROUP BY lang, lvl, pos // 2, total),
tops AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
  FROM tree WHERE total = 1),
upper AS (
  SELECT 0 AS lvl, pos, subroot AS d, total FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (total + 1) // 2
  FROM upper WHERE total > 1 GROUP BY lvl, pos // 2, total),
way AS (
  SELECT doc_id, lang, 0 AS lvl, pos, total, coalesce(other, leaf) AS node, '' AS proof FROM base
  UNION ALL
  SELECT way.doc_id, way.lang, way.lvl + 1, way.pos // 2, (way.total + 1) // 2,
    sha256(CASE WHEN way.pos % 2 = 0 THEN node || coalesce(d, '') ELSE coalesce(d, '') || node END),
    proof || coalesce(d, '')
  FROM way LEFT JOIN tree ON tree.lang IS NOT DISTINCT FROM way.lang AND tree.lvl = way.lvl
    AND tree.pos = xor(way.pos, 1)
  WHERE way.total > 1),
up AS (
  SELECT doc_id, way.lang, 0 AS lvl, tops.pos, tops.total, node, proof
  FROM way JOIN tops ON tops.lang IS NOT DISTINCT FROM way.lang WHERE way.total = 1
  UNION ALL
  SELECT up.doc_id, up.lang, up.lvl + 1, up.pos // 2, (up.total + 1) // 2,
    sha256(CASE WHEN up.pos % 2 = 0 THEN node || coalesce(d, '') ELSE coalesce(d, '') || node END),
    proof || coalesce(d, '')
  FROM up LEFT JOIN upper ON upper.lvl = up.lvl AND upper.pos = xor(up.pos, 1)
  WHERE up.total > 1)
SELECT base.doc_id, leaf, subroot, upper.d AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = upper.d AS verified
FROM base JOIN up ON up.doc_id IS NOT DISTINCT FROM base.doc_id AND up.total = 1
JOIN tops ON tops.lang IS NOT DISTINCT FROM base.lang JOIN upper ON upper.total = 1
"""

SQL["op12_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
wanted AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
freq AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM freq, whole GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id,
    sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN freq USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
