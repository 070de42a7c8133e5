"""The registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    collocations, decontaminate, licenses, lines, lm, mixing, packing, quality, retrieval, secrets, sharding, simhash, urls,
)
from tabloom.llm.common import text_or_empty

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


# fixed values: the rules of the contract
URL_RULES = [
    urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"), urls.Rule("block", "net/fr/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    taken = (F.col("size") * F.col("times")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text", sharding.record_size().alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32")))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_lm_score": op4_lm_score,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix": op8_mix,
    "op9_shard": op9_shard,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_packing": op12_packing,
    "op13_collocations": op13_collocations,
}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
spots AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + 7], ' ')) AS times FROM spots),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest(range(8)) AS k) WHERE times > 1 GROUP BY r),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(body) - length(replace(body, '!', '')) AS n_exclamations,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS n_ellipsis_lines,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, concat_ws(',',
    CASE WHEN n_words < 20 THEN 'words' END,
    CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 'repeated_words' END,
    CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 'word_length' END,
    CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END,
    CASE WHEN 100 * n_exclamations > 50 * n_words THEN 'exclamations' END,
    CASE WHEN 100 * n_stop_words < 5 * n_words THEN 'stop_words' END,
    CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'repeated_lines' END,
    CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullet_lines' END,
    CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 'ellipsis_lines' END) AS failed_rules
  FROM counted)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_rules = '' AS kept FROM judged""",
    "op6_line_dedup": r"""
WITH split AS (
  SELECT doc_id, text, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
each AS (SELECT r, doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS number FROM split),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
placed AS (
  SELECT *, row_number() OVER o AS spot, sum(n) OVER o AS upto FROM counted WINDOW o AS (PARTITION BY r ORDER BY number)),
bodies AS (SELECT r, list(line ORDER BY number) AS body FROM placed GROUP BY r),
runs AS (
  SELECT a.r, a.doc_id, a.spot, min(b.spot) AS last
  FROM placed a JOIN placed b ON a.r = b.r AND b.spot >= a.spot AND b.upto - a.upto + a.n >= 50 GROUP BY ALL),
ranked AS (
  SELECT r, spot, last,
         row_number() OVER (PARTITION BY array_to_string(body[spot:last], chr(10)) ORDER BY doc_id NULLS LAST, r, spot) AS copy
  FROM runs JOIN bodies USING (r)),
frequent AS (
  SELECT r, spot, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, r, spot) AS copy, count(*) OVER (PARTITION BY line) AS places
  FROM placed WHERE n >= 8),
gone AS (
  SELECT DISTINCT r, spot FROM (SELECT r, unnest(range(spot, last + 1)) AS spot FROM ranked WHERE copy > 1)
  UNION SELECT r, spot FROM frequent WHERE places >= 20 AND copy > 1),
lost AS (SELECT r, number FROM gone JOIN placed USING (r, spot)),
cleaned AS (
  SELECT r, string_agg(line, chr(10) ORDER BY number) AS body FROM each ANTI JOIN lost USING (r, number) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN md5(coalesce(body, '')) END AS text_md5
FROM split LEFT JOIN cleaned USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM lost GROUP BY r) USING (r)""",
    "op7_decontaminate": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS k, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
doc_spots AS (SELECT doc_id, r, w, unnest(range(1, len(w) - 3)) AS i FROM docs),
item_spots AS (SELECT item_id, k, w, unnest(range(1, len(w) - 3)) AS i FROM items),
ds AS (SELECT DISTINCT doc_id, r, array_to_string(w[i:i + 4], ' ') AS s FROM doc_spots),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + 4], ' ') AS s FROM item_spots),
sizes AS (SELECT k, count(*) AS n FROM s GROUP BY k),
shared AS (
  SELECT ds.doc_id, s.item_id, s.k, ds.r, count(*) AS n_shared FROM ds JOIN s USING (s) GROUP BY ALL),
best AS (
  SELECT doc_id, item_id, max({'c': n_shared::DOUBLE / n, 's': n_shared, 'n': n}) AS b
  FROM shared JOIN sizes USING (k) WHERE n_shared >= ceil(0.8::DOUBLE * n) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, b.s AS n_shared, b.n AS n_shingles, b.c AS containment FROM best""",
    "op8_mix": r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null') || '|8'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
         1.0::DOUBLE - (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[0-9#*$%&|<>!]', '', 'g')))::DOUBLE
           / (2.0::DOUBLE * greatest(length(coalesce(text, '')), 1)) AS w
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound, 2.0::DOUBLE * source_size / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - (sum(2.0::DOUBLE * source_size) OVER o - 2.0::DOUBLE * source_size))
           / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
  FROM sources WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
stands AS (SELECT level AS height FROM levels WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1),
goals AS (
  SELECT source, source_size, least(bound, coalesce(height * weight, bound)) AS target FROM levels LEFT JOIN stands ON true),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals),
summed AS (
  SELECT d.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY 1.0::DOUBLE - pow(u, 1.0::DOUBLE / w), d.doc_id::VARCHAR NULLS FIRST, size,
                         md5(d.text) NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) AS taken
FROM summed""",
    "op11_lexical_search": r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS k,
         unnest(list_distinct(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
totals AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM lowered),
held AS (
  SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(t)::BIGINT AS n, unnest(t) AS term FROM lowered)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term, docs),
parts AS (
  SELECT item_id, k, doc_id, r, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS s
  FROM held JOIN weights USING (term) JOIN items USING (term), totals),
scores AS (SELECT item_id, k, doc_id, sum(s)::BIGINT AS score FROM parts GROUP BY item_id, k, doc_id, r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM spots, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
found AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM found),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a,
         min({'score': ((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT, 'k': c.k, 'l': x.a, 'r': y.a}) AS cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ') GROUP BY ALL),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM found)) GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a,
         cut.l AS l, cut.r AS r, n, cut.score AS score
  FROM scored s LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT * FROM ranked WHERE rank <= 2000""",
}
