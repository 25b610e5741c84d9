"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxframe.llm import merge_bpe, toxicity
from boxframe.llm.align import align
from boxframe.llm.ann import nearest
from boxframe.llm.byte_bpe import tokenize
from boxframe.llm.chat_format import format_chats
from boxframe.llm.common import table
from boxframe.llm.html_extract import extract_main_text
from boxframe.llm.media_jpeg import media_columns
from boxframe.llm.mixing import mix
from boxframe.llm.phrases import collocations
from boxframe.llm.sharding import shuffle_to_shards
from boxframe.llm.simhash import simhash_components
from boxframe.llm.url_rules import judge, rule_labels

#: Given rules: verdict, then host and path start.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op2_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = shuffle_to_shards(rows, shards=8)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokenize(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, URL_RULES, rule_labels(pages, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("antecedent", " ").alias("mined_rule"), "confidence")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"], with_media=False)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "average_hash", "difference_hash")
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def by_length(size: Column) -> Column:
    """How a document is favoured: by its words, from 20 to 2000, so that short ones come late and fill gaps."""
    return F.least(F.greatest(size, F.lit(20)), F.lit(2000))


def op10_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), favour=by_length, keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), *paths, keep=["doc_id"], with_groups=False)


def op12_merge_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return merge_bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"], with_ids=False)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_role_repair": op2_chat_role_repair,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_hypergeometric_sharding": op4_hypergeometric_sharding,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_url_rules": op7_url_rules,
    "op8_toxicity": op8_toxicity,
    "op9_jpeg_media": op9_jpeg_media,
    "op10_pareto_mixing": op10_pareto_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_merge_bpe": op12_merge_bpe,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: The mix by plain windows over whole sources.
_MIX = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5(concat_ws(':', '42', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
e AS (SELECT *, CAST(least(greatest(size, 20), 2000) AS DOUBLE) AS favour FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, 2e0 * source_size AS most FROM s),
l AS (SELECT *, most / w AS level, 1.5e0 * CAST(sum(source_size) OVER () AS BIGINT) AS total, sum(w) OVER () AS all_w FROM w),
f AS (SELECT *, sum(most) OVER o + level * (all_w - sum(w) OVER o) <= total AS is_full FROM l
  WINDOW o AS (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE
  (total - sum(CASE WHEN is_full THEN most ELSE 0e0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0e0 ELSE w END) OVER (), 0e0) * w END AS target FROM f),
p AS (SELECT *, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0e0), 0e0) AS f FROM t),
v AS (SELECT e.source, favour, any_value(target - floor(f) * source_size) AS rest, CAST(sum(size) AS BIGINT) AS words FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source GROUP BY e.source, favour),
vv AS (SELECT *, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * favour) OVER (PARTITION BY source ORDER BY favour DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0e0) AS level FROM v),
lv AS (SELECT source, coalesce(arg_max(level, favour) FILTER (WHERE level * favour < 1), 1e300) AS level FROM vv GROUP BY source),
q AS (SELECT e.*, p.source_size, p.target, floor(f) AS whole, f - floor(f) AS part, target - floor(f) * source_size AS rest,
    least(greatest(coalesce(favour * level, 0e0), 1e-12), 1 - 1e-12) AS p
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source JOIN lv ON e.source IS NOT DISTINCT FROM lv.source),
r AS (SELECT *, u / (1 - u) / (p / (1 - p)) AS odds FROM q),
g AS (SELECT *, CAST(floor(odds / (1 + odds) * 4503599627370496e0) AS BIGINT) AS place FROM r),
k AS MATERIALIZED (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till FROM g),
c AS (SELECT source, coalesce(max(place) FILTER (WHERE till <= rest), -1) AS cut, any_value(rest) - coalesce(max(till) FILTER (WHERE till <= rest), 0) AS gap FROM k WHERE part > 0 AND rest > 0 GROUP BY source),
later AS MATERIALIZED (SELECT k.source, k.size, k.place, c.gap, count(*) OVER (PARTITION BY k.source, k.size ORDER BY k.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till
  FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source WHERE part > 0 AND rest > 0 AND k.place > c.cut),
z AS MATERIALIZED (SELECT source, size, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS t FROM later WHERE size > 0 AND size < 2 * gap GROUP BY source, size),
fill AS (SELECT source, CAST(0 AS BIGINT) AS t, gap AS space, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS k FROM c
  UNION ALL SELECT v.source, z.t, v.space - least(z.n, CAST(floor(v.space / z.size) AS BIGINT)) * z.size, z.size, z.n, least(z.n, CAST(floor(v.space / z.size) AS BIGINT))
  FROM fill v JOIN z ON z.source IS NOT DISTINCT FROM v.source AND z.t = v.t + 1),
y AS (SELECT source, arg_min(space, -t) AS space, min((size - space, t)) FILTER (WHERE t > 0 AND n > k) AS o FROM fill GROUP BY source),
o AS (SELECT source, CASE WHEN o[1] < space THEN o[2] END AS t FROM y),
x AS (SELECT v.source, v.size, v.k + CASE WHEN o.t = v.t THEN 1 ELSE 0 END AS k FROM fill v JOIN o ON v.source IS NOT DISTINCT FROM o.source WHERE v.t BETWEEN 1 AND coalesce(o.t, v.t)),
more AS (SELECT l.source, l.size, max(l.place) AS last FROM later l JOIN x ON l.source IS NOT DISTINCT FROM x.source AND l.size = x.size WHERE l.till <= x.k GROUP BY ALL)
SELECT doc_id, k.size, source_size, target, CAST(k.size * (whole + CASE WHEN part > 0 AND rest > 0 AND (place <= c.cut OR place <= more.last) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source LEFT JOIN more ON k.source IS NOT DISTINCT FROM more.source AND k.size = more.size
"""

#: All phrases counted at once; products in 128 bits.
_PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT k.lang, k.words, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k.k + 1:k.words], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, inner_, max(a) AS a FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_, a FROM c WHERE words = 3) GROUP BY ALL),
z AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.inner_ = m.phrase WHERE i.a IS NULL OR 100 * i.a < 50 * m.a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op10_pareto_mixing": _MIX, "op13_phrase_collocations": _PHRASES}
