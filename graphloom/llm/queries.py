"""The registered queries opN_<name> of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, exact_dedup, hard_negatives, language, license_scan, line_dedup, mixing, near_dedup, packing, quality, spelling, suffix_dedup, toxicity
from .common import read


def fold(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = language.train(language.training_windows(docs))
    out = language.identify(docs, net)
    return out.select("doc_id", (F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


#: Weights of op3_mixing and of the pipeline's mixing stage; whatever is not named weighs 1.
MIX_WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0}, "lang": {"en": 4.0, "fr": 2.0, "de": 2.0}, "source": {"src0": 2.0}}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), share=0.6, weights=MIX_WEIGHTS, epochs=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.site_lines(read(spark, sf_dir, "pages"), "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", (F.coalesce(fold(5), F.lit(1)) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op13_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_mixing, op4_suffix_dedup, op5_packing, op6_near_dedup, op7_license_scan, op8_line_dedup, op9_toxicity, op10_exact_dedup, op11_spelling, op12_hard_negatives, op13_word_dedup)}



def _mixing_sql(share: float, weights: dict, epochs: int, seed: str) -> str:
    def weight(level: str) -> str:
        return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {float(v)!r}" for k, v in weights[level].items()) + " ELSE 1.0 END::DOUBLE"

    def fill(name: str, source: str, parent: str, node: str, budget: str, out: str) -> str:
        by = f"PARTITION BY {parent}"
        return f"""{name}_w AS (SELECT *, {weight(node)} AS wt FROM {source}),
{name}_l AS (SELECT *, ({budget} - coalesce(sum(cap) OVER ({by} ORDER BY cap / wt, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER ({by} ORDER BY cap / wt, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}_w),
{name} AS (SELECT * EXCLUDE (lev, op, wt), CASE WHEN op IS NULL THEN cap ELSE least(cap, greatest(0.0, op * wt)) END AS {out} FROM (SELECT *, max(lev) FILTER (lev * wt < cap) OVER ({by}) AS op FROM {name}_l))"""

    return f"""
WITH base AS (SELECT doc_id, coalesce('domain' || (('0x' || substr(md5(source), 1, 8))::BIGINT % 4), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {epochs})::DOUBLE AS cap FROM base GROUP BY ALL),
top AS (SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) * {share!r}::DOUBLE FROM leaves) AS b0 FROM leaves GROUP BY domain),
{fill("d", "top", "b0", "domain", "b0", "b1")},
mid AS (SELECT domain, lang, sum(cap) AS cap, any_value(b1) AS b1 FROM leaves JOIN (SELECT domain, b1 FROM d) USING (domain) GROUP BY domain, lang),
{fill("l", "mid", "domain", "lang", "b1", "b2")},
low AS (SELECT leaves.*, b2 FROM leaves JOIN (SELECT domain, lang, b2 FROM l) USING (domain, lang)),
{fill("s", "low", "domain, lang", "source", "b2", "b3")},
plan AS (SELECT domain, lang, source, tokens AS total, floor(b3 + 1e-6)::BIGINT AS leaf_budget, CASE WHEN tokens > 0 THEN least({epochs}, floor(b3 + 1e-6)::BIGINT // tokens) ELSE 0 END AS whole FROM s),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{seed}', whole::VARCHAR, doc_id::VARCHAR)), doc_id) AS upto FROM base JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, leaf_budget, (whole + (whole < {epochs} AND upto <= leaf_budget - whole * total)::INT)::INT AS copies FROM run"""


def _license_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_scan.TEMPLATES)
    return f"""
WITH tw AS (SELECT license, regexp_extract_all(lower(notice), '[a-z0-9]+') AS w FROM (VALUES {rows}) v(license, notice)),
goal AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS g FROM tw, range(1, 400) t(i) WHERE i + 4 <= len(w)),
size AS (SELECT license, count(*) AS n_shingles FROM goal GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw))
SELECT doc_id, license, n_shingles, count(*) AS n_found FROM ds JOIN goal USING (g) JOIN size USING (license) GROUP BY doc_id, license, n_shingles HAVING count(*) * 100 >= n_shingles * 80"""


ORACLES = {
    "op3_mixing": _mixing_sql(0.6, MIX_WEIGHTS, 2, "mix-1"),
    "op7_license_scan": _license_sql(),
    "op8_line_dedup": r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
hosts AS (SELECT host, count(*) AS pages FROM base GROUP BY host),
each AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM base) GROUP BY host, line),
common AS (SELECT each.host, line FROM each JOIN hosts USING (host) WHERE n > pages * 0.3),
pos AS (SELECT rid, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM base),
kept AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM pos ANTI JOIN common USING (host, line) GROUP BY rid)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (rid)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3""",
    "op13_word_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, range(20) t(j)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
