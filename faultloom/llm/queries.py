"""The ten registered queries and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, langid, line_dedup, minhash, mixing, packing, quality, secret_scan, suffix_dedup
from .common import WORD, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_page_lines(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), quality=mixing.label_weights(table(spark, sf_dir, "labels"))).drop("copies")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)),
        F.sha2(secret_scan.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["k"] == 3)).cast("long").alias("n_entropy"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.LanguageModel.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=("held_out",))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_nearest": op5_nearest,
        "op6_quality": op6_quality,
        "op7_secret_scan": op7_secret_scan,
        "op8_language_id": op8_language_id,
        "op9_near_dedup": op9_near_dedup,
        "op10_packing": op10_packing,
    }


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _html_text_sql() -> str:
    text = f"regexp_replace(coalesce(html, ''), {_quoted(line_dedup.HIDDEN)}, '', 'g')"
    text = f"regexp_replace({text}, {_quoted(line_dedup.BLOCK)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {_quoted(line_dedup.TAG)}, '', 'g')"
    for name, char in line_dedup.ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(char)})"
    text = f"regexp_replace({text}, {_quoted(line_dedup.BLANKS)}, ' ', 'g')"
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: trim(x))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"


def line_dedup_sql(pages: str, key: str, others: str = "", ratio: float = line_dedup.RATIO, least: int = line_dedup.LEAST_PAGES) -> str:
    """Line dedup of ``pages``, a query that gives ``key``, ``host`` and ``text``."""
    blanks = "chr(32) || chr(9) || chr(13) || chr(12) || chr(11)"
    return f"""
    WITH p AS ({pages}),
    hosts AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
    lines AS (SELECT {key}, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM p),
    often AS (
      SELECT l.host, trim(line, {blanks}) AS t FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
      WHERE trim(line, {blanks}) <> ''
      GROUP BY l.host, t, host_pages
      HAVING count(DISTINCT {key}) >= {least} AND count(DISTINCT {key}) > {ratio} * host_pages),
    marked AS (SELECT l.*, o.t IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND trim(l.line, {blanks}) = o.t),
    per AS (
      SELECT {key}, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
      FROM marked GROUP BY {key})
    SELECT p.{key}, {others} p.host, CASE WHEN p.text IS NOT NULL THEN per.text END AS text, host_pages,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
    FROM p JOIN hosts h ON p.host IS NOT DISTINCT FROM h.host LEFT JOIN per ON p.{key} = per.{key}"""


def mixing_sql(weights: tuple[int, ...] = mixing.WEIGHTS, most: int = 3, seed: int = 17) -> str:
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    digits = f"('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 13))::BIGINT"
    return f"""
    WITH d AS (
      SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_quoted(WORD)})) AS size,
             -ln(({digits.replace("doc_id", "d.doc_id")} + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
               / coalesce(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END, 1.0::DOUBLE) AS key
      FROM documents d LEFT JOIN labels USING (doc_id)),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS w
      FROM d GROUP BY source),
    l AS (
      SELECT *, {most} * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS sum_w,
             coalesce(sum({most} * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
      FROM s WINDOW o AS (ORDER BY {most} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT *, (total - cap_before)::DOUBLE / (sum_w - w_before)::DOUBLE AS level, cap::DOUBLE / w AS reach FROM l),
    t AS (
      SELECT source, source_size,
             CASE WHEN stop IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, stop * w) END AS target
      FROM (SELECT *, (SELECT arg_min(level, reach) FROM v WHERE reach > level) AS stop FROM v)),
    u AS (
      SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (size * (epochs + CASE WHEN 2 * upto - size < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM u"""


EXACT_SQL = """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM n WINDOW g AS (PARTITION BY t)"""


def oracle_sql() -> dict[str, str]:
    hosts = f"SELECT page_id, lower(regexp_extract(coalesce(url, ''), {_quoted(line_dedup.HOST)}, 1)) AS host, {_html_text_sql()} AS text FROM pages"
    return {
        "op1_line_dedup": line_dedup_sql(hosts, "page_id"),
        "op2_mixing": mixing_sql(),
        "op4_exact_dedup": EXACT_SQL,
    }
