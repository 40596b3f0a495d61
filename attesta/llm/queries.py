"""The queries of this folder's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.session import share_code

from .store import small_batches

BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(share_code(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_summary

    return token_summary(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (
    op1_substring_dedup,
    op2_sharding,
    op3_line_dedup,
    op4_packing,
    op5_decontamination,
    op6_quality_rules,
    op7_token_output,
    op8_language_id,
    op9_ngram_join,
    op10_quality_classifier,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def words_sql(text: str) -> str:
    return _WORDS.format(text=text)


#: DuckDB SQL of the operators that SQL can express. The others need a tokenizer, a checksum or a fitted model.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {words_sql("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) t(p)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT g.doc_id, g.p FROM g JOIN f USING (s) WHERE least < g.doc_id),
pos AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
c AS (SELECT pos.doc_id, pos.p, word, count(gone.p) OVER (PARTITION BY pos.doc_id ORDER BY pos.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS covered
  FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p)
SELECT d.doc_id, count(c.p) AS n_words, count(*) FILTER (covered) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY c.p) FILTER (NOT covered), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, k, line, {words_sql("line")} AS w, doc_id * 10000000 + k AS place FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)),
f AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min(place) AS first FROM l WHERE len(w) > 0 GROUP BY 1),
v AS (SELECT s, first, 0 AS side, '1:' || s AS key FROM f WHERE len(w) >= 8
  UNION ALL SELECT s, first, 1, '1:' || array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') FROM f, unnest(range(1, len(w) + 1)) t(i) WHERE len(w) >= 8
  UNION ALL SELECT s, first, 2, '2:' || i || ':' || array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') FROM f, unnest(range(1, len(w) + 1)) t(i) WHERE len(w) >= 8),
m AS (SELECT key, min(first) FILTER (side = 0) AS whole, min(first) FILTER (side <> 0) AS part FROM v GROUP BY key HAVING count(DISTINCT s) > 1),
b AS (SELECT v.s, min(CASE WHEN side = 1 THEN whole ELSE part END) AS near FROM v JOIN m USING (key) GROUP BY v.s),
r AS (SELECT l.doc_id, l.k, l.line, f.s IS NOT NULL AND l.place > least(f.first, coalesce(b.near, f.first)) AS gone FROM l LEFT JOIN f ON f.s = array_to_string(l.w, ' ') AND len(l.w) > 0 LEFT JOIN b ON b.s = f.s)
SELECT d.doc_id, count(r.k) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words_sql("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 7], ' ')) > 1 AS twice FROM d, unnest(range(1, len(w) - 6)) t(p)),
c AS (SELECT pos.doc_id, count(g.p) OVER (PARTITION BY pos.doc_id ORDER BY pos.p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) > 0 AS covered
  FROM (SELECT doc_id, p FROM d, unnest(range(1, len(w) + 1)) t(p)) pos LEFT JOIN g ON g.doc_id = pos.doc_id AND g.p = pos.p AND g.twice),
r AS (SELECT doc_id, count(*) FILTER (covered) AS n FROM c GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: len({words_sql("x")}) > 0) AS lines, coalesce(r.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_n, length(regexp_replace(t, '[^A-Za-z\u0080-\U0010FFFF]', '', 'g')) AS letters_n,
  length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits_n, length(regexp_replace(t, '[^!]', '', 'g')) AS shouts_n FROM d LEFT JOIN r USING (doc_id)),
n AS (SELECT *, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
  + 16 * (100 * upper_n > 60 * letters_n AND letters_n > 0)::INT + 32 * (100 * shouts_n > 40 * n_words)::INT + 64 * (word_chars < 2 * n_words)::INT + 128 * (word_chars > 30 * n_words)::INT
  + 256 * (100 * digits_n > 50 * word_chars)::INT AS BIGINT) AS failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, failed & 3 = 0 AS kept_base, failed & 63 = 0 AS kept_v1,
 CASE WHEN bit_count(failed) = 1 THEN failed ELSE 0 END AS sole_failure FROM b""",
    "op9_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) t(p)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
few AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN few USING (g) JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT k.a, k.b FROM k JOIN n x ON x.doc_id = k.a JOIN n y ON y.doc_id = k.b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
}
