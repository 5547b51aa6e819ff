"""The numbered queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import class_lm, exact_dedup, filter_audit, language_id, mixing, ngram_join, packing, repeated_passages, rule_cascade, url_filter, vector_codes, warc, weak_quality
from txrisk.llm.common import id_remainder

# The URL rules of the contract (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE that the packing contract names."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def language_model(docs: DataFrame) -> language_id.Model | None:
    """Fitted on the documents that are not held out (crc32 of the id modulo 4 is not 2)."""
    return language_id.fit(docs.filter(id_remainder("doc_id", 4) != 2))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return language_id.predict(docs.drop("lang"), language_model(docs)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_records(spark, warc.write(_read(spark, sf_dir, "pages")))
    number = lambda c: F.col(c).try_cast("long")
    return read.select(number("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), id_remainder("doc_id", 10) == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_groups(_read(spark, sf_dir, "documents")).drop("same_rows")


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_read(spark, sf_dir, "documents"), tokenizer_path()))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rule_cascade.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = repeated_passages.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rest.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_source_mix, op3_url_filter, op4_warc_chunks, op5_class_lm, op6_ngram_join,
                            op7_exact_dedup, op8_weak_quality, op9_packing, op10_rule_cascade,
                            op11_repeated_passages, op12_vector_codes, op13_filter_audit)}

def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds as a chain of tables: assignments a<r>, means m<r>, codebooks c<r>."""
    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
            SELECT vec_id, p, min_by(e, d * {entries} + e) AS e, min(d) AS d
            FROM (SELECT vec_id, parts.p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(parts.x, c.x)]) AS d
                  FROM parts JOIN c{r} c ON parts.p = c.p) GROUP BY vec_id, p)"""

    def moved(r: int) -> str:
        return f"""m{r} AS MATERIALIZED (
            SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
            FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n
                  FROM (SELECT a.p, a.e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} a JOIN parts ON a.vec_id = parts.vec_id AND a.p = parts.p)
                  GROUP BY p, e, i) GROUP BY p, e),
        c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e)"""

    chain = ",\n        ".join(f"{assigned(r)},\n        {moved(r)}" for r in range(rounds))
    return f"""
        WITH whole AS MATERIALIZED (
            SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
            FROM (SELECT vec_id, v, unnest(range({parts})) AS p FROM whole)),
        c0 AS MATERIALIZED (
            SELECT p, e, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT {entries}) f
            JOIN parts ON f.vec_id = parts.vec_id),
        {chain},
        {assigned(rounds)},
        books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS sha FROM c{rounds}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
        SELECT whole.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
        FROM whole JOIN coded ON whole.vec_id = coded.vec_id, books"""


ORACLE: dict[str, str] = {
    "op11_repeated_passages": r"""
        WITH t AS MATERIALIZED (
            SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
        words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n
                 FROM words LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM covered) c USING (doc_id, p) WHERE c.p IS NULL GROUP BY words.doc_id)
        SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id""",
    "op12_vector_codes": _vector_codes_sql(),
    "op10_rule_cascade": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                          [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w,
                          [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
                   FROM documents),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
        rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM win) WHERE c > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
        m AS (SELECT t.doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                     length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
                     length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
                     length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS capitals,
                     length(text) - length(replace(text, '!!', '')) AS bangs
              FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     word_chars / greatest(n_words, 1) NOT BETWEEN 2 AND 12 OR 10 * n_symbols > n_words
                     OR n_dup_lines * 10 > n_lines * 3 OR n_repeat_words * 10 > n_words * 3
                     OR bangs * 5 > n_words OR capitals * 2 > letters OR letters * 10 < word_chars * 5 AS rejected FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT rejected AS kept
        FROM v""",
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
                          [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
        f AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
                     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
                     regexp_matches(text, '[#$%&*|]') AS d,
                     coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e,
                     coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
                     coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM t),
        g AS (SELECT part, [x for x in [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
                                        CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] if x IS NOT NULL] AS fails, good, toxic FROM f),
        x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u
              WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
        first_fail AS (SELECT part, filter_order, fails, good, toxic,
                              coalesce(list_min([instr(filter_order, y) for y in fails]), 9) AS fell FROM g, o),
        s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
                     count(*) FILTER (fell > step) AS kept, count(*) FILTER (fell = step) AS removed,
                     count(*) FILTER (fell < step AND list_contains(fails, substr(filter_order, step, 1))) AS redundant,
                     count(*) FILTER (fails = [substr(filter_order, step, 1)]) AS unique_fails,
                     count(*) FILTER (fell = step AND good) AS good_lost, count(*) FILTER (fell = step AND toxic) AS toxic_lost
              FROM first_fail, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) GROUP BY part, filter_order, step)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM s""",
    "op3_url_filter": r"""
        WITH parts AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
          FROM pages),
        rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                          ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        urls AS (SELECT DISTINCT host, path FROM parts),
        best AS (
          SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
          FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
          GROUP BY host, path)
        SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""",
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
}
