"""The queries of this subpackage, and their SQL where there is such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm.common import table


def op1_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.mixing import poisson_mix

    return poisson_mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op10_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.language import language

    return language(table(spark, sf_dir, "documents"))


def op3_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.byte_bpe import encode

    return encode(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_co_training_quality, op2_ftrl_toxicity, op3_canonical_digest, op4_pitman_yor_scores, op5_byte_bpe, op6_poisson_mixing, op7_simhash_gray_index, op8_exact_dedup, op9_trigram_secrets, op10_naive_bayes_language)}

ORACLE_SQL = {
    "op6_poisson_mixing": r"""
        WITH per AS (SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY 1),
        rate AS (SELECT s, sqrt(chars) / (SELECT sum(sqrt(chars)) FROM per) * (SELECT sum(chars) FROM per) / chars AS rate FROM per WHERE chars > 0),
        k AS (SELECT unnest(range(0, 200)) AS k),
        pmf AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rate, k),
        cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM pmf),
        u AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
        n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(u.source, '') AND cdf.c <= u.u) AS n FROM u),
        x AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM n WHERE n > 0)
        SELECT *, md5('mix:17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key FROM x""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n""",
}


def _secrets_sql() -> str:
    """op9 in SQL: every rule over every text, without an index."""
    from strandwise.llm.secrets import RULES

    either = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    quote = lambda x: x.replace("'", "''")
    columns, names = [], []
    for k, r in enumerate(RULES):
        pattern = r.pattern
        if pattern.startswith("(?i)"):  # the engine's own case folding reaches beyond ASCII
            head, _, tail = pattern[4:].partition(")")
            pattern = f"({either(head[1:].split('|'))}){tail}"
        pattern = quote(pattern)
        columns.append(f"regexp_extract_all(t, '{pattern}', 0) AS w{k}, regexp_extract_all(t, '{pattern}', {r.group}) AS g{k}, string_split_regex(t, '{pattern}') AS p{k}")
        start = f"list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w{k}[1:i-1], lambda x: length(x))), 0)"
        names.append(f"list_transform(list_filter(range(1, len(w{k}) + 1), lambda i: length(g{k}[i]) >= {r.least}), lambda i: {{'s': ({start})::BIGINT, 'k': {k}, 'n': '{r.kind}', 'e': ({start})::BIGINT + length(w{k}[i])}}) AS s{k}")
    told = lambda ks: "array_to_string(list_transform(list_sort(flatten([" + ", ".join(f"s{k}" for k in ks) + "])), lambda x: x.n || ':' || x.s || ':' || x.e), ',')"
    base = [k for k, r in enumerate(RULES) if r.base]
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(columns)} FROM d), s AS (SELECT doc_id, {', '.join(names)} FROM m)
        SELECT doc_id, {', '.join(f"len(s{k}) AS n_{RULES[k].kind}" for k in base)}, sha256({told(base)}) AS base_sha256, {told(range(len(RULES)))} AS spans FROM s"""


ORACLE_SQL["op9_trigram_secrets"] = _secrets_sql()
