"""The corpus operators' queries, by the columns that their contracts fix, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import examples, read_back
from .classifier import fit, with_quality
from .common import crc_mod, table
from .decontaminate import leaks
from .divergence import audit
from .html import with_main_text
from .interactions import interactions
from .lm import language_model
from .mixing import taken
from .packing import pack
from .repeats import mark_repeats
from .rules import quality
from .simhash import near_duplicates
from .warc import archived


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    vectors, network = fit(docs, labels.where(~held_out), "doc_id", "text", "quality")
    scores = with_quality(docs, vectors, network)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return quality(table(spark, sf_dir, "documents")).select(*columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "hits", "containment", "kind")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, counts, _ = language_model(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod(F.col("doc_id"), 5) != 1)
    return scores.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


OK = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also conversation -1, whose texts are control strings of the template."""
    more = spark.createDataFrame([(-1, 0, "user", OK), (-1, 1, "assistant", OK)], "conv_id long, turn long, role string, text string")
    return read_back(examples(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)))


def op11_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer`` is the path of a tokenizer's file; unless given, that of the public byte-level BPE."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), tokenizer)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality_classifier, op3_quality_rules, op4_simhash, op5_suffix_array, op6_decontamination, op7_warc, op8_lm, op9_html, op10_chat, op11_packing, op12_divergence, op13_interactions)}


ORACLES = {
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS held FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> held THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> held THEN held END AS refers_to
        FROM m""",
    "op10_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, 18 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1#\2\3', 'g'))
                + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1#\2\3', 'g')) + 2 AS chars,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
                count(*) OVER (PARTITION BY conv_id) AS total FROM c),
        s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS prefix FROM e)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(prefix) FILTER (role = 'assistant' OR n = total) AS BIGINT) AS formatted_chars,
            count(*) FILTER (role = 'assistant' OR n = total) AS n_examples
        FROM s GROUP BY conv_id""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)),
        p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        a AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(n) + any_value(v)) AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
        pairs AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
            LEFT JOIN (SELECT s.lang, s.source AS a, t.source AS b, sum((s.p - t.p) * (s.p - t.p) // t.p) AS value FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) z ON z.lang = x.lang AND a = x.source AND b = y.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN a USING (lang, term) WHERE c > 0 AND p > q)
        SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200""",
    "op13_interactions": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
        b AS (
            SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
                (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
                + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY text))::INT AS fails
            FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
        m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, fails),
        o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
        s AS (
            SELECT filter_order, k AS step, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS f, coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))), 0)::INT AS before
            FROM (SELECT filter_order, unnest(range(1, 6))::INT AS k FROM o WHERE length(filter_order) = 5)),
        r AS (
            SELECT part, filter_order, step, f,
                coalesce(sum(n) FILTER (fails & (before | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & f > 0), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (fails & before > 0 AND fails & f > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (fails & before = 0 AND fails & f > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & f > 0), 0)::BIGINT AS toxic_lost
            FROM m, s GROUP BY ALL)
        SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
