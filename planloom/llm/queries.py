"""The registered queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, forest, language, lattice, pii, quality, repeats, repetition, token_counts, warc
from .common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cfg = quality.Ftrl()
    weights, bias = quality.fit(docs, table(spark, sf_dir, "labels"), cfg, ~held_out())
    return quality.quality_scores(docs.select("doc_id", "text", held_out().alias("held_out")), weights, bias, cfg, ["doc_id", "held_out"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.copy_groups(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # beside the removal of 400 bytes, words in passages of over 50 words that other documents have too
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), repeats.Rule(words=51))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cfg = language.Settings()
    model = language.fit(docs, cfg, ~held_out())
    return language.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, cfg, ["doc_id", "held_out"])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.sampled_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii": op2_pii,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_sentencepiece": op10_sentencepiece,
}

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"


def shingled(name: str, key: str, table_name: str, least: int) -> str:
    """SQL of the distinct five-word shingles of a table's texts; of a text with fewer words, but at
    least `least`, all its words."""
    return f"""{name}_w AS (SELECT {key}, {WORDS} AS w FROM {table_name}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}_w WHERE len(w) >= {least})),
{name}_n AS (SELECT {key}, count(*) AS n FROM {name} GROUP BY {key})"""


#: SQL of the operators that it can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op4_jaccard_join": f"""WITH RECURSIVE {shingled("sh", "doc_id", "documents", 1)},
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y, c = p.n AND c = q.n AS same FROM pair JOIN sh_n p ON p.doc_id = x JOIN sh_n q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
own AS (SELECT x AS doc_id, count(*) AS n_links, min(y) FILTER (WHERE same) AS first_same, count(*) FILTER (WHERE same) AS n_same FROM link GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, least(doc_id, coalesce(first_same, doc_id)) AS text_class, 1 + coalesce(n_same, 0) AS class_size FROM class LEFT JOIN own USING (doc_id)""",
    "op6_decontamination": f"""WITH {shingled("sh", "doc_id", "documents", 5)}, {shingled("it", "item_id", "benchmark", 5)},
hit AS (SELECT doc_id, item_id, count(*) AS c FROM it JOIN sh USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(c AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS item_shingles, c / n AS containment FROM hit JOIN it_n USING (item_id) WHERE c >= 0.8 * n""",
    "op7_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT d, max(page_id) AS top FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest, CASE WHEN b >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN b >= 1000 AND top <> page_id THEN top END AS refers_to FROM p LEFT JOIN t ON p.d = t.d""",
}
