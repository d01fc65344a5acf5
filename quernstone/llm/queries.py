"""The pN_ queries over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import components, copies, encode, lookalikes, mojibake, neardup, overlap, packing, splits
from quernstone.plans.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.corpus_copies(table(spark, sf_dir, "corpus_rows"), table(spark, sf_dir, "raw_records"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_counts(p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.torn_groups(table(spark, sf_dir, "corpus_rows"))


def p2_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "corpus_rows"), table(spark, sf_dir, "split_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, sf_dir, "corpus_rows"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "corpus_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.document_groups(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.disguised_pairs(table(spark, sf_dir, "index_entries"), table(spark, sf_dir, "detect_requests"), table(spark, sf_dir, "corpus_rows"))


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.match_groups(table(spark, sf_dir, "match_pairs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.document_ids(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_profiles"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = mojibake.restore_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return fixed.where((F.col("spans") > 0) | F.col("lost")).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_counts, p2_found, p2_assigned, p3_found, p3_report, p4_found, p5_found, p5_documents, p6_found, p7_ids, p8_packed, p9_found, p9_restored)
}

SQL = {
    "p2_found": """
        WITH RECURSIVE keyed AS (
            SELECT id, source_split AS split,
                   'i:' || id AS i,
                   's:' || regexp_replace(lower(source), '[\\s_\\-‐‑]', '', 'g') AS s,
                   'f:' || family AS f
            FROM corpus_rows WHERE id IS NOT NULL),
        pairs AS (SELECT DISTINCT s AS a, f AS b FROM keyed WHERE s IS NOT NULL AND f IS NOT NULL),
        edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        walk(node, root) AS (
            SELECT a, a FROM edges
            UNION
            SELECT e.b, w.root FROM walk w JOIN edges e ON e.a = w.node WHERE w.root < e.b),
        roots AS (SELECT node, min(root) AS root FROM walk GROUP BY node),
        parts AS (
            SELECT k.id, k.split, coalesce(r.root, k.s, k.f, k.i) AS part
            FROM keyed k LEFT JOIN roots r ON r.node = coalesce(k.s, k.f))
        SELECT min(id) AS group_id FROM parts GROUP BY part
        HAVING count(DISTINCT CASE WHEN split IN ('train', 'validation', 'test') THEN split END) >= 2""",
    "p3_found": """
        WITH rows AS (
            SELECT id, source_split = 'train' AS train,
                   regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w
            FROM corpus_rows WHERE source_split IN ('train', 'validation', 'test') AND text IS NOT NULL),
        pairs AS (
            SELECT DISTINCT id, train, w[i] || ' ' || w[i + 1] AS p
            FROM (SELECT id, train, w, unnest(range(1, len(w))) AS i FROM rows WHERE len(w) > 1)),
        sizes AS (SELECT id, count(*) AS n FROM pairs GROUP BY id),
        shared AS (
            SELECT t.id AS t, e.id AS e, count(*) AS o
            FROM pairs t JOIN pairs e ON t.p = e.p WHERE t.train AND NOT e.train GROUP BY 1, 2)
        SELECT least(t, e) AS id_a, greatest(t, e) AS id_b
        FROM shared JOIN sizes a ON a.id = t JOIN sizes b ON b.id = e
        WHERE 2 * o >= a.n + b.n - o""",
    "p4_found": """
        WITH RECURSIVE rows AS (
            SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w
            FROM documents WHERE text IS NOT NULL),
        pairs AS (
            SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS p
            FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM rows WHERE len(w) > 1)),
        sizes AS (SELECT id, count(*) AS n FROM pairs GROUP BY id),
        shared AS (
            SELECT x.id AS a, y.id AS b, count(*) AS o
            FROM pairs x JOIN pairs y ON x.p = y.p AND x.id < y.id GROUP BY 1, 2),
        close AS (
            SELECT s.a, s.b FROM shared s JOIN sizes m ON m.id = s.a JOIN sizes n ON n.id = s.b
            WHERE 2 * o >= m.n + n.n - o),
        edges AS (SELECT a, b FROM close UNION SELECT b, a FROM close),
        walk(node, root) AS (
            SELECT a, a FROM edges
            UNION
            SELECT e.b, w.root FROM walk w JOIN edges e ON e.a = w.node WHERE w.root < e.b)
        SELECT node AS doc_id, min(root) AS group_id FROM walk GROUP BY node""",
    "p6_found": """
        WITH RECURSIVE edges AS (
            SELECT id_a AS a, id_b AS b FROM match_pairs WHERE id_a <> id_b
            UNION SELECT id_b, id_a FROM match_pairs WHERE id_a <> id_b),
        walk(node, root) AS (
            SELECT a, a FROM edges
            UNION
            SELECT e.b, w.root FROM walk w JOIN edges e ON e.a = w.node WHERE w.root < e.b)
        SELECT node AS id, min(root) AS group_id FROM walk GROUP BY node""",
}

SQL["p3_report"] = f"""
        WITH found AS ({SQL['p3_found']}),
        ends AS (SELECT id_a AS id FROM found UNION ALL SELECT id_b FROM found),
        each AS (SELECT id, count(*) AS pairs FROM ends GROUP BY id)
        SELECT source_split AS split, source, sum(pairs)::BIGINT AS pairs, count(*) AS rows
        FROM each JOIN corpus_rows USING (id) WHERE source_split IN ('validation', 'test') GROUP BY 1, 2"""
