"""Queries of the training-data operators, over the whole tables of a data directory, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.llm import grouping, mixing, names, packing, pii, sentences, splitting, survivors, tokens
from fablespark.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every record of entities_raw that is linked to another."""
    return grouping.group_records(table(spark, sf_dir, "entities_raw"), table(spark, sf_dir, "entity_matches"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the oversized chunks."""
    return splitting.split_oversized(table(spark, sf_dir, "book_chunks"), table(spark, sf_dir, "chunk_profiles"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the splitter had to cut."""
    return p2_pieces(spark, sf_dir).where("piece_index = 1 AND n_pieces > 1").select("chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every distinct chunk."""
    return sentences.split_sentences(table(spark, sf_dir, "book_chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one character or group."""
    return names.name_pairs(table(spark, sf_dir, "entities_raw"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are alone at the top of their duplicate group in every criterion."""
    picks = survivors.choose(table(spark, sf_dir, "entities_raw"), table(spark, sf_dir, "extractors"))
    return picks.where("dominant").selectExpr("base_id AS mention_id")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that stands for each duplicate group."""
    kept = survivors.survivors(table(spark, sf_dir, "entities_raw"), table(spark, sf_dir, "extractors"))
    lists = {c: F.array_join(c, mark) for c, mark in (("aliases", "|"), ("source_chapters", ","))}
    return kept.withColumns(lists).withColumn("extracted_us", F.unix_micros("extracted_at")).drop("extracted_at")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every text for every capacity."""
    return packing.pack_documents(tokens.document_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of the containers of each capacity."""
    return packing.packing_report(p6_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the sources where the balanced mix is the target, and what the targets are owed in the end."""
    targets = table(spark, sf_dir, "mix_targets").where("mix_name = 'balanced'").selectExpr("source", "target_share AS share")
    packed = packing.pack_documents(tokens.document_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_sizes"), targets)
    return packing.mixture_report(packed, targets)


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mix of mix_targets as a schedule of documents."""
    return mixing.mix_documents(tokens.document_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source of each mix."""
    return mixing.mix_report(tokens.document_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for mixes as large as their sources together, with what scarce sources are short of."""
    return mixing.mix_report(tokens.document_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"), total_tokens="supply")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in the texts of documents."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"), _story_names(spark, sf_dir))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents with placeholders for personal information."""
    return pii.redact(table(spark, sf_dir, "documents"), _story_names(spark, sf_dir))


def _story_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = table(spark, sf_dir, "story_figures").selectExpr("figure_name AS name")
    return figures.unionByName(table(spark, sf_dir, "entities_raw").select("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pN_ queries by name."""
    return {f.__name__: f for f in (p1_found, p2_found, p2_pieces, p3_found, p4_found, p5_found, p5_survivors, p6_packed, p6_fill, p6_mixture, p7_mixed, p7_shares, p7_sized, p8_found, p8_redacted)}


_CLEAN = "nullif(trim(regexp_replace(lower({}), ' +', ' ', 'g'), ' '), '')"


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can express on whole tables."""
    return {
        "p1_found": f"""
            WITH RECURSIVE keys AS (
                SELECT DISTINCT mention_id, book_num, entity_type, {_CLEAN.format("s")} AS k
                FROM (SELECT mention_id, book_num, entity_type, unnest(list_append(coalesce(aliases, []), name)) AS s FROM entities_raw)
                WHERE {_CLEAN.format("s")} IS NOT NULL AND book_num IS NOT NULL AND entity_type IS NOT NULL
            ), hub AS (
                SELECT mention_id AS a, min(mention_id) OVER (PARTITION BY book_num, entity_type, k) AS b FROM keys
            ), link AS (
                SELECT a, b FROM hub UNION SELECT b, a FROM hub
                UNION SELECT left_id, right_id FROM entity_matches WHERE decision = 'same' AND left_id IN (SELECT mention_id FROM entities_raw) AND right_id IN (SELECT mention_id FROM entities_raw)
                UNION SELECT right_id, left_id FROM entity_matches WHERE decision = 'same' AND left_id IN (SELECT mention_id FROM entities_raw) AND right_id IN (SELECT mention_id FROM entities_raw)
            ), edge AS (SELECT DISTINCT a, b FROM link WHERE a <> b),
            reach(a, b) AS (
                SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
            )
            SELECT a AS mention_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
        "p2_found": r"""
            SELECT DISTINCT chunk_id FROM book_chunks JOIN chunk_profiles USING (profile_id)
            WHERE len(regexp_extract_all(text, '[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[^ \t\n\x{A0}\x{3000}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]+')) > max_tokens""",
        "p5_found": f"""
            WITH m AS (
                SELECT mention_id, book_num, entity_type, {_CLEAN.format("name")} AS k, coalesce(length(description), 0) AS d,
                    len(list_distinct(list_filter(coalesce(aliases, []), lambda x: x IS NOT NULL AND trim(x, ' ') <> ''))) AS a,
                    len(list_distinct(coalesce(source_chapters, []))) AS c, extracted_at AS t, coalesce(trust, 0) AS u
                FROM entities_raw LEFT JOIN extractors USING (extractor_id)
            ), top AS (
                SELECT *, max(d) OVER w AS md, max(a) OVER w AS ma, max(c) OVER w AS mc, max(t) OVER w AS mt, max(u) OVER w AS mu, count(*) OVER w AS n
                FROM m WHERE k IS NOT NULL WINDOW w AS (PARTITION BY book_num, entity_type, k)
            ), best AS (SELECT *, count(*) OVER (PARTITION BY book_num, entity_type, k) AS ties FROM top WHERE d = md AND a = ma AND c = mc AND t = mt AND u = mu AND n > 1)
            SELECT mention_id FROM best WHERE ties = 1""",
        # Layers by the longest chain of records above; each field from the first layer that has it, by the policy within a layer.
        "p5_survivors": f"""
            WITH RECURSIVE m AS (
                SELECT mention_id AS id, book_num, entity_type, {_CLEAN.format("name")} AS k, coalesce(length(description), 0) AS d,
                    len(list_distinct(list_filter(coalesce(aliases, []), lambda x: x IS NOT NULL AND trim(x, ' ') <> ''))) AS a,
                    len(list_distinct(list_filter(coalesce(source_chapters, []), lambda x: x IS NOT NULL))) AS c, coalesce(epoch_us(extracted_at), -4611686018427387904) AS t, coalesce(trust, 0) AS u,
                    name, description, aliases, source_chapters, extractor_id, extracted_at
                FROM entities_raw LEFT JOIN extractors USING (extractor_id)
            ), g AS (SELECT * FROM m WHERE k IS NOT NULL AND book_num IS NOT NULL AND entity_type IS NOT NULL QUALIFY count(*) OVER (PARTITION BY book_num, entity_type, k) > 1
            ), above AS (
                SELECT x.id AS low, y.id AS high FROM g x JOIN g y ON x.book_num = y.book_num AND x.entity_type = y.entity_type AND x.k = y.k AND y.d >= x.d AND y.a >= x.a AND y.c >= x.c AND y.t >= x.t AND y.u >= x.u
                    AND (y.d > x.d OR y.a > x.a OR y.c > x.c OR y.t > x.t OR y.u > x.u)
            ), chain(id, n) AS (
                SELECT id, 1 FROM g UNION SELECT low, n + 1 FROM chain JOIN above ON high = id
            ), placed AS (
                SELECT g.*, row_number() OVER (PARTITION BY book_num, entity_type, k ORDER BY layer, u DESC, t DESC, d DESC, a DESC, c DESC, id) AS place,
                    layer = 1 AND count(*) FILTER (layer = 1) OVER (PARTITION BY book_num, entity_type, k) = 1 AS alone
                FROM g JOIN (SELECT id, max(n) AS layer FROM chain GROUP BY id) USING (id)
            )
            SELECT book_num, entity_type, k AS clean_name, arg_min(id, place) AS mention_id, arg_min(struct_pack(v := name), place).v AS name, arg_min(description, place) FILTER (length(trim(description, ' ')) > 0) AS description,
                array_to_string(arg_min(aliases, place) FILTER (a > 0), '|') AS aliases, array_to_string(arg_min(source_chapters, place) FILTER (c > 0), ',') AS source_chapters, arg_min(extractor_id, place) FILTER (extractor_id IS NOT NULL) AS extractor_id,
                epoch_us(arg_min(struct_pack(v := extracted_at), place).v) AS extracted_us, bool_or(alone) AS dominant
            FROM placed GROUP BY ALL""",
    }
