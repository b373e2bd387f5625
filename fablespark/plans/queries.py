"""Queries of the book pipeline over the tables of a data directory, each with its SQL where SQL can say it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablespark.backends.models import create
from fablespark.functions import formatting, jsonfix
from fablespark.functions import text as tx
from fablespark.functions.html import html_paragraphs
from fablespark.functions.vectors import word_counts_vector
from fablespark.operators import chapters as ch
from fablespark.operators import chunking as ck
from fablespark.operators import entities as en
from fablespark.operators import extraction as ex
from fablespark.operators import mentions as mn
from fablespark.operators import profiles as pf
from fablespark.operators import retrieval as rt
from fablespark.operators import scenes as sc
from fablespark.params import ChunkProfile, ExtractionParams, SceneProfile
from fablespark.runtime import table
from fablespark.schemas import TYPES
from fablespark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = " ".join(line for line in sql.splitlines()) if "\n--" not in sql else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- Shared inputs and their SQL -------------------------------------------------------------------------------------------------

BOOK = ["book_num", "chapter_num"]
WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"
CHAPTERS = "chapter AS (SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY book_num, chapter_num ORDER BY ingested_at DESC NULLS LAST) = 1)"
CHUNKS = "chunk AS (SELECT * FROM book_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
NAMED = f"named AS (SELECT * REPLACE (trim(name, {BLANK}) AS name, trim(entity_type, {BLANK}) AS entity_type) FROM entities_raw WHERE trim(name, {BLANK}) <> '' AND trim(entity_type, {BLANK}) <> '')"


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return ch.latest(table(spark, d, "chapters"), BOOK)


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The chunks as last delivered; named columns alone are read."""
    rows = table(spark, d, "book_chunks")
    return ch.latest(rows.select(*dict.fromkeys(["chunk_id", "ingested_at", *columns])) if columns else rows, ["chunk_id"])


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return en.named(table(spark, d, "entities_raw"))


# --- Chapters and paragraphs --------------------------------------------------------------------------------------------------------


@query(f"""
    WITH {CHAPTERS}, kept AS (SELECT * FROM chapter WHERE length(array_to_string(paragraphs, chr(10) || chr(10))) >= 1000 AND len(paragraphs) >= 10)
    SELECT book_num, chapter_num AS source_chapter, row_number() OVER (PARTITION BY book_num ORDER BY chapter_num)::INT AS new_num, len(paragraphs)::INT AS n FROM kept""")
def chapters_kept(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that are long enough, numbered anew without gaps."""
    kept = ch.numbered(ch.long_enough(_chapters(spark, d)), "book_num", ["chapter_num"], "new_num")
    return kept.select("book_num", F.col("chapter_num").alias("source_chapter"), "new_num", F.size("paragraphs").alias("n"))


@query(f"""
    WITH {CHAPTERS}, kept AS (SELECT *, row_number() OVER (PARTITION BY book_num ORDER BY chapter_num)::INT AS new_num FROM chapter WHERE length(array_to_string(paragraphs, chr(10) || chr(10))) >= 1000 AND len(paragraphs) >= 10),
    parted AS (SELECT book_num, new_num AS chapter_num, paragraphs[2] AS chapter_title, paragraphs[3:] AS body, length(array_to_string(paragraphs, chr(10) || chr(10)))::INT AS char_count FROM kept)
    SELECT book_num, chapter_num, chapter_title, len(body)::INT AS paragraph_count, char_count, list_min(list_transform(body, lambda x: length(x)))::INT AS paragraph_min_chars,
        list_max(list_transform(body, lambda x: length(x)))::INT AS paragraph_max_chars, floor(list_sum(list_transform(body, lambda x: length(x))) / len(body))::INT AS paragraph_avg_chars FROM parted""")
def chapter_records(spark: SparkSession, d: str) -> DataFrame:
    """Chapter records built from pages: title and body parted, measured."""
    pages = _chapters(spark, d).select("book_num", F.col("chapter_num").alias("position"), "paragraphs")
    return ch.build_chapters(pages).drop("paragraphs")


@query(f"""
    WITH {CHAPTERS}, p AS (SELECT book_num, chapter_num, unnest(paragraphs) AS x FROM chapter)
    SELECT book_num, chapter_num, count(*) AS paragraphs, min(length(x))::INT AS min_chars, max(length(x))::INT AS max_chars, floor(avg(length(x)))::BIGINT AS avg_chars FROM p WHERE x IS NOT NULL GROUP BY ALL""")
def paragraph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the paragraphs of each chapter."""
    return ch.paragraph_stats(ch.paragraph_rows(_chapters(spark, d), BOOK), BOOK)


@query(f"""
    WITH {CHAPTERS}, p AS (SELECT book_num, chapter_num, unnest(paragraphs) AS x, generate_subscripts(paragraphs, 1) - 1 AS i FROM chapter),
    a AS (SELECT *, avg(length(x)) OVER (PARTITION BY book_num, chapter_num) AS m FROM p WHERE x IS NOT NULL)
    SELECT book_num, chapter_num, i::INT AS position, length(x)::INT AS chars FROM a WHERE length(x) < 0.1::DOUBLE * m""")
def short_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs much shorter than the others of their chapter."""
    return ch.short_paragraphs(ch.paragraph_rows(_chapters(spark, d), BOOK), BOOK)


@query(rf"""
    WITH {CHAPTERS}, p AS (SELECT unnest(paragraphs) AS x FROM chapter), w AS (SELECT CASE WHEN trim(x, {BLANK}) = '' THEN 0 ELSE len(regexp_split_to_array(trim(x, {BLANK}), '\s+')) END AS n FROM p WHERE x IS NOT NULL),
    s AS (SELECT count(*) AS c, avg(n) AS m, stddev_pop(n) AS d, quantile_cont(n, [0.25::DOUBLE, 0.5, 0.75, 0.95, 0.995]) AS q FROM w)
    SELECT c AS paragraphs, round(m, 6) AS mean, round(d, 6) AS std, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75, round(q[4], 6) AS p95, round(q[5], 6) AS p99_5,
        round(m - d, 6) AS minus_1_std, round(m + d, 6) AS plus_1_std, round(m - 2 * d, 6) AS minus_2_std, round(m + 2 * d, 6) AS plus_2_std FROM s""")
def word_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of words per paragraph."""
    return ch.word_distribution(ch.paragraph_rows(_chapters(spark, d), BOOK))


@query(rf"""
    SELECT doc_id, length(text)::INT AS chars, floor(length(text) / 4)::BIGINT AS approx_tokens, CASE WHEN trim(text, {BLANK}) = '' THEN 0 WHEN text IS NULL THEN 0 ELSE len(regexp_split_to_array(trim(text, {BLANK}), '\s+')) END::INT AS words,
        coalesce(nullif(substring(text, 1, 40), ''), '[Empty chunk]') AS preview, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {BLANK})), lambda p: p <> ''))::INT AS parts,
        md5(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g')) AS collapsed, md5(lower(trim(text, {BLANK}))) AS normal FROM documents""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Length, words, parts and normal forms of the documents."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.length(t).alias("chars"),
        tx.approx_tokens(t).alias("approx_tokens"),
        tx.word_count(t).alias("words"),
        tx.preview(t, 40).alias("preview"),
        F.size(tx.blank_line_parts(t)).alias("parts"),
        F.md5(tx.collapse_breaks(t)).alias("collapsed"),
        F.md5(tx.normalise(t)).alias("normal"),
    )


@query("""
    WITH n AS (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000.0)::BIGINT)) AS i FROM documents WHERE length(text) > 0)
    SELECT doc_id, i::INT AS position, substring(text, (i * 1000 + 1)::BIGINT, 1000) AS slice FROM n""")
def char_slices(spark: SparkSession, d: str) -> DataFrame:
    """Documents in slices of 1000 characters."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.char_slices(F.col("text"), 1000)).alias("position", "slice"))


@query(f"""
    WITH {CHAPTERS} SELECT book_num, chapter_num, list_filter(list_transform(paragraphs, lambda p: trim(regexp_replace(regexp_replace(p, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), {BLANK})), lambda p: p <> '') AS paragraphs, nullif(trim(coalesce(chapter_title, ''), {BLANK}), '') AS h1 FROM chapter""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and heading of chapters that are written as HTML and read back."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform("paragraphs", lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "\n")
    pages = _chapters(spark, d).select(F.concat_ws("/", "book_num", "chapter_num").alias("page"), F.concat(F.lit("<html><body><nav>x</nav><h1>"), escaped(F.coalesce("chapter_title", F.lit(""))), F.lit("</h1><script>var p = 1;</script>"), body, F.lit("</body></html>")).alias("html"))
    read = html_paragraphs(pages, "page")
    place = F.split("page", "/")
    return read.select(place[0].cast("int").alias("book_num"), place[1].cast("int").alias("chapter_num"), "paragraphs", "h1")


# --- Chunks ---------------------------------------------------------------------------------------------------------------------------


@query()
def packed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents in pieces of at most 1500 characters, packed from paragraphs and sentences."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(ck.split_or_keep(F.col("text"), 1500)).alias("position", "piece"))


@query()
def overlapping_windows(spark: SparkSession, d: str) -> DataFrame:
    """Documents in windows of about 1000 characters that share 100."""
    return ck.window_rows(table(spark, d, "documents"), "doc_id", "text", 1000, 1400, 100)


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chapters in chunks by size and similarity, tiny ones merged, as chunk records."""
    chapters = _chapters(spark, d)
    raw = ck.chunk_chapters(chapters, ChunkProfile(min_tokens=120, max_tokens=250))
    merged = ck.merge_tiny(raw, BOOK, "raw_index", "tokens", "text", 50)
    return ck.chunk_records(merged.join(chapters.select(*BOOK, "chapter_title"), BOOK), "library", "Serial")


@query(f"""
    WITH {CHUNKS}, h AS (SELECT *, sum(CASE WHEN coalesce(token_count, 0) >= 150 OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_number, chapter_number ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, row_number() OVER (PARTITION BY book_number, chapter_number ORDER BY chunk_id) AS rn FROM chunk))
    SELECT book_number, chapter_number, g::BIGINT AS "group", count(*) AS chunks, sum(coalesce(token_count, 0))::BIGINT AS tokens, md5(string_agg(coalesce(text, ''), ' ' ORDER BY chunk_id)) AS text FROM h GROUP BY ALL""")
def tiny_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks below 150 tokens joined to the one before."""
    return ck.merge_tiny(_chunks(spark, d, "book_number", "chapter_number", "token_count", "text"), ["book_number", "chapter_number"], "chunk_id", "token_count", "text", 150).withColumn("text", F.md5("text"))


@query(f"""
    WITH {CHUNKS} SELECT book_number, chapter_number, grouping_id(book_number, chapter_number)::BIGINT AS level, count(*) AS chunks, sum(length(coalesce(text, '')))::BIGINT AS total_chars, floor(avg(length(coalesce(text, ''))))::BIGINT AS avg_chars,
        min(length(coalesce(text, '')))::INT AS min_chars, max(length(coalesce(text, '')))::INT AS max_chars, sum(coalesce(token_count, 0))::BIGINT AS total_tokens, floor(avg(coalesce(token_count, 0)))::BIGINT AS avg_tokens, min(coalesce(token_count, 0)) AS min_tokens, max(coalesce(token_count, 0)) AS max_tokens
    FROM chunk GROUP BY ROLLUP (book_number, chapter_number)""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the chunks per chapter, per book and in total."""
    return ck.chunk_stats(_chunks(spark, d, "book_number", "chapter_number", "text", "token_count"))


@query(f"""
    WITH {CHUNKS} SELECT book_number, chapter_number, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunk WINDOW w AS (PARTITION BY book_number, chapter_number ORDER BY chunk_index, chunk_id)""")
def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    """The chunks before and after each chunk."""
    return ck.link_neighbours(_chunks(spark, d, "book_number", "chapter_number", "chunk_index"), ["book_number", "chapter_number"], ["chunk_index", "chunk_id"])


@query(f"""
    WITH {CHUNKS}, t AS (SELECT book_number, chapter_number, chunk_id AS first_chunk_id, lead(chunk_id, 1) OVER w AS second_chunk_id, lead(chunk_id, 2) OVER w AS third_chunk_id FROM chunk WINDOW w AS (PARTITION BY book_number, chapter_number ORDER BY chunk_index, chunk_id))
    SELECT * FROM t WHERE third_chunk_id IS NOT NULL""")
def chunk_triples(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the two after it."""
    return sc.chunk_triples(_chunks(spark, d, "book_number", "chapter_number", "chunk_index"), ["book_number", "chapter_number"], ["chunk_index", "chunk_id"], ["chunk_id"])


@query(f"""
    WITH {CHUNKS} SELECT chunk_id, format('book_{{:02d}}_ch_{{:02d}}_chunk_{{:03d}}', book_number, chapter_number, chunk_index) AS made, row_number() OVER (PARTITION BY book_number, chapter_number ORDER BY chunk_id)::INT AS place, count(*) OVER (PARTITION BY book_number, chapter_number) AS total FROM chunk""")
def chunk_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifier, place and number of the chunks of a chapter."""
    from pyspark.sql import Window

    w = Window.partitionBy("book_number", "chapter_number")
    made = tx.chunk_id(F.col("book_number"), F.col("chapter_number"), F.col("chunk_index"))
    return _chunks(spark, d, "book_number", "chapter_number", "chunk_index").select("chunk_id", made.alias("made"), F.row_number().over(w.orderBy("chunk_id")).alias("place"), F.count("*").over(w).alias("total"))


# --- Scenes ---------------------------------------------------------------------------------------------------------------------------

SIMILARITY = "s AS (SELECT label, vec_id, CASE WHEN nxt IS NOT NULL THEN list_cosine_similarity(e, nxt) END AS sim FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings))"


def _valleys(at: str, least: str, strong: str, recovery: float) -> str:
    return f"""{SIMILARITY}, t AS (SELECT *, lag(sim) OVER w AS b, lead(sim) OVER w AS a, avg(sim) OVER p AS m, stddev_pop(sim) OVER p AS sd, quantile_cont(sim, 0.25::DOUBLE) OVER p AS q FROM s WINDOW p AS (PARTITION BY label), w AS (PARTITION BY label ORDER BY vec_id)),
        v AS (SELECT *, coalesce(((sim < b AND sim < a AND sim <= {at} AND b - sim >= {least}) OR (b - sim >= {strong} AND sim <= {at})) AND NOT (a - sim > {recovery}::DOUBLE), false) AS valley FROM t)"""


_PROFILES = {
    "fixed": (SceneProfile(threshold=0.0, strategy="fixed"), _valleys("0.0::DOUBLE", "0.02::DOUBLE", "0.04::DOUBLE", 0.05)),
    "conservative": (SceneProfile(strategy="conservative", recovery=0.5), _valleys("m - 0.5::DOUBLE * sd", "0.5::DOUBLE * sd", "1.5::DOUBLE * sd", 0.5)),
    "moderate": (SceneProfile(strategy="moderate", recovery=0.5), _valleys("m - sd", "sd", "1.5::DOUBLE * sd", 0.5)),
    "aggressive": (SceneProfile(strategy="aggressive", recovery=0.2), _valleys("q", "sd", "1.5::DOUBLE * sd", 0.2)),
}
_NUMBERED = "n AS (SELECT *, 1 + coalesce(sum(CASE WHEN valley THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS scene_number FROM v)"
_SCENES = "scene AS (SELECT * EXCLUDE total FROM (SELECT *, sum(num_chunks) OVER (PARTITION BY label) AS total FROM (SELECT label, scene_number, count(*) AS num_chunks, coalesce(avg(sim) FILTER (NOT valley), 0) AS avg_similarity, coalesce(min(sim) FILTER (NOT valley), 0) AS min_similarity, list(vec_id ORDER BY vec_id) AS chunk_ids FROM n GROUP BY ALL)) WHERE total >= 2)"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _marked(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return sc.mark_boundaries(sc.consecutive_similarity(_embeddings(spark, d), ["label"], "vec_id"), ["label"], "vec_id", _PROFILES[strategy][0])


@query(f"WITH {SIMILARITY} SELECT label, vec_id, round(sim, 6) AS sim FROM s")
def consecutive_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to the next of its label."""
    return sc.consecutive_similarity(_embeddings(spark, d), ["label"], "vec_id").select("label", "vec_id", F.round("sim", 6).alias("sim"))


@query(f"""
    WITH {SIMILARITY}, a AS (SELECT label, count(*) AS n, avg(sim) AS m, stddev_pop(sim) AS sd, min(sim) AS lo, max(sim) AS hi, quantile_cont(sim, [0.25::DOUBLE, 0.5, 0.75]) AS q FROM s WHERE sim IS NOT NULL GROUP BY label)
    SELECT label, n, round(m, 6) AS mean, round(sd, 6) AS std, round(lo, 6) AS least, round(hi, 6) AS greatest, round(q[1], 6) AS p25, round(q[2], 6) AS median, round(q[3], 6) AS p75, round(hi - lo, 6) AS spread, round(m - 0.5::DOUBLE * sd, 6) AS conservative_threshold,
        round(m - sd, 6) AS moderate_threshold, round(q[1], 6) AS aggressive_threshold, round(0.5::DOUBLE * sd, 6) AS conservative_drop, round(sd, 6) AS moderate_drop, round(1.5::DOUBLE * sd, 6) AS strong_drop FROM a""")
def similarity_profile(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the similarities of each label and the thresholds from it."""
    return sc.similarity_profile(sc.consecutive_similarity(_embeddings(spark, d), ["label"], "vec_id"), ["label"])


def _boundary_query(strategy: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _marked(spark, d, strategy).where("valley").select("label", "vec_id")

    f.__name__ = f"scene_boundaries_{strategy}"
    f.__doc__ = f"Where scenes end, by the {strategy} profile."
    query(f"WITH {_PROFILES[strategy][1]} SELECT label, vec_id FROM v WHERE valley")(f)


for _s in _PROFILES:
    _boundary_query(_s)


@query(f"WITH {_PROFILES['aggressive'][1]} SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS position, round(sim, 6) AS sim, valley FROM v WHERE sim IS NOT NULL")
def similarity_series(spark: SparkSession, d: str) -> DataFrame:
    """The series of a similarity plot."""
    return sc.similarity_series(_marked(spark, d, "aggressive"), ["label"], "vec_id")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return sc.detect_scenes(_embeddings(spark, d), ["label"], "vec_id", _PROFILES["aggressive"][0], chunk="vec_id")


@query(f"WITH {_PROFILES['aggressive'][1]}, {_NUMBERED}, {_SCENES} SELECT label, scene_number, num_chunks, round(avg_similarity, 6) AS avg_similarity, round(min_similarity, 6) AS min_similarity, array_to_string(chunk_ids, ',') AS chunk_ids FROM scene")
def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with their chunks and inner similarities."""
    return _scenes(spark, d).select("label", "scene_number", "num_chunks", F.round("avg_similarity", 6).alias("avg_similarity"), F.round("min_similarity", 6).alias("min_similarity"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"""
    WITH {_PROFILES["aggressive"][1]}, {_NUMBERED}, {_SCENES}
    SELECT label, grouping_id(label)::BIGINT AS is_total, count(*) AS scenes, sum(num_chunks)::BIGINT AS chunks, round(avg(num_chunks), 6) AS avg_chunks, min(num_chunks) AS min_chunks, max(num_chunks) AS max_chunks, round(avg(avg_similarity), 6) AS avg_similarity, round(min(min_similarity), 6) AS min_similarity
    FROM scene GROUP BY ROLLUP (label)""")
def scene_report(spark: SparkSession, d: str) -> DataFrame:
    """Scenes per label and in total."""
    return sc.scene_report(_scenes(spark, d), "label")


@query("SELECT scene_id, format('book_{:02d}_ch_{:02d}_scene_{:03d}', book_number, chapter_number, scene_number) AS made, num_chunks, len(chunk_ids)::INT AS listed, round(coalesce(avg_similarity, 0), 6) AS avg_similarity FROM scenes")
def stored_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Stored scenes with the identifier made anew."""
    rows = table(spark, d, "scenes")
    return rows.select("scene_id", tx.scene_id(F.col("book_number"), F.col("chapter_number"), F.col("scene_number")).alias("made"), "num_chunks", F.size("chunk_ids").alias("listed"), F.round(F.coalesce("avg_similarity", F.lit(0.0)), 6).alias("avg_similarity"))


@query()
def model_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of chunks where a backend says whether two chunks, whole, are one scene."""
    keys = ["book_number", "chapter_number"]
    from pyspark.sql import Window

    rows = _chunks(spark, d, *keys, "text", "token_count").select(*keys, "chunk_id", "text", "token_count")
    following = F.lead("text").over(Window.partitionBy(*keys).orderBy("chunk_id"))
    prompt = F.concat(F.lit("CHUNK "), F.coalesce(F.nullif("text", F.lit("")), F.lit("[Empty chunk]")), F.lit(" CHUNK "), F.coalesce(F.nullif(following, F.lit("")), F.lit("[Empty chunk]")))
    asked = ex.call_model(rows.withColumn("prompt", prompt), lambda: create("same scene"))
    numbered = sc.scenes_by_answers(asked, keys, "chunk_id", F.coalesce(formatting.yes_or_no(F.col("response")), F.lit(True))).withColumn("sim", F.lit(None).cast("double"))
    built = sc.build_scenes(numbered, keys, "chunk_id", SceneProfile(drop_short=False), text="text", tokens="token_count", chunk="chunk_id")
    return built.select(*keys, "scene_number", "num_chunks", "chunk_ids", F.length("text").alias("characters"), F.lit("model").alias("detection_method"))


# --- Mentions -------------------------------------------------------------------------------------------------------------------------

_TERMS = f"term AS (SELECT DISTINCT book_num, entity_type, lower(trim(name, {BLANK})) AS n, lower(trim(s, {BLANK})) AS t FROM (SELECT *, unnest(list_append(coalesce(aliases, []), name)) AS s FROM named) WHERE trim(s, {BLANK}) <> '')"
_HITS = rf"""{CHUNKS}, {NAMED}, {_TERMS}, w AS (SELECT book_number, chapter_number, chunk_id, lower(text) AS lt, {WORDS.format("text")} AS ws FROM chunk WHERE text IS NOT NULL),
    hit AS (SELECT DISTINCT book_number, chapter_number, chunk_id, entity_type, n FROM w JOIN term ON book_num = book_number
        AND CASE WHEN contains(t, ' ') THEN contains(lt, t) WHEN regexp_full_match(t, '[\p{{L}}\p{{N}}_]+') THEN list_contains(ws, t) ELSE regexp_matches(lt, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(t) || '($|[^\p{{L}}\p{{N}}_])') END)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "book_number", "chapter_number", "text").where("text IS NOT NULL").select(F.col("book_number").alias("book_num"), "chapter_number", "chunk_id", "text")
    entities = _entities(spark, d).withColumn("name", tx.normalise("name"))
    return mn.entities_in_texts(chunks, ["chapter_number", "chunk_id"], entities, ["book_num", "entity_type", "name"], ["book_num"])


@query(f"WITH {_HITS} SELECT book_number AS book_num, chapter_number, chunk_id, entity_type, n AS name FROM hit")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and the entities of their book that they mention."""
    return _hits(spark, d).select("book_num", "chapter_number", "chunk_id", "entity_type", "name")


@query(f"""
    WITH {_HITS}, p AS (SELECT book_number, chapter_number, entity_type, n, count(*) AS c FROM hit GROUP BY ALL)
    SELECT book_number AS book_num, entity_type, n AS name, sum(c)::BIGINT AS total_mentions, count(*) AS chapters_appeared, string_agg(chapter_number || ':' || c, ',' ORDER BY chapter_number) AS per_chapter FROM p GROUP BY ALL""")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each entity, in all and per chapter."""
    per = F.array_join(F.transform("per_chapter", lambda x: F.concat_ws(":", x["chapter_num"].cast("string"), x["mentions"].cast("string"))), ",")
    return mn.mention_counts(_hits(spark, d), ["book_num", "entity_type", "name"], "chapter_number").withColumn("per_chapter", per)


@query(f"""
    WITH {_HITS}, h AS (SELECT DISTINCT book_number || '/' || n AS e, chunk_id FROM hit)
    SELECT a.e AS entity_a, b.e AS entity_b, count(*) AS texts FROM h a JOIN h b ON a.chunk_id = b.chunk_id AND a.e < b.e GROUP BY ALL""")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are mentioned in the same chunk."""
    return mn.co_occurrence(_hits(spark, d).withColumn("e", F.concat_ws("/", "book_num", "name")), ["chunk_id"], "e")


@query(f"WITH {_HITS}, e AS (SELECT DISTINCT book_num, entity_type, lower(trim(name, {BLANK})) AS name FROM named) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.book_number = e.book_num AND hit.entity_type = e.entity_type AND hit.n = e.name)")
def unmentioned(spark: SparkSession, d: str) -> DataFrame:
    """Entities that no chunk of their book mentions."""
    own = _entities(spark, d).select("book_num", "entity_type", tx.normalise("name").alias("name")).distinct()
    return own.join(_hits(spark, d), ["book_num", "entity_type", "name"], "left_anti")


@query(f"WITH {NAMED} SELECT book_num, entity_type, name, array_to_string(list_sort(list(DISTINCT chapter_num)), ',') AS chapters FROM named GROUP BY ALL")
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of each entity."""
    return mn.entity_index(_entities(spark, d), ["book_num", "entity_type", "name"]).withColumn("chapters", F.array_join("chapters", ","))


@query(f"WITH {NAMED} SELECT book_num, chapter_num, " + ", ".join(f"CASE WHEN bool_or(entity_type = '{t}') THEN 'X' ELSE '' END AS c{t}" for t in TYPES) + " FROM named GROUP BY ALL")
def presence_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Which types each chapter has."""
    return mn.presence_matrix(_entities(spark, d), BOOK, "entity_type", TYPES)


@query(f"WITH {NAMED} SELECT book_num, entity_type, name, min(chapter_num) AS first_chapter, array_to_string(list_sort(list(DISTINCT chapter_num)), ',') AS appearances, count(*) AS mention_count FROM named GROUP BY ALL")
def first_appearances(spark: SparkSession, d: str) -> DataFrame:
    """First chapter, chapters and number of records of each entity."""
    return mn.first_appearances(_entities(spark, d), ["book_num", "entity_type", "name"]).withColumn("appearances", F.array_join("appearances", ","))


@query(f"WITH {NAMED} SELECT book_num, alias, name, min(chapter_num) AS first_chapter FROM (SELECT book_num, chapter_num, name, unnest(aliases) AS alias FROM named) WHERE length(trim(alias, ' ')) > 0 GROUP BY ALL")
def alias_index(spark: SparkSession, d: str) -> DataFrame:
    """From which chapter on an alias is known."""
    return mn.alias_index(_entities(spark, d))


@query(f"WITH {NAMED} SELECT mention_id, book_num, chapter_num, name FROM named WHERE book_num < 4 OR (book_num = 4 AND chapter_num <= 6)")
def spoiler_filter(spark: SparkSession, d: str) -> DataFrame:
    """What a reader may see who has come to chapter 6 of book 4."""
    return mn.up_to(_entities(spark, d), 4, 6).select("mention_id", *BOOK, "name")


@query(f"""
    WITH {NAMED}, a AS (SELECT book_num, chapter_num AS c, entity_type, name FROM named), t AS (SELECT DISTINCT book_num, chapter_num FROM named)
    SELECT t.book_num, t.chapter_num, count(DISTINCT (entity_type, name)) AS known FROM t JOIN a ON a.book_num = t.book_num AND a.c < t.chapter_num GROUP BY ALL""")
def known_before(spark: SparkSession, d: str) -> DataFrame:
    """Entities of earlier chapters that each chapter can build on."""
    return mn.known_counts(_entities(spark, d))


@query(f"WITH {NAMED} SELECT book_num, entity_type, name, string_agg(chapter_num || ':' || mention_id, ',' ORDER BY chapter_num, mention_id) AS states FROM named GROUP BY ALL")
def entity_timeline(spark: SparkSession, d: str) -> DataFrame:
    """States of each entity in order of chapters."""
    states = F.array_join(F.transform("states", lambda s: F.concat_ws(":", s["chapter_num"].cast("string"), s["mention_id"].cast("string"))), ",")
    return mn.timeline(_entities(spark, d), ["book_num", "entity_type", "name"]).withColumn("states", states)


_CHAPTER_HITS = rf"""{CHAPTERS}, {NAMED}, pt AS (SELECT DISTINCT book_num, entity_type, name, lower(trim(s, {BLANK})) AS t FROM (SELECT *, unnest(list_append(coalesce(aliases, []), name)) AS s FROM named) WHERE trim(s, {BLANK}) <> ''),
    ct AS (SELECT book_num, chapter_num, lower(x) AS lt, {WORDS.format("x")} AS ws FROM (SELECT *, array_to_string(paragraphs, chr(10) || chr(10)) AS x FROM chapter)),
    told AS (SELECT DISTINCT book_num, chapter_num, entity_type, name FROM ct JOIN pt USING (book_num)
        WHERE CASE WHEN contains(t, ' ') THEN contains(lt, t) WHEN regexp_full_match(t, '[\p{{L}}\p{{N}}_]+') THEN list_contains(ws, t) ELSE regexp_matches(lt, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(t) || '($|[^\p{{L}}\p{{N}}_])') END)"""


@query(rf"""
    WITH {_CHAPTER_HITS}, al AS (SELECT book_num, chapter_num AS c, entity_type, name, list_filter(list_transform(coalesce(aliases, []), lambda a: trim(a, {BLANK})), lambda a: a IS NOT NULL AND a <> '') AS al FROM named),
    seen AS (SELECT t.book_num, t.chapter_num, entity_type, name, list_sort(list_distinct(flatten(list(al)))) AS al FROM (SELECT DISTINCT book_num, chapter_num FROM named) t JOIN al ON al.book_num = t.book_num AND c < t.chapter_num GROUP BY ALL),
    few AS (SELECT *, row_number() OVER (PARTITION BY book_num, chapter_num, entity_type ORDER BY name) AS r FROM seen SEMI JOIN told USING (book_num, chapter_num, entity_type, name)),
    line AS (SELECT book_num, chapter_num, entity_type, name, '- ' || name || CASE WHEN len(al) > 0 THEN ' (' || array_to_string(al[:30], ', ') || ')' ELSE '' END AS line FROM few WHERE r <= 200)
    SELECT book_num, chapter_num, string_agg(line, chr(10) ORDER BY entity_type, name) AS context FROM line GROUP BY ALL""")
def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines on the entities of earlier chapters that a chapter mentions, for its prompts."""
    e = en.with_clean_aliases(_entities(spark, d))
    texts = _chapters(spark, d).select(*BOOK, F.array_join("paragraphs", "\n\n").alias("text"))
    told = mn.entities_in_texts(texts, BOOK, _entities(spark, d), ["book_num", "entity_type", "name"], ["book_num"])
    p = ExtractionParams()
    return mn.context_sections(mn.seen_before(e, e), BOOK, p.context_limit, p.alias_limit, told if p.context_filter else None)


# --- Entities ---------------------------------------------------------------------------------------------------------------------------

_MERGED = "array_to_string(list_sort(list_distinct(list_filter(flatten(list(list_append(coalesce(aliases, []), name))), lambda a: a IS NOT NULL AND a <> {name}))), '|')"


@query(f"""
    WITH {NAMED}, g AS (SELECT book_num, chapter_num, entity_type, lower(trim(name, {BLANK})) AS k, arg_max(name, (length(name), -mention_id)) AS nm, count(*) AS members, arg_max(description, (length(description), mention_id)) FILTER (description IS NOT NULL) AS description,
        flatten(list(list_append(coalesce(aliases, []), name))) AS al, list_sort(list_distinct(list_filter(flatten(list(coalesce(source_chapters, []))), lambda c: c IS NOT NULL))) AS sc FROM named GROUP BY ALL)
    SELECT book_num, chapter_num, entity_type, nm AS name, members, description, array_to_string(sc, ',') AS source_chapters, array_to_string(list_sort(list_distinct(list_filter(al, lambda a: a IS NOT NULL AND a <> nm))), '|') AS aliases FROM g""")
def within_chapter_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a chapter with one name, merged."""
    merged = en.merge_within_chapter(_entities(spark, d))
    return merged.withColumn("source_chapters", F.array_join("source_chapters", ",")).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""
    WITH {NAMED} SELECT book_num, entity_type, name, array_to_string(list_sort(list_distinct(coalesce(list(description) FILTER (description IS NOT NULL), []))), '|') AS description, array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(aliases, []))), lambda a: a IS NOT NULL))), '|') AS aliases FROM named GROUP BY ALL""")
def raw_merge(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions and aliases of equal type and name as lists, compared for equality."""
    out = en.merge_raw(_entities(spark, d), ["book_num", "entity_type", "name"], "mention_id", None)
    return out.withColumn("description", F.array_join(F.array_sort("description"), "|")).withColumn("aliases", F.array_join(F.array_sort("aliases"), "|"))


@query()
def raw_merge_alike(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions and aliases as lists, without values that are alike."""
    return en.merge_raw(_entities(spark, d), ["book_num", "entity_type", "name"], "mention_id")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = en.merge_within_chapter(_entities(spark, d)).withColumn("id", F.concat_ws("/", *BOOK, "entity_type", tx.normalise("name"))).withColumn("order", F.xxhash64("id"))
    return en.resolve_entities(rows)


@query()
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of all chapters of a book, resolved by name, alias and ratio, and merged."""
    return _resolved(spark, d)


@query()
def dedup_report(spark: SparkSession, d: str) -> DataFrame:
    """Entities per type before and after resolution."""
    e = _entities(spark, d)
    return en.dedup_report(e, en.merge_within_chapter(e), _resolved(spark, d))


@query(f"WITH {NAMED} SELECT book_num, grouping_id(book_num)::BIGINT AS is_total, " + ", ".join(f"count_if(entity_type = '{t}')::BIGINT AS \"{t}\"" for t in TYPES) + ", count(*) AS total FROM named GROUP BY ROLLUP (book_num)")
def entity_counts_total(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each type per book and in total."""
    return en.counts_with_total(_entities(spark, d), "book_num")


@query(f"WITH {NAMED} SELECT book_num, chapter_num, " + ", ".join(f"count_if(entity_type = '{t}')::BIGINT AS \"{t}\"" for t in TYPES) + ", count(*) AS total FROM named GROUP BY ALL")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each type per chapter."""
    return en.counts_by_chapter(_entities(spark, d), BOOK)


@query(f"""
    WITH {NAMED}, r AS (SELECT DISTINCT book_num, name, alias, entity_type FROM (SELECT book_num, name, entity_type, unnest(aliases) AS alias FROM named) WHERE length(trim(alias, ' ')) > 0),
    p AS (SELECT book_num, name, alias, string_agg(entity_type, '+' ORDER BY entity_type) AS t FROM r GROUP BY ALL)
    SELECT book_num, name, string_agg(alias || '=' || t, ';' ORDER BY alias) AS relationships FROM p GROUP BY ALL""")
def relationships(spark: SparkSession, d: str) -> DataFrame:
    """Per name the other names it is known by, with the types, consolidated."""
    rows = _entities(spark, d).select("book_num", "name", F.explode("aliases").alias("entity"), F.col("entity_type").alias("relationship"))
    shown = F.array_join(F.transform("relationships", lambda r: F.concat(r["entity"], F.lit("="), F.array_join(r["relationships"], "+"))), ";")
    return en.consolidate_relationships(rows, ["book_num", "name"]).withColumn("relationships", shown)


@query(f"WITH {NAMED} SELECT extractor_id, array_to_string(list_sort(list(DISTINCT name)), '|') AS members, array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(source_chapters, []))), lambda c: c IS NOT NULL))), ',') AS chapters FROM named WHERE extractor_id IS NOT NULL GROUP BY ALL")
def group_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members and chapters of each value of an attribute."""
    out = en.group_members(_entities(spark, d), "extractor_id", "name", "source_chapters")
    return out.withColumn("members", F.array_join("members", "|")).withColumn("chapters", F.array_join("chapters", ","))


@query(f"""
    WITH {NAMED}, s AS (SELECT mention_id, 1 AS side, unnest(coalesce(aliases, [])) AS a, generate_subscripts(coalesce(aliases, []), 1) AS i FROM named UNION ALL SELECT mention_id, 0, lower(name), 1 FROM named),
    b AS (SELECT mention_id, lower(trim(a, {BLANK})) AS k, arg_max(a, (side, i)) AS a FROM s WHERE trim(a, ' ') <> '' GROUP BY ALL)
    SELECT mention_id, string_agg(a, '|' ORDER BY a) AS aliases FROM b GROUP BY ALL""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    """Aliases merged with a new spelling, one per spelling regardless of case."""
    merged = en.merge_aliases(F.col("aliases"), F.array(F.lower("name")))
    return _entities(spark, d).select("mention_id", F.array_join(merged, "|").alias("aliases"))


@query(f"WITH {NAMED} SELECT entity_type, name, array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(aliases, []))), lambda a: a IS NOT NULL))), '|') AS aliases FROM named GROUP BY ALL")
def accumulated(spark: SparkSession, d: str) -> DataFrame:
    """Entities of later chapters put into those of the first five."""
    e = _entities(spark, d)
    return en.upsert(e.where("chapter_num <= 5"), e.where("chapter_num > 5 OR chapter_num IS NULL")).withColumn("aliases", F.array_join("aliases", "|"))


@query("""
    SELECT mention_id, concat_ws('; ', CASE WHEN coalesce(trim(entity_type, ' '), '') = '' THEN 'no entity_type' END, CASE WHEN trim(entity_type, ' ') <> '' AND entity_type NOT IN ('character', 'location', 'object', 'event', 'group', 'concept') THEN 'unknown type ' || entity_type END,
        CASE WHEN coalesce(trim(name, ' '), '') = '' THEN 'no name' END, CASE WHEN coalesce(trim(description, ' '), '') = '' THEN 'no descriptive field' END) AS errors FROM entities_raw""")
def validation(spark: SparkSession, d: str) -> DataFrame:
    """What is missing in each record."""
    return en.validation_errors(table(spark, d, "entities_raw"), ["description"]).select("mention_id", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {NAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY name, mention_id) AS r FROM named) SELECT entity_type, name, array_to_string(list_filter(aliases[:30], lambda a: a IS NOT NULL), '|') AS aliases FROM r WHERE r <= 200")
def lightweight_context(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 entities of each type with at most 30 aliases: a top-k report."""
    return en.lightweight(_entities(spark, d)).withColumn("aliases", F.array_join("aliases", "|"))


@query()
def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    """Resolved entities by type and name with their aliases."""
    return en.entity_listing(_resolved(spark, d))


@query()
def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of aliases, chapters and records of the resolved entities."""
    return en.entity_summary(_resolved(spark, d))


# --- Model calls ------------------------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where("text IS NOT NULL").select(F.col("book_number").alias("book_num"), F.col("chapter_number").alias("chapter_num"), "chunk_id", "text")


@query()
def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the chunks by the rule-based model."""
    return ex.extract_raw(_texts(spark, d), lambda: create("rules"), [*BOOK, "chunk_id"])


@query()
def structured(spark: SparkSession, d: str) -> DataFrame:
    """Extracted entities merged and structured, one call per chapter and group of types."""
    return ex.structure_entities(ex.extract_raw(_texts(spark, d), lambda: create("rules"), [*BOOK, "chunk_id"]), lambda: create("rule structure"), BOOK)


@query()
def character_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mentions, dialogues and actions of the characters by the rule-based model."""
    people = _entities(spark, d).where("entity_type = 'character'").groupBy("book_num", "name").agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases"))
    return ex.character_statistics(_texts(spark, d), people, lambda: create("rule statistics"), ["book_num"], [*BOOK, "chunk_id"])


# --- Retrieval ----------------------------------------------------------------------------------------------------------------------------

_DENSE = """dense AS (SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM
    (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0)) WHERE rank <= 10)"""
_BM25 = rf"""{CHUNKS}, d AS (SELECT chunk_id, {WORDS.format("text")} AS ws FROM chunk WHERE text IS NOT NULL), size AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS mean FROM d),
    post AS (SELECT chunk_id, len, word, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS len, unnest(ws) AS word FROM d) GROUP BY ALL), ask AS (SELECT DISTINCT figure_id AS query_id, unnest({WORDS.format("figure_name")}) AS word FROM story_figures),
    df AS (SELECT word, count(*) AS df FROM post GROUP BY word), scored AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM post JOIN ask USING (word) JOIN df USING (word), size GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored) WHERE rank <= 10)"""


def _dense(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return rt.dense_top_k(e, e.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector"), 10)


def _figure_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story_figures").selectExpr("figure_id AS query_id", "figure_name AS query")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return rt.bm25_top_k(_chunks(spark, d, "text"), _figure_queries(spark, d), 10)


@query(f"WITH {_DENSE} SELECT * FROM dense")
def dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return _dense(spark, d)


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks for each figure's name."""
    return _bm25(spark, d)


_WORD_VECTOR = """SELECT {id}, list(coalesce(n, 0)::DOUBLE ORDER BY b) AS v FROM (SELECT {id}, b FROM {rows}, (SELECT unnest(range(64)) AS b)) LEFT JOIN (SELECT {id}, b, count(*) AS n FROM (SELECT {id}, ('0x' || substring(md5(unnest(ws)), 1, 2))::INT % 64 AS b FROM {rows}) GROUP BY ALL) USING ({id}, b) GROUP BY {id}"""


@query(rf"""
    WITH {_BM25}, asked AS (SELECT figure_id AS query_id, {WORDS.format("figure_name")} AS ws FROM story_figures WHERE figure_name IS NOT NULL), tv AS ({_WORD_VECTOR.format(id="chunk_id", rows="d")}), qv AS ({_WORD_VECTOR.format(id="query_id", rows="asked")}),
    near AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(tv.v, qv.v), 6) AS score FROM tv, qv WHERE list_sum(tv.v) > 0 AND list_sum(qv.v) > 0)) WHERE rank <= 10),
    f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM near) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f) WHERE rank <= 5""")
def hybrid_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of all chunks by words and by vectors of their whole texts, fused."""
    texts, asked = _chunks(spark, d, "text").where("text IS NOT NULL").select("chunk_id", "text"), _figure_queries(spark, d).where("query IS NOT NULL")
    vectors = texts.select("chunk_id", word_counts_vector(F.col("text")).alias("embedding"))
    wanted = asked.select("query_id", word_counts_vector(F.col("query")).alias("query_vector"))
    return rt.fuse([rt.bm25_top_k(texts, asked, 10), rt.dense_top_k(vectors, wanted, 10, chunk_id="chunk_id")], "chunk_id", 5)


@query(rf"""
    WITH {_BM25}, lc AS (SELECT query_id, 'chunks' AS layer, chunk_id AS id, rank FROM bm WHERE rank <= 5),
    m AS (SELECT DISTINCT scene_id, unnest(chunk_ids) AS chunk_id FROM scenes), ls AS (SELECT * FROM (SELECT query_id, 'scenes' AS layer, scene_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scene_id)::INT AS rank FROM (SELECT query_id, scene_id, round(sum(score), 6) AS score FROM m JOIN bm USING (chunk_id) GROUP BY ALL)) WHERE rank <= 3),
    lb AS (SELECT * FROM (SELECT query_id, 'chapters' AS layer, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (SELECT query_id, book_number || '/' || chapter_number AS id, round(sum(score), 6) AS score FROM bm JOIN chunk USING (chunk_id) WHERE book_number IS NOT NULL AND chapter_number IS NOT NULL GROUP BY ALL)) WHERE rank <= 2)
    SELECT * FROM lc UNION ALL SELECT * FROM ls UNION ALL SELECT * FROM lb""")
def layered_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks, scenes and chapters for each figure's name, each layer with its own number of results."""
    hits = _bm25(spark, d)
    members = table(spark, d, "scenes").select("scene_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    total = F.round(F.sum("score"), 6).alias("score")
    scenes_hit = rt.rank_hits(hits.join(members, "chunk_id").groupBy("query_id", "scene_id").agg(total), 3, "scene_id")
    places = _chunks(spark, d, "book_number", "chapter_number").select("chunk_id", F.concat(F.col("book_number").cast("string"), F.lit("/"), F.col("chapter_number").cast("string")).alias("chapter")).where("chapter IS NOT NULL")
    chapters_hit = rt.rank_hits(hits.join(places, "chunk_id").groupBy("query_id", "chapter").agg(total), 2, "chapter")
    return rt.layered_top_k({"chunks": (hits, "chunk_id", 5), "scenes": (scenes_hit, "scene_id", 3), "chapters": (chapters_hit, "chapter", 2)})


@query(f"""
    WITH {_DENSE}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS place FROM embeddings), h AS (SELECT DISTINCT query_id, label, place FROM dense JOIN o USING (vec_id))
    SELECT DISTINCT h.query_id, o.label, o.place, o.vec_id FROM h JOIN o ON o.label = h.label AND o.place BETWEEN h.place - 1 AND h.place + 1""")
def expand_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors with those before and after them."""
    from pyspark.sql import Window

    placed = _embeddings(spark, d).select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("place"))
    return rt.expand_neighbours(_dense(spark, d).select("query_id", "vec_id"), placed, ["label"], "place", "vec_id", 1, ["query_id"])


@query(f"WITH {_BM25}, m AS (SELECT DISTINCT scene_id, unnest(chunk_ids) AS chunk_id FROM scenes) SELECT scene_id, count(*) AS hits FROM m JOIN (SELECT DISTINCT chunk_id FROM bm) USING (chunk_id) GROUP BY ALL HAVING count(*) >= 2")
def complete_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with two hits or more."""
    return rt.complete_scenes(_bm25(spark, d), table(spark, d, "scenes"))


@query(f"""
    WITH {_DENSE}, rel AS (SELECT q.vec_id AS query_id, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
    h AS (SELECT query_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM dense JOIN rel USING (query_id, vec_id) GROUP BY ALL)
    SELECT query_id, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(h / 10, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How many of the nearest vectors have the label of the query."""
    e = _embeddings(spark, d)
    relevant = e.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "label").join(e.select("label", "vec_id"), "label")
    return rt.retrieval_metrics(_dense(spark, d), relevant, "vec_id", 10)


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT left_id AS src, right_id AS dst FROM entity_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL), s AS (SELECT src AS node FROM e EXCEPT SELECT dst FROM e),
    r(node, steps) AS (SELECT node, 0 FROM s UNION SELECT dst, steps + 1 FROM r JOIN e ON src = node WHERE steps < 50) SELECT node, min(steps)::INT AS steps FROM r GROUP BY ALL""")
def match_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fewest comparisons that lead to a record from one that is only ever the left side."""
    edges = table(spark, d, "entity_matches").where("left_id IS NOT NULL AND right_id IS NOT NULL").selectExpr("left_id AS src", "right_id AS dst").distinct()
    start = edges.selectExpr("src AS node").distinct().join(edges.selectExpr("dst AS node"), "node", "left_anti")
    return rt.shortest_paths(edges, start)


_THEMES = {"water": ["river", "ferry", "tide", "marsh", "weir"], "craft": ["mill", "bell", "key", "ledger", "rope"]}


@query(f"WITH {CHUNKS}, w AS (SELECT chunk_id, unnest({WORDS.format('text')}) AS word FROM chunk), t AS (SELECT unnest(['river', 'ferry', 'tide', 'marsh', 'weir', 'mill', 'bell', 'key', 'ledger', 'rope']) AS word) SELECT CASE WHEN word IN ('river', 'ferry', 'tide', 'marsh', 'weir') THEN 'water' ELSE 'craft' END AS theme, chunk_id, count(*) AS hits FROM w JOIN t USING (word) GROUP BY ALL")
def theme_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by theme words."""
    return rt.theme_index(_chunks(spark, d, "text"), "chunk_id", _THEMES)


@query(r"""
    SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\b(why|because|cause[ds]?|lead|led)\b') THEN 'causal' WHEN regexp_matches(lower(text), '\b(when|before|after|first|last|until)\b') THEN 'temporal'
        WHEN regexp_matches(lower(text), '\b(between|relationship|with whom|friend|enemy)\b') THEN 'relationship' WHEN regexp_matches(lower(text), '\b(summar\w+|overview|about|theme)\b') THEN 'summary' ELSE 'factual' END AS kind FROM documents""")
def routed(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the kind of question their words suggest."""
    return table(spark, d, "documents").select("doc_id", rt.route_query(F.col("text")).alias("kind"))


@query(f"""
    WITH {CHUNKS}, {NAMED}, c AS (SELECT DISTINCT mention_id AS claim_id, book_num, unnest({WORDS.format("description")}) AS word FROM named), t AS (SELECT DISTINCT book_number AS book_num, unnest({WORDS.format("text")}) AS word, true AS there FROM chunk),
    s AS (SELECT claim_id, count(there) / count(*) AS share FROM c LEFT JOIN t USING (book_num, word) GROUP BY ALL)
    SELECT claim_id, round(share, 6) AS share, share >= 0.6::DOUBLE AS grounded FROM s""")
def grounded(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of entities by the share of their words that the book has."""
    claims = _entities(spark, d).selectExpr("mention_id AS claim_id", "book_num", "description AS claim")
    return rt.grounded(claims, _chunks(spark, d, "book_number", "text").selectExpr("book_number AS book_num", "text"), "book_num")


# --- Formatting, JSON, events -------------------------------------------------------------------------------------------------------------


@query("""
    SELECT l_returnflag, l_linestatus, printf('%.3f', avg(l_quantity)) AS avg_quantity, printf('%d', floor(max(l_extendedprice))::BIGINT) AS max_price, printf('%d (%.1f%%)', count(*), 100.0::DOUBLE * count(*) / sum(count(*)) OVER ()) AS share FROM lineitem GROUP BY ALL""")
def metric_format(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the line items as a report shows them."""
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.count("*").alias("n"))
    percent = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return rows.select("l_returnflag", "l_linestatus", formatting.metric(F.lit("avg_quantity"), F.col("q")).alias("avg_quantity"), formatting.metric(F.lit("max_price"), F.col("p")).alias("max_price"), formatting.metric(F.lit("share"), F.col("n"), percent).alias("share"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT AS repaired FROM events""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Properties of the events, read strictly and from a spoilt form."""
    spoilt = F.concat(F.lit("Here it is:\n"), F.regexp_replace("props", "\\{", "{\"a\": \"x\" "), F.lit(" // done"))
    return table(spark, d, "events").select("event_id", jsonfix.parse_lenient(F.col("props"), "k INT")["k"].alias("k"), jsonfix.parse_lenient(spoilt, "a STRING, k INT")["k"].alias("repaired"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type."""
    return ingest.event_windows(table(spark, d, "events"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS active FROM events")
def active_entity(spark: SparkSession, d: str) -> DataFrame:
    """The purchase each event of a user refers back to."""
    turns = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("entity"))
    return ingest.active_entity(turns, "user_id", "event_id").select("user_id", "event_id", "active")


@query(f"WITH {CHAPTERS} SELECT book_num, chapter_num FROM chapter c WHERE NOT EXISTS (SELECT 1 FROM scenes s WHERE s.book_number = c.book_num AND s.chapter_number = c.chapter_num)")
def pending_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that have no scenes yet."""
    done = table(spark, d, "scenes").selectExpr("book_number AS book_num", "chapter_number AS chapter_num")
    return ingest.pending(_chapters(spark, d), done, BOOK).select(*BOOK)


# --- Profiles -----------------------------------------------------------------------------------------------------------------------------


@query(f"""
    WITH {CHUNKS}, r AS (SELECT book_number, chapter_number, coalesce(token_count, 0) AS n, floor((row_number() OVER (PARTITION BY book_number, chapter_number ORDER BY chunk_id) - 1) / 32)::BIGINT AS b FROM chunk),
    p AS (SELECT book_number, chapter_number, b, count(*) AS texts, sum(n)::BIGINT AS tokens, max(n) AS most FROM r GROUP BY ALL)
    SELECT book_number, chapter_number, b AS batch, texts, tokens, most, round(sum(tokens) OVER w / sum(texts) OVER w, 6) AS running_avg FROM p WINDOW w AS (PARTITION BY book_number, chapter_number ORDER BY b)""")
def token_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the embedding batches of each chapter."""
    return pf.token_accounting(pf.require_fields(_chunks(spark, d, "book_number", "chapter_number", "token_count"), ["chunk_id", "token_count"]), ["book_number", "chapter_number"], "chunk_id")


@query(f"WITH {_HITS} SELECT chunk_id, array_to_string(list_sort(list(DISTINCT n)), '|') AS tags FROM hit GROUP BY ALL")
def chunk_tags(spark: SparkSession, d: str) -> DataFrame:
    """Entities that each chunk mentions."""
    return pf.chunk_tags(_hits(spark, d), "chunk_id", "name").withColumn("tags", F.array_join("tags", "|"))


@query()
def entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Chapters, aliases and closest companions of each entity."""
    named = F.concat_ws("/", F.col("book_num").cast("string"), tx.normalise("name"))
    return pf.entity_profiles(_entities(spark, d).withColumn("entity", named), co_occurrence(spark, d), ["book_num"], "entity")


@query(f"""
    WITH {CHAPTERS}, p AS (SELECT book_num, chapter_num, unnest(paragraphs) AS x, generate_subscripts(paragraphs, 1) - 1 AS i FROM chapter),
    l AS (SELECT *, list_filter(string_split(x, chr(10)), lambda y: trim(y, {BLANK}) <> '') AS lines FROM p WHERE x IS NOT NULL)
    SELECT book_num, chapter_num, i::INT AS position, md5(x) AS paragraph FROM l WHERE NOT (len(lines) >= 3 AND coalesce(list_max(list_transform(lines, lambda y: length(y))), 0) <= 60)""")
def without_songs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that are not verse."""
    return pf.without_songs(ch.paragraph_rows(_chapters(spark, d), BOOK), BOOK).withColumn("paragraph", F.md5("paragraph"))
