"""Mentions of entities in texts: joins on terms, counts, indexes, context, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.runtime import cut, list_or_empty


def entity_terms(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term): name and aliases, lower case and stripped, without blanks and repetitions."""
    strings = F.concat(F.array("name"), list_or_empty(F.col("aliases")))
    return entities.select(*keys, F.explode(F.transform(strings, tx.normalise)).alias("term")).where("term <> ''").distinct()


def text_words(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, word): the distinct words of each text, lower case; a word is a run of letters, digits and underscores."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}_]+"), lambda w: w != ""))
    return texts.select(*keys, words.alias("_w")).select(*keys, F.explode("_w").alias("word"))


#: Terms, of some hundred bytes each, that go to every task at most.
BROADCAST_TERMS = 200_000
_NOT_WORD = "[^\\p{L}\\p{N}_]+"
_ONE_WORD = "^[\\p{L}\\p{N}_]+$"


def _joint(before: Column, after: Column, letters: int) -> Column:
    """Key of a place where two pieces of text meet at a space: the last letters of the one and the first of the other."""
    tail = F.when(F.length(before) > letters, F.substring(before, -letters, letters)).otherwise(before)
    return F.concat(F.lit(f"{letters}:"), tail, F.lit(" "), F.substring(after, 1, letters))


def text_postings(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, key, seen) under which texts meet terms: their words, the pairs of pieces on both sides of a space, and their marks."""
    low = F.lower(F.col(text))
    pieces = F.split(low, " ")
    pairs = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces)), lambda a, b: F.concat(a, F.lit(" "), b))
    tagged = lambda parts, tag: F.transform(F.array_distinct(parts), lambda x: F.concat(F.lit(tag), x))
    all_of = F.concat(tagged(F.split(low, _NOT_WORD), "w:"), tagged(pairs, "j:"), tagged(F.split(F.regexp_replace(low, "[\\p{L}\\p{N}_\\s]", ""), ""), "c:"))
    rows = texts.where(F.col(text).isNotNull()).select(*keys, all_of.alias("_all")).select(*keys, F.explode("_all").alias("_x"))
    seen = F.when(F.startswith("_x", F.lit("j:")), F.substring("_x", 3, 2_000_000_000))
    before, after = F.substring_index(seen, " ", 1), F.substring_index(seen, " ", -1)
    both = F.when(seen.isNotNull(), F.array(_joint(before, after, 1), _joint(before, after, 2))).otherwise(F.array("_x"))
    return rows.select(*keys, seen.alias("seen"), F.explode(both).alias("key"))


def term_key(term: Column) -> Column:
    """The key under which a term (lower case, stripped) meets the texts that may mention it.

    A term with a space is a part of a text, so the key is that of its first space: pieces of two letters or more are known by two on
    each side, others by one. Any other term is a whole word or words, so the key is its longest word, or its first character.
    """
    pieces = F.split(term, " ", 3)
    short = (F.length(pieces[0]) < 2) | (F.length(F.get(pieces, 1)) < 2)
    word = F.array_max(F.transform(F.split(term, _NOT_WORD), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    joint = F.when(short, _joint(pieces[0], F.get(pieces, 1), 1)).otherwise(_joint(pieces[0], F.get(pieces, 1), 2))
    return F.when(F.contains(term, F.lit(" ")), joint).when(word != "", F.concat(F.lit("w:"), word)).otherwise(F.concat(F.lit("c:"), F.substring(term, 1, 1)))


def mentioned_terms(texts: DataFrame, text_keys: list[str], terms: DataFrame, on: list[str], text: str = "text") -> DataFrame:
    """(text_keys, on, term) for each text and each term of the same ``on`` keys that it mentions.

    Texts and terms meet in one equi-join on keys that every mention has (``term_key``), so no join pairs every text with every term and
    no text is shuffled with the keys; up to ``BROADCAST_TERMS`` terms are broadcast, more are shuffled. That is all there is to see of words and of terms of two pieces; terms of more pieces or with
    marks are then looked for in the texts of their candidates. ``terms`` has (on, term), lower case and stripped.
    """
    keys = list(dict.fromkeys([*text_keys, *on]))
    asked = terms.select(*on, "term", term_key(F.col("term")).alias("key"), (F.size(F.split("term", " ")) == 2).alias("_two"), F.rlike("term", F.lit(_ONE_WORD)).alias("_one"))
    asked = cut(asked)
    if asked.count() <= BROADCAST_TERMS:  # a checked size: the keys of the texts then need no shuffle
        asked = F.broadcast(asked)
    met = text_postings(texts, keys, text).join(asked, [*on, "key"])
    found = cut(met.where(~F.col("_two") | F.contains("seen", F.col("term"))).select(*keys, "term", (F.col("_one") | F.col("_two")).alias("_sure")).distinct())
    place = texts.select(*keys, F.col(text).alias("_text"))
    looked_for = found.where(~F.col("_sure")).select(*keys, "term").join(place, keys).where(tx.mentions(F.col("_text"), F.col("term")))
    return found.where("_sure").select(*keys, "term").unionByName(looked_for.select(*keys, "term").distinct())


def entities_in_texts(texts: DataFrame, text_keys: list[str], entities: DataFrame, entity_keys: list[str], on: list[str], text: str = "text") -> DataFrame:
    """(text_keys, entity_keys) for each text and each entity it mentions by name or alias."""
    terms = entity_terms(entities, list(dict.fromkeys([*entity_keys, *on])))
    hits = mentioned_terms(texts, text_keys, terms.select(*on, "term").distinct(), on, text)
    return hits.join(terms, [*on, "term"]).select(*dict.fromkeys([*text_keys, *entity_keys])).distinct()


def mention_counts(hits: DataFrame, entity_keys: list[str], chapter: str) -> DataFrame:
    """Texts that mention each entity, in all and by chapter, chapters in order."""
    per = hits.groupBy(*entity_keys, chapter).agg(F.count("*").alias("n"))
    return per.groupBy(*entity_keys).agg(
        F.sum("n").alias("total_mentions"),
        F.count("*").alias("chapters_appeared"),
        F.array_sort(F.collect_list(F.struct(F.col(chapter).alias("chapter_num"), F.col("n").alias("mentions")))).alias("per_chapter"),
    )


def entity_index(entities: DataFrame, keys: list[str], chapter: str = "chapter_num") -> DataFrame:
    """(keys, chapters): chapters of each entity, distinct and in order."""
    return entities.groupBy(*keys).agg(F.array_sort(F.collect_set(chapter)).alias("chapters"))


def first_seen_index(entities: DataFrame, keys: list[str], order: str = "mention_id", chapter: str = "chapter_num") -> DataFrame:
    """(keys, chapters): chapters of each entity, distinct and in the order in which its records first name them."""
    first = entities.groupBy(*keys, chapter).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", chapter))), lambda x: x[chapter]).alias("chapters"))


def presence_matrix(entities: DataFrame, key: list[str], column: str, values: list) -> DataFrame:
    """One row per key and one column per value, X where the key has it and an empty string elsewhere."""
    wide = entities.groupBy(*key).pivot(column, values).agg(F.first(F.lit("X")))
    return wide.select(*key, *[F.coalesce(F.col(f"`{v}`"), F.lit("")).alias(f"c{v}") for v in values])


def co_occurrence(hits: DataFrame, text_keys: list[str], entity: str) -> DataFrame:
    """(entity_a, entity_b, texts) for entities that share a text; a before b.

    The entities of a text are gathered once and paired within the row; a text mentions far fewer entities than there are.
    """
    together = hits.groupBy(*text_keys).agg(F.array_sort(F.collect_set(entity)).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("entity_a"), b.alias("entity_b")))))
    return together.where("size(e) > 1").select(F.explode(pairs).alias("p")).groupBy("p.entity_a", "p.entity_b").agg(F.count("*").alias("texts"))


def context_sections(chapter_entities: DataFrame, chapter_keys: list[str], limit: int | None = 200, alias_limit: int | None = 30, mentioned: DataFrame | None = None) -> DataFrame:
    """(chapter_keys, context): the known entities of each chapter as lines, by type and name.

    ``mentioned`` (chapter_keys, entity_type, name) keeps those that the chapter's text mentions. The limits per type and per entity are
    those of a prompt; None lifts them.
    """
    rows = chapter_entities if mentioned is None else chapter_entities.join(mentioned, [*chapter_keys, "entity_type", "name"], "left_semi")
    aliases = F.array_sort(list_or_empty(F.col("aliases")))
    few = aliases if alias_limit is None else F.slice(aliases, 1, alias_limit)
    line = F.concat(F.lit("- "), F.col("name"), F.when(F.size(few) > 0, F.concat(F.lit(" ("), F.array_join(few, ", "), F.lit(")"))).otherwise(""))
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy(*chapter_keys, "entity_type").orderBy("name"))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= limit)
    lines = rows.select(*chapter_keys, F.struct("entity_type", "name", line.alias("line")).alias("x"))
    return lines.groupBy(*chapter_keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))


def known_counts(entities: DataFrame) -> DataFrame:
    """(book_num, chapter_num, known): how many entities each chapter knows from earlier ones, where there are any.

    A running sum of first appearances, so no chapter is joined with all before it.
    """
    first = entities.groupBy("book_num", "entity_type", "name").agg(F.min("chapter_num").alias("chapter_num"))
    new = first.groupBy("book_num", "chapter_num").agg(F.count("*").alias("new"))
    at = entities.where("chapter_num IS NOT NULL").select("book_num", "chapter_num").distinct().join(new, ["book_num", "chapter_num"], "left")
    before = Window.partitionBy("book_num").orderBy("chapter_num").rowsBetween(Window.unboundedPreceding, -1)
    return at.select("book_num", "chapter_num", F.sum("new").over(before).alias("known")).where("known > 0")


def seen_before(entities: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_num, chapter_num, entity_type, name, aliases): for every chapter, the entities of earlier chapters of its book.

    An entity is visible from the chapter after its first; the aliases are those of the chapters before.
    """
    long = entities.select("book_num", F.col("chapter_num").alias("_seen"), "entity_type", "name", F.explode_outer(list_or_empty(F.col("aliases"))).alias("_alias"))
    first = long.groupBy("book_num", "entity_type", "name", "_alias").agg(F.min("_seen").alias("_seen"))
    at = chapters.select("book_num", "chapter_num").distinct()
    return at.join(first, (at["book_num"] == first["book_num"]) & (first["_seen"] < at["chapter_num"])).groupBy(at["book_num"], "chapter_num", "entity_type", "name").agg(F.array_sort(F.collect_set("_alias")).alias("aliases"))


def first_appearances(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_chapter, appearances, mention_count) of each entity."""
    return entities.groupBy(*keys).agg(F.min("chapter_num").alias("first_chapter"), F.array_sort(F.collect_set("chapter_num")).alias("appearances"), F.count("*").alias("mention_count"))


def alias_index(entities: DataFrame) -> DataFrame:
    """(book_num, alias, name, first_chapter): from which chapter on an alias is known for a name."""
    rows = entities.select("book_num", "chapter_num", "name", F.explode("aliases").alias("alias")).where("length(trim(alias)) > 0 AND name IS NOT NULL")
    return rows.groupBy("book_num", "alias", "name").agg(F.min("chapter_num").alias("first_chapter"))


def up_to(entities: DataFrame, book: int, chapter: int, book_column: str = "book_num", chapter_column: str = "chapter_num") -> DataFrame:
    """Rows that a reader at (book, chapter) may see: earlier books, and this book up to the chapter."""
    return entities.where(F.struct(book_column, chapter_column) <= F.struct(F.lit(book), F.lit(chapter)))


def timeline(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, states): chapter and description of each mention, in order."""
    return entities.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chapter_num", "mention_id", "description"))).alias("states"))
