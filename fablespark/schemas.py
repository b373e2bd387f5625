"""Declared schemas of the record types (DDL); nothing is read with an inferred schema."""

CHAPTER = "book_num INT, chapter_num INT, chapter_title STRING, paragraphs ARRAY<STRING>, paragraph_count INT, char_count INT, paragraph_min_chars INT, paragraph_max_chars INT, paragraph_avg_chars INT"
CHUNK = "source STRING, book_number INT, book_title STRING, chapter_number INT, chapter_title STRING, chapter_type STRING, text STRING, token_count INT, temporal_order INT, chunk_index INT, total_chunks_in_chapter INT, chunk_id STRING"
SCENE = "source STRING, book_number INT, book_title STRING, chapter_number INT, chapter_title STRING, chapter_type STRING, scene_number INT, scene_id STRING, text STRING, chunk_ids ARRAY<STRING>, num_chunks INT, tokens INT, avg_similarity DOUBLE, min_similarity DOUBLE"
MODEL_SCENE = SCENE.replace(", avg_similarity DOUBLE, min_similarity DOUBLE", ", characters INT, detection_method STRING")
RAW_ENTITY = "entity_type STRING, name STRING, description STRING, aliases ARRAY<STRING>"
MERGED_ENTITY = "entity_type STRING, name STRING, description ARRAY<STRING>, aliases ARRAY<STRING>"
CHARACTER = "name STRING, aliases ARRAY<STRING>, race STRING, gender STRING, role STRING, affiliations ARRAY<STRING>, relationships ARRAY<STRUCT<entity: STRING, relationship: STRING>>, traits ARRAY<STRING>"
LOCATION = "name STRING, aliases ARRAY<STRING>, location_type STRING, parent_location STRING, inhabitants ARRAY<STRING>, significance STRING"
OBJECT = "name STRING, aliases ARRAY<STRING>, object_type STRING, owner STRING, properties ARRAY<STRING>, significance STRING"
EVENT = "name STRING, event_type STRING, participants ARRAY<STRING>, location STRING, outcome STRING"
GROUP = "name STRING, group_type STRING, members ARRAY<STRING>, purpose STRING, allegiances ARRAY<STRING>"
CONCEPT = "name STRING, description STRING, related_entities ARRAY<STRING>"
STATISTICS = "total_mentions INT, total_dialogues INT, total_actions INT, chapters_appeared INT, per_chapter ARRAY<STRUCT<chapter_num: INT, mentions: INT, dialogues: INT, actions: INT>>"
STATS_RESPONSE = "chapter_num INT, mentions_by_others INT, dialogues INT, actions INT, justification STRING, new_aliases ARRAY<STRING>"
METRIC = "name STRING, metrics MAP<STRING, DOUBLE>"

#: Entity types, the ones carried from chapter to chapter, and the older eight.
TYPES = ["character", "location", "object", "event", "group", "concept"]
ACCUMULATED_TYPES = ["character", "location", "object", "group", "concept"]
LEGACY_TYPES = [*TYPES, "race", "song"]
PLURAL = {"character": "characters", "location": "locations", "object": "objects", "event": "events", "group": "groups", "concept": "concepts"}
