"""Queries of the general problems (1, 3 and 6) and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import flatten, schema_drift, snapshot_diff
from lexloom.tables import materialized, table

#: The name under which the newest source file continues the series of source_lines.
NEWEST_FILE = "jawiktionary-20260901.jsonl"


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, sf, "records"), table(spark, sf, "pack_metadata"))


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many headwords were added, removed and changed from each snapshot to the next."""
    return p1_found(spark, sf).groupBy("pack_id", "from_date", "to_date", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def all_files(spark: SparkSession, sf: str) -> DataFrame:
    earlier = table(spark, sf, "source_lines").select("file_name", "source_line_number", "source_json")
    newest = table(spark, sf, "jawiktionary_20260901").select(F.lit(NEWEST_FILE).alias("file_name"), "source_line_number", "source_json")
    return earlier.unionByName(newest)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.changes(schema_drift.drift(all_files(spark, sf)))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every step of the edit scripts, with the types before and after."""
    return schema_drift.drift(all_files(spark, sf)).drop("pair")


def p3_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All records of all files in one typed table with the newest file's names and types."""
    files = all_files(spark, sf)
    found = materialized(schema_drift.schema_nodes(files))
    return schema_drift.unify(files, materialized(schema_drift.drift(files, found=found)), found)


def p3_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Of the unified table: fields that were renamed or came as lists."""
    codes = F.array_join(F.transform("translations", lambda t: F.coalesce(t["lang_code"], F.lit("-"))), "|")
    return p3_unified(spark, sf).select("file_name", "source_line_number", "word", "pos_title", F.array_join("notes", "|").alias("notes"), "etymology_number", codes.alias("codes"))


def p3_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each file come in another type than their column has."""
    files = all_files(spark, sf)
    found = materialized(schema_drift.schema_nodes(files))
    return schema_drift.conversions(files, materialized(schema_drift.drift(files, found=found)), found)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that the automaton routes to the tables of examples with a text, translations with a word and sounds with an audio."""
    routed = flatten.supertype(table(spark, sf, "jawiktionary_20260901"), with_payload=False)
    found = routed.where("(child_kind, subtype) in (('example', 'text'), ('translation', 'word'), ('sound', 'audio')) and (child_kind <> 'example' or sense_pos >= 0)")
    return found.select("source_line_number", "child_kind", "sense_pos", "item_pos")


#: Columns of each kind in the queries below; lists are joined, so that their rows compare.
P6_TEXTS = {"sense": ("note",), "example": ("text", "translation", "english", "roman", "ref"), "translation": ("word", "lang", "lang_code", "code", "note", "sense", "roman"), "sound": ("audio", "ipa", "oga_url", "other")}
P6_LISTS = {"sense": ("glosses", "tags", "raw_tags", "topics", "categories"), "example": (), "translation": ("tags",), "sound": ("tags", "homophones")}


def _p6(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        typed = flatten.subtype(flatten.supertype(table(spark, sf, "jawiktionary_20260901")), kind)
        return typed.select("source_line_number", "sense_pos", "item_pos", "subtype", *P6_TEXTS[kind], *[F.array_join(c, "|").alias(c) for c in P6_LISTS[kind]])

    return query


def _p6_route(kind: str, route: str):
    """The table of one subtype, with all the columns that its own variants have."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return flatten.subtype(flatten.supertype(table(spark, sf, "jawiktionary_20260901")), kind, route=route)

    return query


def p6_variants(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.variants(flatten.supertype(table(spark, sf, "jawiktionary_20260901")))


def p6_subtypes(spark: SparkSession, sf: str) -> DataFrame:
    """How many children each subtype table holds."""
    return p6_variants(spark, sf).groupBy("child_kind", "subtype").agg(F.sum("n").alias("n"))


def p6_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The items of all other nested lists, with their parents' keys."""
    return flatten.nested(flatten.supertype(table(spark, sf, "jawiktionary_20260901")))


def p6_form_of(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.subtype(p6_nested(spark, sf), "sense.form_of").select("source_line_number", "sense_pos", "list_pos", "word")


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_summary": p1_summary,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p3_unified": p3_unified,
        "p3_titles": p3_titles,
        "p3_conversions": p3_conversions,
        "p6_found": p6_found,
        "p6_senses": _p6("sense"),
        "p6_examples": _p6("example"),
        "p6_translations": _p6("translation"),
        "p6_sounds": _p6("sound"),
        "p6_sounds_audio": _p6_route("sound", "audio"),
        "p6_sounds_ipa": _p6_route("sound", "ipa"),
        "p6_variants": p6_variants,
        "p6_subtypes": p6_subtypes,
        "p6_nested": p6_nested,
        "p6_form_of": p6_form_of,
    }


_P1 = """
WITH s AS (SELECT DISTINCT pack_id, pack_revision, substr(kaikki_extraction_date, 1, 10) AS day FROM pack_metadata
           WHERE pack_id IS NOT NULL AND pack_revision IS NOT NULL AND kaikki_extraction_date IS NOT NULL),
d AS (SELECT pack_id, day, lead(day) OVER (PARTITION BY pack_id ORDER BY day) AS next FROM (SELECT DISTINCT pack_id, day FROM s)),
r AS (SELECT DISTINCT s.pack_id, s.day, authored_headword AS w, coalesce(record_sha256, '\\x00'::BLOB) AS h
      FROM records JOIN s USING (pack_revision) WHERE authored_headword IS NOT NULL),
g AS (SELECT pack_id, day, w, string_agg(hex(h), ',' ORDER BY hex(h)) AS hs FROM r GROUP BY ALL),
a AS (SELECT d.pack_id, d.day AS from_date, d.next AS to_date, g.w, g.hs FROM d JOIN g USING (pack_id, day) WHERE d.next IS NOT NULL),
b AS (SELECT d.pack_id, d.day AS from_date, d.next AS to_date, g.w, g.hs FROM d JOIN g ON g.pack_id = d.pack_id AND g.day = d.next),
f AS (SELECT coalesce(a.pack_id, b.pack_id) AS pack_id, coalesce(a.from_date, b.from_date) AS from_date, coalesce(a.to_date, b.to_date) AS to_date,
        coalesce(a.w, b.w) AS authored_headword,
        CASE WHEN a.w IS NULL THEN 'added' WHEN b.w IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
      FROM a FULL JOIN b ON a.pack_id = b.pack_id AND a.from_date = b.from_date AND a.w = b.w
      WHERE a.w IS NULL OR b.w IS NULL OR a.hs <> b.hs)
"""

_P6 = """
WITH l AS (SELECT DISTINCT source_line_number, source_json::JSON AS j FROM jawiktionary_20260901
           WHERE json_valid(source_json) AND json_type(CASE WHEN json_valid(source_json) THEN source_json END) = 'OBJECT'),
s AS (SELECT source_line_number, (u.i - 1)::INT AS sense_pos, json_extract(j, '$.senses[' || (u.i - 1) || ']') AS j
      FROM l, unnest(range(1, coalesce(json_array_length(j, '$.senses'), 0)::BIGINT + 1)) AS u(i)),
h AS (SELECT source_line_number, -1 AS sense_pos, j FROM l UNION ALL SELECT * FROM s),
c AS (SELECT source_line_number, k.kind AS child_kind, sense_pos, (u.i - 1)::INT AS item_pos, json_extract(j, '$.' || k.list || '[' || (u.i - 1) || ']') AS v
      FROM h, (VALUES ('example', 'examples'), ('translation', 'translations'), ('sound', 'sounds')) AS k(kind, list),
           unnest(range(1, coalesce(json_array_length(j, '$.' || k.list), 0)::BIGINT + 1)) AS u(i)
      UNION ALL SELECT source_line_number, 'sense', sense_pos, sense_pos, j FROM s),
r AS (SELECT *, CASE WHEN json_type(v) <> 'OBJECT' THEN 'value' ELSE coalesce((SELECT min_by(k.field, k.place) FROM
        (VALUES ('sense', 'form_of', 'ARRAY', 1), ('sense', 'glosses', 'ARRAY', 2), ('example', 'text', 'VARCHAR', 1), ('example', 'ref', 'VARCHAR', 2), ('translation', 'word', 'VARCHAR', 1),
                ('translation', 'note', 'VARCHAR', 2), ('sound', 'audio', 'VARCHAR', 1), ('sound', 'ipa', 'VARCHAR', 2), ('sound', 'homophones', 'ARRAY', 3)) AS k(kind, field, type, place)
        WHERE k.kind = child_kind AND json_type(v, '$.' || k.field) = k.type AND json_extract_string(v, '$.' || k.field) <> ''), 'other') END AS subtype FROM c)
"""


#: Paths and types by file; a path that ends and one that begins under the same parent are one if most words that both have hold the same values.
_P3_FOUND = """
WITH a AS (SELECT file_name, source_json FROM source_lines UNION ALL SELECT 'jawiktionary-20260901.jsonl', source_json FROM jawiktionary_20260901),
o AS (SELECT file_name, source_json::JSON AS j FROM a WHERE json_valid(source_json) AND json_type(CASE WHEN json_valid(source_json) THEN source_json END) = 'OBJECT'),
f AS (SELECT file_name, row_number() OVER (ORDER BY file_name) AS k FROM (SELECT DISTINCT file_name FROM a)),
t AS (SELECT f.k, json_extract_string(o.j, '$.word') AS word, regexp_replace(substr(x.fullkey, 3), '\\[\\d+\\]', '', 'g') AS path, x.type, x.value
      FROM o JOIN f USING (file_name), json_tree(o.j) AS x WHERE x.fullkey <> '$' AND NOT regexp_matches(x.fullkey, '\\[\\d+\\]$')),
y AS (SELECT k, path, list_sort(list_distinct(list(CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN 'number' ELSE lower(type) END))) AS types FROM t GROUP BY ALL),
p AS (SELECT coalesce(b.k, c.k + 1) AS k, coalesce(b.path, c.path) AS path, c.types AS before, b.types AS after FROM (SELECT * FROM y WHERE k > 1) b FULL JOIN (SELECT * FROM y WHERE k < (SELECT max(k) FROM f)) c ON b.k = c.k + 1 AND b.path = c.path),
e AS (SELECT k, path, regexp_replace(path, '(^|\\.)[^.]*$', '') AS parent FROM p WHERE after IS NULL),
n AS (SELECT k, path, regexp_replace(path, '(^|\\.)[^.]*$', '') AS parent FROM p WHERE before IS NULL),
v AS (SELECT k, path, word, list_sort(list_distinct(list(value::VARCHAR))) AS held FROM t WHERE word IS NOT NULL GROUP BY ALL),
m AS (SELECT e.k, e.path AS old, n.path AS new FROM e JOIN n ON e.k = n.k AND e.parent = n.parent JOIN v a ON a.k = e.k - 1 AND a.path = e.path JOIN v b ON b.k = n.k AND b.path = n.path AND a.word = b.word
      GROUP BY ALL HAVING avg((a.held = b.held)::INT) > 0.5),
r AS (SELECT k, path AS field_path, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'retyped' END AS change_kind, '' AS new_path FROM p
      WHERE before IS DISTINCT FROM after AND NOT EXISTS (SELECT 1 FROM m WHERE m.k = p.k AND (m.old = p.path AND after IS NULL OR m.new = p.path AND before IS NULL))
      UNION ALL SELECT k, old, 'renamed', new FROM m)
SELECT file_name, field_path, change_kind, new_path FROM r JOIN f USING (k)
"""

#: Old names of the fields in older files, as the report of problem 3 has them.
_P3_TITLES = """
WITH a AS (SELECT file_name, source_line_number, source_json FROM source_lines UNION ALL SELECT 'jawiktionary-20260901.jsonl', source_line_number, source_json FROM jawiktionary_20260901),
o AS (SELECT file_name, source_line_number, source_json::JSON AS j FROM a WHERE json_valid(source_json) AND json_type(CASE WHEN json_valid(source_json) THEN source_json END) = 'OBJECT'),
t AS (SELECT *, CASE WHEN file_name < 'jawiktionary-20260401' THEN json_extract(j, '$.pos_heading') ELSE json_extract(j, '$.pos_title') END AS title FROM o)
SELECT file_name, source_line_number, json_extract_string(j, '$.word') AS word,
  CASE WHEN json_type(title) = 'ARRAY' THEN array_to_string(list_transform(json_extract(title, '$[*]'), lambda x: json_extract_string(x, '$')), '、') ELSE json_extract_string(title, '$') END AS pos_title,
  CASE WHEN json_type(j, '$.notes') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.notes[*]'), lambda x: json_extract_string(x, '$')), '|') ELSE json_extract_string(j, '$.notes') END AS notes,
  json_extract_string(j, '$.etymology_number') AS etymology_number,
  CASE WHEN json_type(j, '$.translations') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.translations[*]'), lambda x:
    coalesce(json_extract_string(x, CASE WHEN file_name < 'jawiktionary-20260701' THEN '$.code' ELSE '$.lang_code' END), '-')), '|') END AS codes
FROM t
"""


def _p6_sql(kind: str) -> str:
    joined = [f"array_to_string(list_transform(json_extract(v, '$.{c}[*]'), lambda x: json_extract_string(x, '$')), '|')" for c in P6_LISTS[kind]]
    lists = [f"CASE WHEN json_type(v, '$.{c}') = 'ARRAY' THEN {j} END AS {c}" for c, j in zip(P6_LISTS[kind], joined, strict=True)]
    texts = [f"json_extract_string(v, '$.{c}') AS {c}" for c in P6_TEXTS[kind]]
    return _P6 + f"SELECT source_line_number, sense_pos, item_pos, subtype, {', '.join([*texts, *lists])} FROM r WHERE child_kind = '{kind}'"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT pack_id, from_date, to_date, authored_headword, change_kind FROM f",
        "p1_summary": _P1 + "SELECT pack_id, from_date, to_date, change_kind, count(*) AS n FROM f GROUP BY ALL",
        "p3_found": _P3_FOUND,
        "p3_titles": _P3_TITLES,
        "p6_found": _P6
        + "SELECT source_line_number, child_kind, sense_pos, item_pos FROM r WHERE (child_kind, subtype) IN (('example', 'text'), ('translation', 'word'), ('sound', 'audio')) AND (child_kind <> 'example' OR sense_pos >= 0)",
        "p6_subtypes": _P6 + "SELECT child_kind, subtype, count(*) AS n FROM r GROUP BY ALL",
        "p6_senses": _p6_sql("sense"),
        "p6_examples": _p6_sql("example"),
        "p6_translations": _p6_sql("translation"),
        "p6_sounds": _p6_sql("sound"),
        "p6_form_of": _P6
        + "SELECT source_line_number, sense_pos, (u.i - 1)::INT AS list_pos, json_extract_string(v, '$.form_of[' || (u.i - 1) || '].word') AS word FROM r, unnest(range(1, json_array_length(v, '$.form_of')::BIGINT + 1)) AS u(i) WHERE child_kind = 'sense' AND subtype = 'form_of' AND json_type(v, '$.form_of[' || (u.i - 1) || ']') = 'OBJECT'",
    }
