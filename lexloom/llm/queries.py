"""Queries of the training-data problems (2, 4, 5, 7, 8 and 9) and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.strict_json import items, loads_object
from lexloom.llm import lookalike, mixture, names, packing, residue, terms
from lexloom.tables import materialized, table


def _terms(spark: SparkSession, sf: str, longest: int) -> DataFrame:
    found = materialized(terms.record_terms(table(spark, sf, "jawiktionary_20260901")))
    return terms.marked(terms.gram_counts(found.where("field_name <> ''"), longest), found.where("field_name = ''"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf, 1).where("mark is not null").select("field_name", F.col("gram")[0].alias("term"), "mark")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of every distinct term."""
    return _terms(spark, sf, 1).select("field_name", F.col("gram")[0].alias("term"), "occurrences", "records", "mark")


def p2_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The same for every run of up to three terms of one list."""
    return _terms(spark, sf, 3).select("field_name", F.array_join("gram", "␟").alias("terms"), F.size("gram").alias("n_terms"), "occurrences", "records")


def dictionary_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(text) of word, forms.form and key_utf8; keys that aren't UTF-8 and empty texts are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for line in batch.column(0).to_pylist():
                record = loads_object(line) or {}
                found.update(x for x in [record.get("word"), *(f.get("form") for f in items(record.get("forms")) if isinstance(f, dict))] if isinstance(x, str))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found, key=lambda t: t.encode("utf-8", "surrogatepass")), pa.string())], ["text"])

    written = table(spark, sf, "jawiktionary_20260901").select("source_json").mapInArrow(rows, "text string")
    keys = table(spark, sf, "lookup_keys").select(F.try_validate_utf8(F.col("key_utf8").cast("string")).alias("text"))
    return written.unionByName(keys).where("text <> ''")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_alikes(dictionary_texts(spark, sf))


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every distinct text."""
    return lookalike.canonical(dictionary_texts(spark, sf))


def _recordings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "commons_fixtures").select("recording_id", "author_ordinal", F.col("extmetadata.artist").alias("artist"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.links(table(spark, sf, "authors"), _recordings(spark, sf))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of every distinct spelling in authors and recordings."""
    written = table(spark, sf, "authors").select(F.col("author_text").alias("text"))
    return names.entities(written.union(_recordings(spark, sf).select("artist")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents"))


def p9_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit that is residue, with the reason."""
    return residue.judged(table(spark, sf, "documents"))


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that remain."""
    return residue.without_residue(table(spark, sf, "documents"))


def _capacity(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, "containers").where(F.col("container_name") == name).agg(F.max("capacity_tokens")).first()[0]


def _packed(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return packing.pack(table(spark, sf, "documents"), _capacity(spark, sf, name))

    return query


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every packing: each document is there once and whole, no container overflows, nothing overlaps, only longer texts are cut, few containers are needed."""
    documents, rows = table(spark, sf, "documents"), []
    for name in ("small", "usual", "large"):
        capacity = _capacity(spark, sf, name)
        packed = materialized(_packed(name)(spark, sf))
        pieces = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.count_distinct("piece").alias("distinct"))
        whole = documents.select("doc_id").join(pieces, "doc_id", "left")
        lost = whole.agg(F.count_if(F.col("pieces").isNull() | (F.col("pieces") != F.col("distinct")) | (F.col("tokens") != F.col("end"))).alias("broken"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("cut"), F.count(F.lit(1)).alias("documents"))
        after = F.lead("start").over(Window.partitionBy("container").orderBy("start", "tokens"))
        room = packed.withColumn("next", after).agg(F.count_if((F.col("start") + F.col("tokens") > capacity) | (F.col("start") + F.col("tokens") > F.col("next"))).alias("overlapping"))
        fill = packing.report(packed, capacity).select((F.col("containers") <= F.ceil(F.col("needed") * 1.01) + 1).alias("tight"))
        one = lost.first()
        rows.append((name, one.documents, one.broken, one.cut, room.first().overlapping, fill.first().tight))
    return spark.createDataFrame(rows, "container_name string, documents long, broken long, cut long, overlapping long, tight boolean")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and unused space for each capacity."""
    made = None
    for name in ("small", "usual", "large"):
        capacity = _capacity(spark, sf, name)
        row = packing.report(_packed(name)(spark, sf), capacity).select(F.lit(name).alias("container_name"), F.lit(capacity).alias("capacity_tokens"), "*")
        made = row if made is None else made.unionByName(row)
    return made


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.select(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source really got."""
    return mixture.select(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every mixture: no source beyond its cap, no document of another source, each source within one text of its budget."""
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    selection, report = mixture.select(documents, targets)
    selection = materialized(selection)
    own = documents.select("doc_id", F.col("source").alias("own"))
    worst = selection.join(own, "doc_id").groupBy("source").agg(F.max("repeats").alias("most"), F.count_if(F.col("own") != F.col("source")).alias("foreign"), F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("taken"))
    longest = selection.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("n")).first().n
    checked = report.join(worst, "source", "left")
    # The largest sum up to a budget misses it by less than one text.
    off = (F.col("taken_tokens") > F.col("budget_tokens")) | (F.col("budget_tokens") - F.col("taken_tokens") > longest)
    return checked.select("source", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("over_cap"), F.coalesce("foreign", F.lit(0)).alias("foreign"), off.alias("off_share"), (F.coalesce("taken", F.lit(0)) != F.col("taken_tokens")).alias("off_report"))


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is either kept or found, none both."""
    documents = table(spark, sf, "documents")
    found = materialized(residue.residue(documents))
    kept = residue.without_residue(documents).select("doc_id")
    sides = kept.withColumn("side", F.lit(1)).unionByName(found.withColumn("side", F.lit(2))).groupBy("doc_id").agg(F.sum("side").alias("sides"))
    return sides.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("sides") > 2).alias("wrong"))


def p4_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct text has one form, and a form is its own form."""
    forms = materialized(p4_forms(spark, sf))
    again = lookalike.canonical(forms.select(F.col("form").alias("text")))
    unstable = again.agg(F.count_if(F.col("form") != F.col("text")).alias("n")).first().n
    return forms.agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("text").alias("distinct_texts"), F.lit(unstable).alias("unstable"))


def queries() -> dict:
    return {"p4_check": p4_check, "p7_check": p7_check, "p8_check": p8_check, "p9_check": p9_check, "p7_packed": _packed("usual"), "p7_packed_small": _packed("small"), "p7_packed_large": _packed("large"), "p7_report": p7_report, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found, "p9_units": p9_units, "p9_kept": p9_kept, "p5_found": p5_found, "p5_entities": p5_entities, "p2_found": p2_found, "p2_terms": p2_terms, "p2_sequences": p2_sequences, "p4_found": p4_found, "p4_forms": p4_forms}


_P2 = """
WITH l AS (SELECT DISTINCT source_line_number AS n, source_json::JSON AS j FROM jawiktionary_20260901
           WHERE json_valid(source_json) AND json_type(CASE WHEN json_valid(source_json) THEN source_json END) = 'OBJECT'),
s AS (SELECT n, unnest(json_extract(j, '$.senses[*]')) AS j FROM l),
t AS (SELECT 'categories' AS field_name, n, unnest(json_extract(j, '$.categories[*]')) AS v FROM l
      UNION ALL SELECT 'senses.tags', n, unnest(json_extract(j, '$.tags[*]')) FROM s
      UNION ALL SELECT 'senses.topics', n, unnest(json_extract(j, '$.topics[*]')) FROM s),
c AS (SELECT field_name, json_extract_string(v, '$') AS term, count(*) AS occurrences, count(DISTINCT n) AS records FROM t WHERE json_type(v) = 'VARCHAR' GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > (SELECT count(DISTINCT n) FROM l) * 0.25 THEN 'common' END AS mark FROM c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
        "p2_sequences": _P2.rstrip() + """,
x AS (SELECT 'categories' AS field_name, n, json_extract(j, '$.categories[*]') AS v FROM l UNION ALL SELECT 'senses.tags', n, json_extract(j, '$.tags[*]') FROM s UNION ALL SELECT 'senses.topics', n, json_extract(j, '$.topics[*]') FROM s),
y AS (SELECT field_name, n, list_transform(list_filter(v, lambda i: json_type(i) = 'VARCHAR'), lambda i: json_extract_string(i, '$')) AS v FROM x),
g AS (SELECT field_name, n, k, array_to_string(v[i:i + k - 1], '␟') AS terms FROM y, range(1, 4) AS a(k), unnest(range(1, len(v) - k + 2)) AS u(i))
SELECT field_name, terms, k::INT AS n_terms, count(*) AS occurrences, count(DISTINCT n) AS records FROM g GROUP BY ALL""",
        "p4_check": """WITH j AS (SELECT DISTINCT source_json::JSON AS j FROM jawiktionary_20260901 WHERE json_valid(source_json) AND json_type(CASE WHEN json_valid(source_json) THEN source_json END) = 'OBJECT'),
t AS (SELECT json_extract(j, '$.word') AS v FROM j UNION ALL SELECT unnest(json_extract(j, '$.forms[*].form')) FROM j),
d AS (SELECT json_extract_string(v, '$') AS x FROM t WHERE json_type(v) = 'VARCHAR' UNION SELECT decode(key_utf8) FROM lookup_keys WHERE key_utf8 IS NOT NULL)
SELECT count(DISTINCT x) AS texts, count(DISTINCT x) AS distinct_texts, 0::BIGINT AS unstable FROM d WHERE x <> ''""",
        "p7_check": "SELECT container_name, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS broken, 0::BIGINT AS cut, 0::BIGINT AS overlapping, true AS tight FROM containers",
        "p8_check": "SELECT DISTINCT source, false AS over_cap, 0::BIGINT AS \"foreign\", false AS off_share, false AS off_report FROM mix_targets",
        "p9_check": "SELECT count(*) AS documents, 0::BIGINT AS wrong FROM documents",
        "p2_terms": _P2 + "SELECT field_name, term, occurrences, records, mark FROM m",
    }
