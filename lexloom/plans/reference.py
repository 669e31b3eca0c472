"""Queries of the dictionary operators over the domain's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import digest, text
from lexloom.functions.unicode import bounded
from lexloom.operators import audio, keys, lookup, order, pack, project
from lexloom.sources import jsonl
from lexloom.tables import broadcast_if_small, materialized, table

LANGUAGE, TARGETS, SHARD_BYTES, CHUNKS, SHARDS, TEXT_BYTES = "ja", (None, "en", "fr"), 262_144, 8, 4, 64


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.from_table(table(spark, sf, "jawiktionary_20260901"), "source_line_number", "source_byte_offset", "source_json")


def examined(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.select(lines(spark, sf), LANGUAGE)


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """(line_number, source_json) of the selected records."""
    return examined(spark, sf).where("error is null").select("line_number", F.col("source_bytes").cast("string").alias("source_json"))


def newest_revision(spark: SparkSession, sf: str) -> str:
    packs = table(spark, sf, "pack_metadata").where("pack_id = 'ja-lexicon'")
    return packs.agg(F.max_by("pack_revision", F.struct("kaikki_extraction_date", "pack_revision"))).first()[0]


def newest_records(spark: SparkSession, sf: str) -> DataFrame:
    """The newest snapshot's records, each once."""
    return table(spark, sf, "records").where(F.col("pack_revision") == newest_revision(spark, sf)).drop("delivered_at").distinct()


def r_selected_records(spark: SparkSession, sf: str) -> DataFrame:
    good = examined(spark, sf).where("error is null")
    return order.prefix_sum(good, [], "line_number", F.lit(1).cast("long"), "selected_ordinal").select(
        "selected_ordinal", "line_number", "byte_offset", "word", F.size("routing_forms").alias("n_forms"), F.sha2("source_bytes", 256).alias("record_sha256"), F.octet_length("source_bytes").alias("n_bytes")
    )


def r_source_errors(spark: SparkSession, sf: str) -> DataFrame:
    return examined(spark, sf).where("error is not null").select("line_number", "byte_offset", "error")


def r_source_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return order.prefix_sum(lines(spark, sf), [], "line_number", F.octet_length("source_bytes").cast("long") + 1, "running_offset").select("line_number", "running_offset")


def expected_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The index that the newest snapshot should have."""
    records = examined(spark, sf).where("error is null").select(F.col("line_number").alias("source_line_number"), "word", "routing_forms")
    ordinals = newest_records(spark, sf).select("source_line_number", "selected_ordinal").distinct()
    return keys.key_table(records.join(ordinals, "source_line_number"))


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "lookup_keys").select("match_class", F.try_validate_utf8(F.col("key_utf8").cast("string")).alias("key"), "selected_ordinal", "authored_key_ordinal")
    return stored.where("key is not null")


def stored_keys(spark: SparkSession, sf: str) -> DataFrame:
    return stored_rows(spark, sf).distinct()


def r_lookup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return expected_keys(spark, sf)


def r_key_differences(spark: SparkSession, sf: str) -> DataFrame:
    return keys.differences(expected_keys(spark, sf), stored_keys(spark, sf), ["match_class", "key", "selected_ordinal", "authored_key_ordinal"])


def r_orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.orphans(stored_keys(spark, sf), newest_records(spark, sf), "selected_ordinal")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("headword").alias("query")).where("query is not null").distinct()


def r_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.lookup(asked(spark, sf), stored_rows(spark, sf))


def r_lookup_records(spark: SparkSession, sf: str) -> DataFrame:
    facts = newest_records(spark, sf).select("selected_ordinal", "authored_headword", "source_line_number").distinct()
    return lookup.with_records(r_lookup(spark, sf), facts).select("query", "match_class", "rank", "selected_ordinal", "authored_headword", "source_line_number")


def r_view_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What each view answers to each query: one monolingual and two bilingual views."""
    v = F.try_parse_json("source_json")
    parsed = objects(spark, sf).select("line_number", v.alias("v"))
    own = lambda t: F.size(project.in_language(project.listed(F.col("v"), "$.translations"), t))
    senses = lambda t: F.aggregate(project.listed(F.col("v"), "$.senses"), F.lit(0), lambda n, s: n + F.size(project.in_language(project.listed(s, "$.translations"), t)))
    counts = parsed.select(F.col("line_number").alias("source_line_number"), *[(own(t) + senses(t)).alias(f"n_{t}") for t in TARGETS if t])
    hits = r_lookup_records(spark, sf).join(counts, "source_line_number", "left")
    by = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_matches"), *[F.coalesce(F.sum(f"n_{t}"), F.lit(0)).alias(f"n_{t}") for t in TARGETS if t])
    wide = asked(spark, sf).join(by, "query", "left")
    n = F.coalesce("n_matches", F.lit(0))
    views = [F.struct(F.lit(f"view-{t or 'own'}").alias("view_id"), lookup.outcome(F.col("query") != "", F.lit(False), n, F.coalesce(f"n_{t}", F.lit(0)) if t else F.lit(0), F.lit(t).cast("string")).alias("outcome")) for t in TARGETS]
    return wide.select("query", F.explode(F.array(*views)).alias("x")).select("query", "x.view_id", "x.outcome")


def r_view_order(spark: SparkSession, sf: str) -> DataFrame:
    views = table(spark, sf, "pack_metadata").select(F.col("corpus_language").alias("language")).distinct()
    views = views.select("language", (F.ascii("language") * 256 + F.ascii(F.substring("language", 2, 1))).alias("view_pos"))
    return lookup.view_order(views, "JA_jp").select("language", "place")


def r_snapshot_revision(spark: SparkSession, sf: str) -> DataFrame:
    """The revision of the newest packs' views, in order of their ids."""
    newest = table(spark, sf, "pack_metadata").groupBy("pack_id").agg(F.max_by("pack_revision", F.struct("kaikki_extraction_date", "pack_revision")).alias("pack_revision"))
    views = newest.agg(F.array_sort(F.collect_list(F.struct(F.col("pack_id").alias("view_id"), "pack_id", "pack_revision", F.lit(None).cast("string").alias("target_language")))).alias("views"))
    return views.select(digest.snapshot_revision(F.col("views")).alias("revision"), F.size("views").alias("n_views"))


def r_record_digests(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("line_number", F.sha2("source_bytes", 256).alias("sha256"), F.octet_length("source_bytes").alias("n_bytes"))


def r_entry_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "records").select("pack_revision", "selected_ordinal", "source_line_number", "record_sha256").distinct()
    return rows.select("pack_revision", "selected_ordinal", digest.entry_id(F.col("pack_revision"), F.col("source_line_number"), F.col("record_sha256")).alias("derived_id"))


def distinct_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "records").drop("delivered_at").distinct()


def r_stream_digests(spark: SparkSession, sf: str) -> DataFrame:
    """One digest per snapshot over its records in order; the record's digest stands for its bytes."""
    frame = pack.framed_record(F.col("selected_ordinal"), F.col("source_line_number"), F.col("source_byte_offset"), F.col("record_sha256"))
    return order.stream_digests(distinct_records(spark, sf), ["pack_revision"], "selected_ordinal", digest.SELECTED_STREAM, frame)


def r_greedy_shards(spark: SparkSession, sf: str) -> DataFrame:
    return order.greedy_shards(distinct_records(spark, sf), "pack_revision", "selected_ordinal", "compressed_size_bytes", SHARD_BYTES)


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    languages = table(spark, sf, "pack_metadata").select("pack_revision", "corpus_language").distinct()
    return distinct_records(spark, sf).join(broadcast_if_small(languages), "pack_revision")


def r_shard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return pack.shard_stats(_languages(spark, sf), ["pack_revision", "shard_ordinal"], F.col("corpus_language"))


def r_shard_routes(spark: SparkSession, sf: str) -> DataFrame:
    routes = pack.shard_routes(r_shard_stats(spark, sf), ["pack_revision"], "shard_ordinal")
    return routes.select("pack_revision", "shard_ordinal", "first_ordinal", "last_ordinal", "expected_first", "contiguous")


def r_pack_totals(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_records(spark, sf).groupBy("pack_revision").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("uncompressed_size_bytes").alias("uncompressed_bytes"), F.sum("compressed_size_bytes").alias("compressed_bytes"), F.count_distinct("authored_headword").alias("n_headwords")
    )


def r_pack_predicates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "pack_metadata").select(
        "pack_id", "pack_revision", text.is_pack_id(c("pack_id")).alias("good_id"), text.is_hex_digest(c("pack_revision")).alias("good_revision"), text.is_iso_date_prefix(c("kaikki_extraction_date")).alias("good_date"),
        (c("kaikki_extraction_date") >= c("wiktionary_dump_date")).alias("in_order"), text.is_absolute_url(c("source_url")).alias("good_url"), (F.octet_length("compressed_source_sha256") == 32).alias("good_digest"),
        F.datediff(F.to_date(F.substring("kaikki_extraction_date", 1, 10)), F.to_date(F.substring("wiktionary_dump_date", 1, 10))).alias("age_days"),
    ).distinct()


def r_identity_errors(spark: SparkSession, sf: str) -> DataFrame:
    return pack.identity_errors(table(spark, sf, "pack_metadata"))


def r_pack_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions derived from the metadata; missing parts count as empty, the source manifest as absent."""
    rows = table(spark, sf, "pack_metadata").distinct()
    columns = {c: F.coalesce(F.col(c), F.lit("")) if t == "string" else F.col(c) for c, t in rows.dtypes} | {"source_manifest": F.lit("")}
    return rows.select("pack_id", "pack_revision", digest.pack_revision(columns, F.col("format_version"), columns["unicode_profile"], F.lit("zstd-6"), F.lit("headword-and-forms")).alias("derived_revision"))


def r_repeated_packs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pack_metadata").groupBy("pack_id", "pack_revision").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "commons_fixtures").select("recording_id", "file_name", "commons_title", "description_url", "original_url", "sha1", "sha256", "uploaded_at", "size_bytes", "mime", "extmetadata.*", "author_ordinal", "fetched_at")


def distinct_recordings(spark: SparkSession, sf: str) -> DataFrame:
    return recordings(spark, sf).drop("fetched_at").distinct()


def r_recordings_authors(spark: SparkSession, sf: str) -> DataFrame:
    return audio.with_authors(distinct_recordings(spark, sf), table(spark, sf, "authors")).select("recording_id", "file_name", "author_ordinal", "author_text")


def r_unknown_authors(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_recordings(spark, sf).where("author_ordinal is not null").select("recording_id", "author_ordinal")
    return keys.orphans(rows, table(spark, sf, "authors"), "author_ordinal")


LICENCE = ["license_short_name", "license", "license_url"]


def r_licence_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return audio.dictionary(recordings(spark, sf), LICENCE, "license_ordinal")


def r_recordings_encoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = distinct_recordings(spark, sf).select("recording_id", *LICENCE).distinct()
    return audio.encoded(rows, audio.dictionary(rows, LICENCE, "license_ordinal"), LICENCE, "license_ordinal")


def r_media_counts(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_recordings(spark, sf).groupBy("mime").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sha256").isNull()).alias("without_digest"), F.sum("size_bytes").alias("bytes"))


def r_chunk_routing(spark: SparkSession, sf: str) -> DataFrame:
    names = recordings(spark, sf).select("file_name").distinct()
    return names.select("file_name", digest.chunk_for(F.col("file_name"), CHUNKS).alias("chunk"), digest.fnv_shard(F.col("file_name"), SHARDS).alias("shard"))


def r_chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    blobs = distinct_recordings(spark, sf).groupBy("file_name", "sha256").agg(F.max("size_bytes").alias("size_bytes"))
    blobs = blobs.withColumn("chunk", digest.chunk_for(F.col("file_name"), CHUNKS)).where("sha256 is not null").groupBy("chunk", "sha256").agg(F.max("size_bytes").alias("size_bytes"))
    return audio.chunk_totals(blobs)


def r_description_urls(spark: SparkSession, sf: str) -> DataFrame:
    titles = recordings(spark, sf).select("file_name").where("file_name is not null").distinct()
    title = text.commons_title(F.col("file_name"))
    return titles.select("file_name", title.alias("title"), text.description_url(title).alias("url"))


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    parsed = objects(spark, sf).select(F.explode(project.listed(F.try_parse_json("source_json"), "$.sounds")).alias("s"))
    return parsed.select(F.try_variant_get("s", "$.audio", "string").alias("audio"))


def r_audio_references(spark: SparkSession, sf: str) -> DataFrame:
    return audio.references(materialized(sounds(spark, sf)))


def r_author_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = recordings(spark, sf).select("artist").where("artist is not null").distinct()
    return rows.select("artist", text.author_from_html(F.col("artist")).alias("a")).select("artist", F.nullif("a.text", F.lit("")).alias("author_text"), F.to_json("a.urls").alias("author_urls_json"))


def _facts(rows: DataFrame) -> dict:
    null = F.lit(None).cast("string")
    return {
        "file_name": F.col("file_name"), "status": F.lit(1), "reason": null, "reference_count": F.col("recording_id"), "source_title": F.col("commons_title"), "source_sha1": F.unhex("sha1"), "source_timestamp": F.col("uploaded_at"),
        "source_media_type": F.col("mime"), "source_size_bytes": F.col("size_bytes"), "description_url": F.col("description_url"), "license_short_name": F.col("license_short_name"), "license_identifier": F.col("license"),
        "license_url": F.col("license_url"), "author_text": F.col("author_text"), "author_urls": F.from_json("author_urls_json", "array<string>"), "attribution_required": F.col("attribution_required").try_cast("boolean"),
    }


def credited(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings with their authors' texts and links."""
    return audio.with_authors(distinct_recordings(spark, sf), table(spark, sf, "authors"))


def r_facts_digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = credited(spark, sf)
    return rows.select("recording_id", F.sha2(digest.recording_facts(_facts(rows)), 256).alias("facts_sha256"))


def r_input_digests(spark: SparkSession, sf: str) -> DataFrame:
    """One digest per chunk over the facts of its recordings, in the order of their names."""
    rows = audio.latest(credited(spark, sf).where("file_name is not null").withColumn("chunk", digest.chunk_for(F.col("file_name"), CHUNKS)), "file_name", "recording_id")
    return audio.input_digest(rows, _facts(rows), "chunk")


def r_compact_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and page addresses only where they aren't derived from the name, and restored again."""
    rows = distinct_recordings(spark, sf).select("recording_id", "file_name", F.col("commons_title").alias("source_title"), "description_url", F.col("sha1").alias("source_sha1"))
    small = audio.compact(rows)
    return audio.restored(small).select("recording_id", "source_title", F.col("description_url").alias("restored_url"))


def r_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a hundred names: the feature is the limit."""
    names = recordings(spark, sf).select("file_name").where("file_name is not null").distinct()
    cursor = names.orderBy("file_name").limit(100).agg(F.max("file_name")).first()[0]
    return names.where(F.col("file_name") > F.lit(cursor)).orderBy("file_name").limit(100)


def r_bounded_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", bounded(F.col("text"), TEXT_BYTES).alias("b")).select("doc_id", F.col("b.value").alias("value"), F.col("b.truncated").alias("truncated"))


def r_translation_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The second to fourth English translation of each record, and how many there are."""
    own = project.in_language(project.listed(F.try_parse_json("source_json"), "$.translations"), "en")
    rows = objects(spark, sf).select("line_number", project.window(own, 1, 3).alias("w"))
    return rows.select("line_number", F.col("w.total").alias("total"), F.array_join(F.transform("w.items", lambda t: F.coalesce(F.try_variant_get(t, "$.word", "string"), F.lit("∅"))), "|").alias("words"))


def r_translation_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = objects(spark, sf).select("line_number", F.try_parse_json("source_json").alias("v"))
    senses = lambda t: F.aggregate(project.listed(F.col("v"), "$.senses"), F.lit(0), lambda n, s: n + F.size(project.in_language(project.listed(s, "$.translations"), t)))
    return rows.select(
        "line_number", F.size(project.listed(F.col("v"), "$.translations")).alias("own_all"), F.size(project.in_language(project.listed(F.col("v"), "$.translations"), "en")).alias("own_en"), senses(None).alias("senses_all"), senses("en").alias("senses_en")
    )


def r_relation_groups(spark: SparkSession, sf: str) -> DataFrame:
    v = objects(spark, sf).select("line_number", F.try_parse_json("source_json").alias("v"))
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(project.listed(F.col("v"), f"$.{project.RELATION_FIELDS.get(k, k)}")).alias("total")) for k in project.RELATIONS])
    return v.select("line_number", F.explode(F.filter(groups, lambda g: g["total"] > 0)).alias("g")).select("line_number", "g.kind", "g.total")


def r_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of each record in depth-first order."""
    pages = project.entries(objects(spark, sf), "source_json", project.with_bounds(project.SUMMARY, descendants=project.UNBOUNDED))
    return pages.select("line_number", F.posexplode("entry.descendants.items").alias("position", "d")).select("line_number", "position", "d.depth", "d.word", F.col("d.language_code").alias("language_code"))


def r_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every record projected within the detail bounds: what it holds, or why it can't be read."""
    made = project.entries(objects(spark, sf), "source_json", project.DETAIL)
    e = "entry."
    return made.select(
        "line_number", f"{e}headword", f"{e}part_of_speech", f"{e}etymology_number", F.col(f"{e}senses.total").alias("n_senses"), F.col(f"{e}forms.total").alias("n_forms"), F.col(f"{e}pronunciations.total").alias("n_pronunciations"),
        F.col(f"{e}translations.total").alias("n_translations"), f"{e}sense_translation_total", F.size(f"{e}relations").alias("n_relation_kinds"), f"{e}truncated", "error",
    )


NAMES = [
    r_lookup, r_lookup_keys, r_key_differences, r_orphan_keys, r_lookup_records, r_view_outcomes, r_view_order, r_snapshot_revision, r_selected_records, r_source_errors, r_source_offsets, r_record_digests, r_entry_ids,
    r_stream_digests, r_greedy_shards, r_shard_stats, r_shard_routes, r_pack_totals, r_pack_predicates, r_identity_errors, r_pack_revisions, r_repeated_packs, r_recordings_authors, r_unknown_authors, r_licence_dictionary,
    r_recordings_encoded, r_media_counts, r_chunk_routing, r_chunk_totals, r_description_urls, r_audio_references, r_author_texts, r_facts_digests, r_input_digests, r_compact_facts, r_keyset_page, r_bounded_texts,
    r_translation_windows, r_translation_totals, r_relation_groups, r_descendants, r_entries,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


# Oracles.


def _u64(x: str) -> str:
    return f"unhex(lpad(printf('%X', ({x})::BIGINT), 16, '0'))"


def _f(x: str, blob: bool = False) -> str:
    b = x if blob else f"encode({x})"
    return f"({_u64(f'octet_length({b})')} || {b})"


def _opt(x: str, blob: bool = False) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN unhex('00') ELSE unhex('01') || {_f(x, blob)} END)"


_LINES = """l0 AS (SELECT source_line_number AS line_number, min(source_byte_offset) AS byte_offset, min(source_json) AS source_json FROM jawiktionary_20260901 GROUP BY 1),
j AS (SELECT *, source_json::JSON AS j FROM l0 WHERE json_valid(source_json) AND json_type(CASE WHEN json_valid(source_json) THEN source_json END) = 'OBJECT'),
jx AS (SELECT *, list_position(list_transform(coalesce(json_extract(j, '$.forms[*]'), []), lambda x: json_extract(x, '$.form') IS NULL), true) AS bad FROM j WHERE json_extract_string(j, '$.lang_code') = 'ja'),
ja AS (SELECT * EXCLUDE (bad) FROM jx WHERE coalesce(bad, 0) = 0)"""
_NEWEST = """newest AS (SELECT arg_max(pack_revision, kaikki_extraction_date || pack_revision) AS r FROM pack_metadata WHERE pack_id = 'ja-lexicon'),
recs AS (SELECT DISTINCT * EXCLUDE (delivered_at) FROM records WHERE pack_revision = (SELECT r FROM newest))"""
_FOLD = "nfc_normalize(replace(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ς', 'σ'), 'և', 'եւ'))"
_STORED = "stored AS (SELECT DISTINCT match_class, decode(key_utf8) AS key, selected_ordinal, authored_key_ordinal FROM lookup_keys WHERE key_utf8 IS NOT NULL)"
_EXPECTED = f"""src AS (SELECT r.selected_ordinal, json_extract_string(j, '$.word') AS w, j FROM ja JOIN (SELECT DISTINCT source_line_number, selected_ordinal FROM recs) r ON r.source_line_number = ja.line_number),
fm AS (SELECT selected_ordinal, unnest(list_filter(json_extract_string(j, '$.forms[*].form'), lambda x: x <> '' AND x <> '-')) AS w,
       unnest(range(len(list_filter(json_extract_string(j, '$.forms[*].form'), lambda x: x <> '' AND x <> '-')))) AS i FROM src),
tx AS (SELECT selected_ordinal, 0 AS base, 0 AS i, w FROM src UNION ALL SELECT selected_ordinal, 3, i, w FROM fm),
ks AS (SELECT base + 1 AS match_class, w AS key, selected_ordinal, i FROM tx UNION ALL SELECT base + 2, nfc_normalize(w), selected_ordinal, i FROM tx UNION ALL SELECT base + 3, {_FOLD.format("w")}, selected_ordinal, i FROM tx),
expected AS (SELECT match_class::INT AS match_class, key, selected_ordinal, min(i)::INT AS authored_key_ordinal FROM ks GROUP BY ALL)"""
_HITS = f"""q AS (SELECT DISTINCT headword AS query FROM documents WHERE headword IS NOT NULL AND headword <> ''),
st AS (SELECT query, c AS match_class, CASE (c - 1) % 3 WHEN 0 THEN query WHEN 1 THEN nfc_normalize(query) ELSE {_FOLD.format("query")} END AS key FROM q, range(1, 7) AS t(c)),
h0 AS (SELECT DISTINCT st.query, st.match_class, s.selected_ordinal FROM st JOIN stored s USING (match_class, key)),
h1 AS (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY match_class) AS d FROM h0),
h2 AS (SELECT query, match_class, selected_ordinal, row_number() OVER (PARTITION BY query ORDER BY selected_ordinal) AS rank, count(*) OVER (PARTITION BY query) > 20 AS truncated FROM h1 WHERE d = 1),
hits AS (SELECT query, match_class::INT AS match_class, selected_ordinal, rank::INT AS rank, truncated FROM h2 WHERE rank <= 20)"""
_DREC = "d AS (SELECT DISTINCT * EXCLUDE (delivered_at) FROM records)"
_REC = "c AS (SELECT DISTINCT * FROM (SELECT recording_id, file_name, commons_title, description_url, original_url, sha1, sha256, uploaded_at, size_bytes, mime, unnest(extmetadata), author_ordinal FROM commons_fixtures))"
_CREDITED = f"""{_REC}, au AS (SELECT author_ordinal, max(author_text) AS author_text, max(author_urls_json) AS author_urls_json FROM authors GROUP BY 1),
cr AS (SELECT c.*, author_text, coalesce(json_extract_string(author_urls_json, '$[*]'), []) AS urls FROM c LEFT JOIN au USING (author_ordinal))"""
_FACTS = " || ".join(
    [
        _f("file_name"), _f("unhex('01')", True), _opt("NULL::VARCHAR"), _f(_u64("recording_id"), True), _opt("commons_title"), _opt("unhex(sha1)", True), _opt("uploaded_at"), _opt("mime"), _opt(f"CASE WHEN size_bytes IS NOT NULL THEN {_u64('size_bytes')} END", True),
        _opt("description_url"), f"(CASE WHEN license_short_name IS NULL THEN unhex('00') ELSE {_opt('license_short_name')} || {_opt('license')} || {_opt('license_url')} END)", _opt("author_text"), _f(_u64("len(urls)"), True), f"unhex(coalesce(array_to_string(list_transform(urls, lambda u: hex({_f('u')})), ''), ''))",
        _opt("CASE lower(attribution_required) WHEN 'true' THEN unhex('01') WHEN 'false' THEN unhex('00') END", True),
    ]
)
_URL = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode({0}), '%20', '_'), '%3B', ';'), '%3A', ':'), '%40', '@'), '%24', '$'), '%21', '!'), '%28', '('), '%29', ')'), '%2C', ','), '%2F', '/'), '%7E', '~'), '%2A', '*')"


def oracle_sql() -> dict[str, str]:
    stream = f"string_agg(hex({_f(_u64('selected_ordinal'), True)} || {_f(_u64('source_line_number'), True)} || {_f(_u64('source_byte_offset'), True)} || {_f('record_sha256', True)}), '' ORDER BY selected_ordinal)"
    revision = " || ".join(
        [_f("'ELDICT-PACK-REVISION-V1'"), _f("unhex(lpad(printf('%X', format_version), 8, '0'))", True)]
        + [_f(f"coalesce({c}, '')") for c in ("pack_id", "corpus_language", "wiktionary_edition", "wiktionary_dump_date", "kaikki_extraction_date", "source_url")]
        + [_f(c, True) for c in ("compressed_source_sha256", "uncompressed_source_sha256")]
        + [_f(f"coalesce({c}, '')") for c in ("wiktextract_revision", "wikitextprocessor_revision", "builder_revision", "unicode_profile")]
        + [_f("'zstd-6'"), _f("'headword-and-forms'"), _f(_u64("target_shard_payload_bytes"), True), _f("unhex(sha256(''))", True), _f("unhex(sha256(coalesce(license_manifest_json, '')))", True), _f("''"), _f("coalesce(minimum_app_version, '')")]
    )
    views = f"string_agg(hex({_f('pack_id')} || {_f('pack_id')} || {_f('unhex(pack_revision)', True)} || {_f(chr(39) + 'monolingual' + chr(39))} || {_f(chr(39) * 2)}), '' ORDER BY pack_id)"
    relations = " UNION ALL ".join(f"SELECT line_number, '{k}' AS kind, json_array_length(j, '$.{project.RELATION_FIELDS.get(k, k)}')::INT AS total FROM ja" for k in project.RELATIONS)
    trans = "tr AS (SELECT line_number, t FROM (SELECT line_number, unnest(json_extract(j, '$.translations[*]')) AS t FROM ja)), st AS (SELECT line_number, unnest(json_extract(s, '$.translations[*]')) AS t FROM (SELECT line_number, unnest(json_extract(j, '$.senses[*]')) AS s FROM ja))"
    code = "coalesce(json_extract_string(t, '$.lang_code'), json_extract_string(t, '$.code'))"
    outcome = "SELECT query, 'view-' || coalesce(t, 'own') AS view_id, CASE WHEN n_matches = 0 THEN 'NoEntry' WHEN t IS NOT NULL AND n = 0 THEN 'NoTranslation' ELSE 'Completed' END AS outcome FROM"
    return {
        "r_lookup": f"WITH {_STORED}, {_HITS} SELECT * FROM hits",
        "r_lookup_keys": f"WITH {_LINES}, {_NEWEST}, {_EXPECTED} SELECT * FROM expected",
        "r_key_differences": f"WITH {_LINES}, {_NEWEST}, {_EXPECTED}, {_STORED} SELECT *, 'missing' AS side, 1::BIGINT AS n_rows FROM (FROM expected EXCEPT ALL FROM stored) UNION ALL SELECT *, 'surplus', 1 FROM (FROM stored EXCEPT ALL FROM expected)",
        "r_orphan_keys": f"WITH {_NEWEST}, {_STORED} SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.selected_ordinal = s.selected_ordinal)",
        "r_lookup_records": f"WITH {_STORED}, {_HITS}, {_NEWEST} SELECT query, match_class, rank, selected_ordinal, authored_headword, source_line_number FROM hits LEFT JOIN (SELECT DISTINCT selected_ordinal, authored_headword, source_line_number FROM recs) USING (selected_ordinal)",
        "r_view_outcomes": f"""WITH {_LINES}, {_NEWEST}, {_STORED}, {_HITS.replace("st AS", "stg AS").replace("FROM st JOIN", "FROM stg st JOIN")}, {trans},
            tc AS (SELECT line_number, {code} AS c FROM tr UNION ALL SELECT line_number, {code} FROM st), n AS (SELECT line_number, count(*) FILTER (c = 'en') AS en, count(*) FILTER (c = 'fr') AS fr FROM tc GROUP BY 1),
            m AS (SELECT query, count(*) AS n_matches, sum(en) AS en, sum(fr) AS fr FROM hits LEFT JOIN (SELECT DISTINCT selected_ordinal, source_line_number FROM recs) USING (selected_ordinal) LEFT JOIN n ON n.line_number = source_line_number GROUP BY 1),
            w AS (SELECT a.query, coalesce(n_matches, 0) AS n_matches, coalesce(en, 0) AS en, coalesce(fr, 0) AS fr FROM (SELECT DISTINCT headword AS query FROM documents WHERE headword IS NOT NULL) a LEFT JOIN m USING (query))
            {outcome} (SELECT query, n_matches, NULL AS t, 0 AS n FROM w UNION ALL SELECT query, n_matches, 'en', en FROM w UNION ALL SELECT query, n_matches, 'fr', fr FROM w)""",
        "r_author_texts": """WITH a AS (SELECT DISTINCT extmetadata.artist AS artist FROM commons_fixtures WHERE extmetadata.artist IS NOT NULL),
            x AS (SELECT artist, regexp_replace(artist, '<[^>]*>', '', 'g') AS t, list_distinct(list_filter(list_transform(regexp_extract_all(artist, 'href="([^"]*)"', 1), lambda u: replace(CASE WHEN starts_with(u, '//') THEN 'https:' || u ELSE u END, '&amp;', '&')), lambda u: regexp_matches(u, '^https?://'))) AS urls FROM a)
            SELECT artist, nullif(trim(regexp_replace(replace(replace(replace(t, '&nbsp;', ' '), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS author_text, to_json(urls)::VARCHAR AS author_urls_json FROM x""",
        "r_view_order": "SELECT language, (row_number() OVER (ORDER BY language <> 'ja', language))::INT AS place FROM (SELECT DISTINCT corpus_language AS language FROM pack_metadata)",
        "r_snapshot_revision": f"WITH n AS (SELECT pack_id, arg_max(pack_revision, kaikki_extraction_date || pack_revision) AS pack_revision FROM pack_metadata GROUP BY 1) SELECT sha256({_f(chr(39) + digest.SNAPSHOT + chr(39))} || {_f(_u64('count(*)'), True)} || unhex({views})) AS revision, count(*)::INT AS n_views FROM n",
        "r_selected_records": f"WITH {_LINES} SELECT row_number() OVER (ORDER BY line_number) - 1 AS selected_ordinal, line_number, byte_offset, json_extract_string(j, '$.word') AS word, len(list_filter(coalesce(json_extract_string(j, '$.forms[*].form'), []), lambda x: x <> '' AND x <> '-'))::INT AS n_forms, sha256(source_json) AS record_sha256, strlen(source_json)::INT AS n_bytes FROM ja",
        "r_source_errors": f"WITH {_LINES} SELECT line_number, byte_offset, CASE WHEN source_json = '' THEN 'is empty' WHEN NOT starts_with(ltrim(source_json), '{{' ) THEN 'is not a JSON object' ELSE 'is malformed JSON' END AS error FROM l0 WHERE line_number NOT IN (SELECT line_number FROM j) UNION ALL SELECT line_number, byte_offset, 'has no `forms[' || (bad - 1) || '].form`' FROM jx WHERE bad > 0",
        "r_source_offsets": f"WITH {_LINES} SELECT line_number, coalesce(sum(strlen(source_json) + 1) OVER (ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS running_offset FROM l0",
        "r_record_digests": f"WITH {_LINES} SELECT line_number, sha256(source_json) AS sha256, strlen(source_json)::INT AS n_bytes FROM l0",
        "r_entry_ids": f"SELECT pack_revision, selected_ordinal, sha256({_f(chr(39) + digest.ENTRY_ID + chr(39))} || {_f('unhex(pack_revision)', True)} || {_f(_u64('source_line_number'), True)} || {_f('record_sha256', True)}) AS derived_id FROM (SELECT DISTINCT pack_revision, selected_ordinal, source_line_number, record_sha256 FROM records)",
        "r_stream_digests": f"WITH {_DREC} SELECT pack_revision, sha256({_f(chr(39) + digest.SELECTED_STREAM + chr(39))} || unhex({stream})) AS digest, count(*) AS n_records FROM d GROUP BY 1",
        "r_greedy_shards": f"""WITH RECURSIVE {_DREC}, o AS (SELECT pack_revision, selected_ordinal, compressed_size_bytes AS n, row_number() OVER (PARTITION BY pack_revision ORDER BY selected_ordinal) AS i FROM d),
            g AS (SELECT pack_revision, selected_ordinal, i, n AS used, 0 AS shard FROM o WHERE i = 1 UNION ALL
            SELECT o.pack_revision, o.selected_ordinal, o.i, CASE WHEN g.used + o.n > {SHARD_BYTES} THEN o.n ELSE g.used + o.n END, CASE WHEN g.used + o.n > {SHARD_BYTES} THEN g.shard + 1 ELSE g.shard END FROM g JOIN o ON o.pack_revision = g.pack_revision AND o.i = g.i + 1)
            SELECT pack_revision, selected_ordinal, shard FROM g""",
        "r_shard_stats": f"WITH {_DREC}, p AS (SELECT DISTINCT pack_revision, corpus_language FROM pack_metadata) SELECT pack_revision, shard_ordinal, count(*) AS record_count, min(selected_ordinal) AS first_ordinal, max(selected_ordinal) AS last_ordinal, sum(uncompressed_size_bytes)::BIGINT AS uncompressed_bytes, sum(compressed_size_bytes)::BIGINT AS compressed_bytes, count(*) FILTER (language_code <> corpus_language) AS foreign_records FROM d JOIN p USING (pack_revision) GROUP BY 1, 2",
        "r_shard_routes": f"WITH {_DREC}, s AS (SELECT pack_revision, shard_ordinal, count(*) AS n, min(selected_ordinal) AS first_ordinal, max(selected_ordinal) AS last_ordinal FROM d WHERE pack_revision IN (SELECT pack_revision FROM pack_metadata) GROUP BY 1, 2), e AS (SELECT *, coalesce(lag(last_ordinal) OVER (PARTITION BY pack_revision ORDER BY shard_ordinal) + 1, 0) AS expected_first FROM s) SELECT pack_revision, shard_ordinal, first_ordinal, last_ordinal, expected_first, first_ordinal = expected_first AND last_ordinal - first_ordinal + 1 = n AS contiguous FROM e",
        "r_pack_totals": f"WITH {_DREC} SELECT pack_revision, count(*) AS n_records, sum(uncompressed_size_bytes)::BIGINT AS uncompressed_bytes, sum(compressed_size_bytes)::BIGINT AS compressed_bytes, count(DISTINCT authored_headword) AS n_headwords FROM d GROUP BY 1",
        "r_pack_predicates": "SELECT DISTINCT pack_id, pack_revision, regexp_full_match(pack_id, '[a-z](-?[a-z0-9])*') AND length(pack_id) <= 64 AS good_id, regexp_full_match(pack_revision, '[0-9a-f]{64}') AS good_revision, regexp_matches(kaikki_extraction_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AS good_date, kaikki_extraction_date >= wiktionary_dump_date AS in_order, regexp_matches(source_url, '^https?://') AND strlen(source_url) <= 2048 AS good_url, octet_length(compressed_source_sha256) = 32 AS good_digest, date_diff('day', substr(wiktionary_dump_date, 1, 10)::DATE, substr(kaikki_extraction_date, 1, 10)::DATE)::INT AS age_days FROM pack_metadata",
        "r_pack_revisions": f"SELECT pack_id, pack_revision, sha256({revision}) AS derived_revision FROM (SELECT DISTINCT * FROM pack_metadata)",
        "r_repeated_packs": "SELECT pack_id, pack_revision, count(*) AS n FROM pack_metadata GROUP BY 1, 2 HAVING count(*) > 1",
        "r_recordings_authors": f"WITH {_REC}, a AS (SELECT author_ordinal, max(author_text) AS author_text FROM authors GROUP BY 1) SELECT recording_id, file_name, author_ordinal, author_text FROM c LEFT JOIN a USING (author_ordinal)",
        "r_unknown_authors": f"WITH {_REC} SELECT author_ordinal, recording_id FROM c WHERE author_ordinal IS NOT NULL AND author_ordinal NOT IN (SELECT author_ordinal FROM authors)",
        "r_licence_dictionary": f"WITH {_REC}, k AS (SELECT DISTINCT license_short_name, license, license_url FROM c WHERE coalesce(license_short_name, license, license_url) IS NOT NULL) SELECT *, (row_number() OVER (ORDER BY license_short_name NULLS FIRST, license NULLS FIRST, license_url NULLS FIRST) - 1)::INT AS license_ordinal FROM k",
        "r_recordings_encoded": f"WITH {_REC}, k AS (SELECT DISTINCT license_short_name, license, license_url FROM c WHERE coalesce(license_short_name, license, license_url) IS NOT NULL), o AS (SELECT *, (row_number() OVER (ORDER BY license_short_name NULLS FIRST, license NULLS FIRST, license_url NULLS FIRST) - 1)::INT AS license_ordinal FROM k), r AS (SELECT DISTINCT recording_id, license_short_name, license, license_url FROM c) SELECT recording_id, license_ordinal FROM r LEFT JOIN o ON r.license_short_name IS NOT DISTINCT FROM o.license_short_name AND r.license IS NOT DISTINCT FROM o.license AND r.license_url IS NOT DISTINCT FROM o.license_url",
        "r_media_counts": f"WITH {_REC} SELECT mime, count(*) AS n, count(*) FILTER (sha256 IS NULL) AS without_digest, sum(size_bytes)::BIGINT AS bytes FROM c GROUP BY 1",
        "r_chunk_totals": f"WITH {_REC}, b AS (SELECT ('0x' || substr(sha256(file_name), 1, 16))::UBIGINT % {CHUNKS} AS chunk, sha256, max(size_bytes) AS size_bytes FROM c WHERE sha256 IS NOT NULL GROUP BY 1, 2) SELECT chunk::INT AS chunk, count(*) AS blob_count, sum(size_bytes)::BIGINT AS blob_bytes FROM b GROUP BY 1",
        "r_chunk_routing": f"""WITH RECURSIVE n AS (SELECT DISTINCT file_name, hex(encode(file_name)) AS h FROM commons_fixtures), f AS (SELECT file_name, h, 0 AS i, 14695981039346656037::UBIGINT AS v FROM n UNION ALL
            SELECT file_name, h, i + 1, ((xor(v, ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)::HUGEINT * 435 + ((xor(v, ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)::HUGEINT % 16777216) * 1099511627776)) % 18446744073709551616)::UBIGINT FROM f WHERE 2 * i < length(h))
            SELECT file_name, (('0x' || substr(sha256(file_name), 1, 16))::UBIGINT % {CHUNKS})::INT AS chunk, (v % {SHARDS})::INT + 1 AS shard FROM f WHERE 2 * i = length(h)""",
        "r_description_urls": f"SELECT DISTINCT file_name, 'File:' || file_name AS title, '{text.PAGE}' || {_URL.format(chr(39) + 'File:' + chr(39) + ' || file_name')} AS url FROM commons_fixtures WHERE file_name IS NOT NULL",
        "r_facts_digests": f"WITH {_CREDITED} SELECT recording_id, sha256({_FACTS}) AS facts_sha256 FROM cr",
        "r_entries": f"""WITH {_LINES}, {trans}, n AS (SELECT line_number, count(*) AS n FROM st GROUP BY 1), g AS (SELECT line_number, count(*) AS k FROM ({relations}) WHERE total > 0 GROUP BY 1)
            SELECT ja.line_number, json_extract_string(j, '$.word') AS headword, json_extract_string(j, '$.pos') AS part_of_speech, json_extract_string(j, '$.etymology_number') AS etymology_number,
            coalesce(json_array_length(j, '$.senses'), 0)::BIGINT AS n_senses, coalesce(json_array_length(j, '$.forms'), 0)::BIGINT AS n_forms, coalesce(json_array_length(j, '$.sounds'), 0)::BIGINT AS n_pronunciations,
            coalesce(json_array_length(j, '$.translations'), 0)::BIGINT AS n_translations, coalesce(n.n, 0) AS sense_translation_total, coalesce(g.k, 0)::INT AS n_relation_kinds, false AS truncated, NULL::VARCHAR AS error
            FROM ja LEFT JOIN n USING (line_number) LEFT JOIN g USING (line_number)""",
        "r_identity_errors": """WITH p AS (SELECT DISTINCT * FROM pack_metadata) SELECT pack_id, pack_revision, unnest(list_filter([
            CASE WHEN NOT (regexp_full_match(pack_id, '[a-z](-?[a-z0-9])*') AND length(pack_id) <= 64) THEN 'invalid pack id' END,
            CASE WHEN coalesce(corpus_language, '') = '' THEN 'empty corpus_language' END, CASE WHEN coalesce(wiktionary_edition, '') = '' THEN 'empty wiktionary_edition' END, CASE WHEN coalesce(source_url, '') = '' THEN 'empty source_url' END,
            CASE WHEN coalesce(builder_revision, '') = '' THEN 'empty builder_revision' END, CASE WHEN coalesce(minimum_app_version, '') = '' THEN 'empty minimum_app_version' END,
            CASE WHEN coalesce(wiktextract_revision, '') = '' THEN 'empty wiktextract_revision' END, CASE WHEN coalesce(wikitextprocessor_revision, '') = '' THEN 'empty wikitextprocessor_revision' END,
            CASE WHEN NOT coalesce(regexp_matches(wiktionary_dump_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) THEN 'wiktionary_dump_date is not an ISO date' END,
            CASE WHEN NOT coalesce(regexp_matches(kaikki_extraction_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) THEN 'kaikki_extraction_date is not an ISO date' END,
            CASE WHEN kaikki_extraction_date < wiktionary_dump_date THEN 'extraction predates its dump' END, CASE WHEN NOT regexp_full_match(pack_revision, '[0-9a-f]{64}') THEN 'malformed revision' END,
            CASE WHEN coalesce(octet_length(compressed_source_sha256), 0) <> 32 THEN 'compressed_source_sha256 is not 32 bytes' END, CASE WHEN coalesce(octet_length(uncompressed_source_sha256), 0) <> 32 THEN 'uncompressed_source_sha256 is not 32 bytes' END,
            CASE WHEN coalesce(target_shard_payload_bytes, 0) <= 0 THEN 'target_shard_payload_bytes must be positive' END], lambda x: x IS NOT NULL)) AS error FROM p""",
        "r_input_digests": f"WITH {_CREDITED}, m AS (SELECT *, (('0x' || substr(sha256(file_name), 1, 16))::UBIGINT % {CHUNKS})::INT AS chunk FROM cr WHERE file_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY recording_id DESC) = 1) SELECT chunk, sha256({_f(chr(39) + digest.RECORDING_INPUTS + chr(39))} || unhex(string_agg(hex({_FACTS}), '' ORDER BY encode(file_name)))) AS digest, count(*) AS n_records FROM m GROUP BY 1",
        "r_audio_references": f"""WITH {_LINES}, a AS (SELECT json_extract_string(s, '$.audio') AS a FROM (SELECT unnest(json_extract(j, '$.sounds[*]')) AS s FROM ja) WHERE json_type(json_extract(s, '$.audio')) = 'VARCHAR'),
            b AS (SELECT a, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(a, '%') THEN url_decode(replace(a, '+', '%2B')) ELSE a END, '^[\\s\u3000\u00a0]+', ''), '^(File:)+', ''), '^(file:)+', ''), '_', ' '), '[\\s\u3000\u00a0]+', ' ', 'g')) AS n FROM a),
            p AS (SELECT CASE WHEN n <> '' AND strlen(n) <= 255 AND contains(n, '.') AND NOT regexp_matches(n, '[/\\\\#<>\\[\\]|{{}}[:cntrl:]]') THEN upper(left(n, 1)) || substr(n, 2) END AS file_name, a FROM b)
            SELECT file_name, CASE WHEN file_name IS NULL THEN a END AS authored, count(*) AS n FROM p GROUP BY 1, 2""",
        "r_compact_facts": f"WITH {_REC} SELECT recording_id, CASE WHEN sha1 IS NOT NULL THEN coalesce(commons_title, 'File:' || file_name) WHEN commons_title <> 'File:' || file_name THEN commons_title END AS source_title, CASE WHEN sha1 IS NOT NULL THEN coalesce(description_url, '{text.PAGE}' || {_URL.format('coalesce(commons_title, ' + chr(39) + 'File:' + chr(39) + ' || file_name)')}) WHEN description_url <> '{text.PAGE}' || {_URL.format('coalesce(commons_title, ' + chr(39) + 'File:' + chr(39) + ' || file_name)')} THEN description_url END AS restored_url FROM c",
        "r_keyset_page": "WITH n AS (SELECT DISTINCT file_name FROM commons_fixtures WHERE file_name IS NOT NULL) SELECT file_name FROM n ORDER BY encode(file_name) LIMIT 100 OFFSET 100",
        "r_bounded_texts": f"SELECT doc_id, CASE WHEN strlen(text) <= {TEXT_BYTES} THEN text ELSE list_max(list_filter(list_transform(range(0, {TEXT_BYTES} + 1), lambda n: left(text, n::INT)), lambda p: strlen(p) <= {TEXT_BYTES})) END AS value, strlen(text) > {TEXT_BYTES} AS truncated FROM documents",
        "r_translation_windows": f"WITH {_LINES}, e AS (SELECT line_number, list_filter(coalesce(json_extract(j, '$.translations[*]'), []), lambda t: {code} = 'en') AS t FROM ja) SELECT line_number, len(t)::INT AS total, coalesce(array_to_string(list_transform(t[2:4], lambda x: coalesce(json_extract_string(x, '$.word'), '∅')), '|'), '') AS words FROM e",
        "r_translation_totals": f"WITH {_LINES}, {trans}, a AS (SELECT line_number, count(*) AS n, count(*) FILTER ({code} = 'en') AS en FROM tr GROUP BY 1), b AS (SELECT line_number, count(*) AS n, count(*) FILTER ({code} = 'en') AS en FROM st GROUP BY 1) SELECT ja.line_number, coalesce(a.n, 0)::INT AS own_all, coalesce(a.en, 0)::INT AS own_en, coalesce(b.n, 0)::INT AS senses_all, coalesce(b.en, 0)::INT AS senses_en FROM ja LEFT JOIN a USING (line_number) LEFT JOIN b USING (line_number)",
        "r_relation_groups": f"WITH {_LINES} SELECT * FROM ({relations}) WHERE total > 0",
        "r_descendants": f"""WITH RECURSIVE {_LINES}, n AS (SELECT line_number, [lpad(i::VARCHAR, 6, '0')] AS path, 0 AS depth, json_extract(j, '$.descendants[' || i || ']') AS d FROM ja, unnest(range(0, coalesce(json_array_length(j, '$.descendants'), 0)::BIGINT)) AS u(i)
            UNION ALL SELECT line_number, list_append(path, lpad(i::VARCHAR, 6, '0')), depth + 1, json_extract(d, '$.descendants[' || i || ']') FROM n, unnest(range(0, coalesce(json_array_length(d, '$.descendants'), 0)::BIGINT)) AS u(i))
            SELECT line_number, (row_number() OVER (PARTITION BY line_number ORDER BY path) - 1)::INT AS position, depth::INT AS depth, json_extract_string(d, '$.word') AS word, json_extract_string(d, '$.lang_code') AS language_code FROM n""",
    }
