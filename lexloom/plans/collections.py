"""Queries over recordings' collections, catalogues, source scans and projected sections, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import audio, catalog, project
from lexloom.plans import reference
from lexloom.sources import jsonl
from lexloom.tables import materialized, shared_dir, table

_built: dict[tuple, str] = {}


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per file name with the facts a collection keeps; recordings without digests are missing ones."""
    rows = reference.recordings(spark, sf).where("file_name is not null")
    rows = audio.latest(rows, "file_name", "fetched_at")
    rows = audio.with_authors(rows, table(spark, sf, "authors"))
    there = F.col("sha256").isNotNull() & (F.col("size_bytes") > 0)
    status = F.when(there, 1).otherwise(3)
    return rows.select(
        "file_name", status.alias("status"), F.when(~there, "missing").alias("reason"), F.lit(1).cast("long").alias("reference_count"), F.col("commons_title").alias("source_title"), F.unhex("sha1").alias("source_sha1"), F.col("uploaded_at").alias("source_timestamp"),
        F.col("mime").alias("source_media_type"), F.col("size_bytes").alias("source_size_bytes"), "description_url", "license_short_name", F.col("license").alias("license_identifier"), "license_url", "author_text",
        F.coalesce(F.from_json("author_urls_json", "array<string>"), F.array().cast("array<string>")).alias("author_urls"), F.col("attribution_required").try_cast("boolean").alias("attribution_required"), F.when(there, F.col("sha256")).alias("blob_sha256"),
        F.when(there, F.least("size_bytes", F.lit(audio.MAX_RECORDING_BYTES))).cast("long").alias("blob_size_bytes"),
    )


META = {"pack_id": "ja-audio", "corpus_language": "ja", "source_corpus_pack_id": "ja-lexicon", "source_corpus_revision": "ab" * 32, "acquired_at": "2026-09-01", "delivery": "remote", "builder_revision": "1", "minimum_app_version": "1", "encoder_profile": "", "format_version": 1}


def collection(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables of a collection of all recordings, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        out = f"{shared_dir(spark)}/collection-{key[0]}-{abs(hash(sf)):x}"
        audio.build_collection(materialized(recordings(spark, sf)), out, META, reference.CHUNKS)
        _built[key] = out
    return audio.open_collection(spark, _built[key])


def r_collection_recordings(spark: SparkSession, sf: str) -> DataFrame:
    """All recordings of the collection, with licence, author, title and page restored."""
    rows = collection(spark, sf)["recordings"]
    return rows.select("file_name", "status", "reason", "source_title", "license_short_name", "license_identifier", "license_url", "author_text", F.lower(F.hex("source_sha1")).alias("sha1"), "blob_size_bytes")


def r_collection_checks(spark: SparkSession, sf: str) -> DataFrame:
    return audio.collection_errors(collection(spark, sf))


def r_collection_status(spark: SparkSession, sf: str) -> DataFrame:
    """How many recordings have each status, and how many none: one zero-filled row."""
    rows = collection(spark, sf)["recordings"]
    return rows.agg(*[F.count_if(F.col("status") == i).alias(f"status_{i}") for i in range(1, 5)])


def r_collection_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return collection(spark, sf)["chunks"].select("chunk", "blob_count", "blob_bytes")


def r_collection_licences(spark: SparkSession, sf: str) -> DataFrame:
    """The licence of each ordinal."""
    return collection(spark, sf)["licenses"]


def r_reference_set(spark: SparkSession, sf: str) -> DataFrame:
    """The names that records refer to, read back from the JSON report."""
    report = audio.reference_set(audio.references(materialized(reference.sounds(spark, sf))))
    files = F.from_json(F.get_json_object("value", "$.files"), "array<array<string>>")
    return spark.createDataFrame([(report,)], "value string").select(F.explode(files).alias("x")).select(F.col("x")[0].alias("file_name"), F.col("x")[1].cast("long").alias("n"))


def catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """(pack_revision, body): one catalogue per snapshot, whose assets are its shards."""
    shards = reference.r_shard_stats(spark, sf)
    asset = F.struct(text.shard_file(F.col("shard_ordinal")).alias("file_name"), F.concat(F.lit("https://host.example/releases/v-"), F.substring("pack_revision", 1, 8), F.lit("/"), text.shard_file(F.col("shard_ordinal"))).alias("url"), F.sha2(F.concat_ws("/", "pack_revision", "shard_ordinal"), 256).alias("sha256"), F.col("compressed_bytes").alias("size_bytes"))
    packs = shards.groupBy("pack_revision").agg(F.array_sort(F.collect_list(asset)).alias("assets"), F.sum("compressed_bytes").alias("installed_bytes"))  # at most 256 shards
    meta = table(spark, sf, "pack_metadata").select("pack_revision", "pack_id", "corpus_language", "wiktionary_edition", "wiktionary_dump_date", "minimum_app_version").where("pack_revision is not null").distinct()
    release = F.struct("pack_id", "pack_revision", "minimum_app_version", "installed_bytes", "assets")
    pack = F.struct(F.lit("corpus").alias("pack_type"), "corpus_language", "wiktionary_edition", "wiktionary_dump_date", F.lit(True).alias("monolingual"), F.array(F.lit("de")).alias("bilingual_targets"), F.array(F.lit("CC BY-SA")).alias("licenses"), release.alias("release"))
    body = F.to_json(F.struct(F.lit(1).alias("catalog_version"), F.lit("r1").alias("catalog_revision"), F.lit("now").alias("generated_at"), F.array(pack).alias("packs")))
    return packs.join(meta, "pack_revision").select("pack_revision", body.alias("body"))


def r_catalog_assets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.assets(catalogs(spark, sf), "body").select("pack_id", "pack_revision", "file_name", "url", "sha256", "size_bytes")


def r_catalog_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.installed_sizes(catalog.assets(catalogs(spark, sf), "body"))


def r_catalog_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogues with a wrong sum, a wrong version and no packs at all, and what is wrong with each."""
    good = catalogs(spark, sf)
    ways = {"sum": F.regexp_replace("body", r'"installed_bytes":(\d+)', '"installed_bytes":1$1'), "version": F.replace("body", F.lit('"catalog_version":1'), F.lit('"catalog_version":2')), "cut": F.substring("body", 1, 30), "none": F.col("body")}
    docs = good.select("pack_revision", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), v.alias("body")) for k, v in ways.items()])).alias("x")).select(F.concat_ws(" ", "x.way", "pack_revision").alias("key"), "x.body")
    found = catalog.errors(docs, "key", "body", catalog.catalog_errors)
    return found.select(F.split("key", " ")[1].alias("pack_revision"), F.split("key", " ")[0].alias("way"), F.regexp_replace("error", "^.*: ", "").alias("code"))


def r_release_tags(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.release_tags(catalog.assets(catalogs(spark, sf), "body"))


def r_published_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The first snapshot's assets against a release that lacks the last shard of each and has another size for the first."""
    rows = catalog.assets(catalogs(spark, sf), "body").select(F.concat_ws("/", "pack_revision", "file_name").alias("file_name"), "size_bytes", "sha256", "pack_revision")
    ends = rows.groupBy("pack_revision").agg(F.max("file_name").alias("last"), F.min("file_name").alias("first"))
    published = rows.join(ends, "pack_revision").where("file_name <> last").select("file_name", (F.col("size_bytes") + F.when(F.col("file_name") == F.col("first"), 1).otherwise(0)).alias("size_bytes"), "sha256")
    return catalog.published_differences(rows.drop("pack_revision"), published)


def r_line_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The newest file's lines written to one text file and scanned again: numbers, offsets and digests."""
    key = (spark.sparkContext.applicationId, "lines", sf)
    if key not in _built:
        out = f"{shared_dir(spark)}/lines-{key[0]}-{abs(hash(sf)):x}"
        reference.lines(spark, sf).repartition(1).sortWithinPartitions("line_number").select(F.col("source_bytes").cast("string").alias("value")).write.text(out)
        _built[key] = out
    found = jsonl.lines(spark, _built[key]).where("octet_length(source_bytes) > 0 or byte_offset >= 0")
    return found.select("line_number", "byte_offset", F.octet_length("source_bytes").alias("n_bytes"), F.sha2("source_bytes", 256).alias("sha256"))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    """(line_number, entry): every selected record within exhaustive bounds."""
    return project.entries(reference.objects(spark, sf), "source_json", project.EXHAUSTIVE).where("error is null").select("line_number", "entry")


def r_senses(spark: SparkSession, sf: str) -> DataFrame:
    """Every projected sense with its texts, lemmas and counts."""
    rows = projected(spark, sf).select("line_number", F.posexplode("entry.senses.items").alias("sense_pos", "s"))
    joined = lambda c: F.array_join(F.col(c), "|")
    return rows.select("line_number", "sense_pos", joined("s.glosses").alias("glosses"), joined("s.tags").alias("tags"), joined("s.raw_tags").alias("raw_tags"), joined("s.topics").alias("topics"), joined("s.categories").alias("categories"), joined("s.notes").alias("notes"), F.col("s.sense_index").alias("sense_index"), joined("s.form_of.word").alias("form_of"), F.col("s.examples.total").alias("n_examples"), F.col("s.translations.total").alias("n_translations"))


def r_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Every projected example with its emphasis."""
    rows = projected(spark, sf).select("line_number", F.posexplode("entry.senses.items").alias("sense_pos", "s")).select("line_number", "sense_pos", F.posexplode("s.examples.items").alias("item_pos", "x"))
    ranges = F.array_join(F.transform("x.text_emphasis", lambda e: F.concat_ws("-", e["start"], e["end"])), "|")
    return rows.select("line_number", "sense_pos", "item_pos", F.col("x.text").alias("text"), F.col("x.translation").alias("translation"), F.col("x.reference").alias("reference"), ranges.alias("emphasis"))


def r_projected_translations(spark: SparkSession, sf: str) -> DataFrame:
    rows = projected(spark, sf).select("line_number", F.posexplode("entry.translations.items").alias("item_pos", "t"))
    return rows.select("line_number", "item_pos", "t.word", "t.note", "t.language_code", "t.language_name", "t.sense", F.array_join("t.tags", "|").alias("tags"))


def r_forms(spark: SparkSession, sf: str) -> DataFrame:
    rows = projected(spark, sf).select("line_number", F.posexplode("entry.forms.items").alias("item_pos", "f"))
    return rows.select("line_number", "item_pos", "f.form", F.col("f.romanization").alias("roman"), "f.sense_index", F.array_join("f.tags", "|").alias("tags"))


def r_pronunciations(spark: SparkSession, sf: str) -> DataFrame:
    rows = projected(spark, sf).select("line_number", F.posexplode("entry.pronunciations.items").alias("item_pos", "p"))
    return rows.select("line_number", "item_pos", "p.ipa", "p.other", F.array_join("p.homophones", "|").alias("homophones"), F.array_join("p.tags", "|").alias("tags"), F.col("p.not_same_pronunciation").alias("not_same"))


def r_relations(spark: SparkSession, sf: str) -> DataFrame:
    rows = projected(spark, sf).select("line_number", F.explode("entry.relations").alias("g")).select("line_number", "g.kind", F.posexplode("g.relations.items").alias("item_pos", "r"))
    return rows.select("line_number", "kind", "item_pos", "r.word", "r.sense")


NAMES = [
    r_collection_recordings, r_collection_checks, r_collection_status, r_collection_chunks, r_collection_licences, r_reference_set, r_catalog_assets, r_catalog_sizes, r_catalog_errors, r_release_tags, r_published_differences, r_line_scan,
    r_senses, r_examples, r_projected_translations, r_forms, r_pronunciations, r_relations,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


_LATEST = """c AS (SELECT recording_id, file_name, commons_title, description_url, original_url, sha1, sha256, uploaded_at, size_bytes, mime, unnest(extmetadata), author_ordinal, fetched_at FROM commons_fixtures WHERE file_name IS NOT NULL),
au AS (SELECT author_ordinal, max(author_text) AS author_text FROM authors GROUP BY 1),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY fetched_at DESC) = 1),
r AS (SELECT k.*, author_text, sha256 IS NOT NULL AND size_bytes > 0 AS there FROM k LEFT JOIN au USING (author_ordinal))"""
_SHARDS = """d AS (SELECT DISTINCT * EXCLUDE (delivered_at) FROM records),
m AS (SELECT DISTINCT pack_revision, pack_id FROM pack_metadata WHERE pack_revision IS NOT NULL),
s AS (SELECT m.pack_id, d.pack_revision, shard_ordinal, printf('data-%03d', shard_ordinal) AS file_name, sum(compressed_size_bytes)::BIGINT AS size_bytes FROM d JOIN m USING (pack_revision) GROUP BY ALL)"""


def _list(alias: str, name: str) -> str:
    return f"coalesce(array_to_string(list_transform(json_extract({alias}, '$.{name}[*]'), lambda x: json_extract_string(x, '$')), '|'), '')"


def oracle_sql() -> dict[str, str]:
    ja = f"WITH {reference._LINES}"
    sense = "sn AS (SELECT line_number, (u.i - 1)::INT AS sense_pos, json_extract(j, '$.senses[' || (u.i - 1) || ']') AS s FROM ja, unnest(range(1, coalesce(json_array_length(j, '$.senses'), 0)::BIGINT + 1)) AS u(i))"

    def items(name: str, holder: str = "ja", at: str = "j", keys: str = "line_number") -> str:
        return f"SELECT {keys}, (u.i - 1)::INT AS item_pos, json_extract({at}, '$.{name}[' || (u.i - 1) || ']') AS x FROM {holder}, unnest(range(1, coalesce(json_array_length({at}, '$.{name}'), 0)::BIGINT + 1)) AS u(i)"

    get = lambda *names: ", ".join(f"json_extract_string(x, '$.{n.split('=')[-1]}') AS {n.split('=')[0]}" for n in names)
    relations = " UNION ALL ".join(f"SELECT *, '{k}' AS kind FROM ({items(project.RELATION_FIELDS.get(k, k))})" for k in project.RELATIONS)
    return {
        "r_collection_recordings": f"WITH {_LATEST} SELECT file_name, CASE WHEN there THEN 1 ELSE 3 END AS status, CASE WHEN NOT there THEN 'missing' END AS reason, commons_title AS source_title, license_short_name, license AS license_identifier, license_url, nullif(author_text, '') AS author_text, lower(sha1) AS sha1, CASE WHEN there THEN least(size_bytes, 1048576) END::BIGINT AS blob_size_bytes FROM r",
        "r_collection_checks": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 0::BIGINT)" for c in ("chunk", "status", "license", "author", "chunk_totals", "digest", "size", "delivery", "repeated_names")) + ') t("check", n_bad)',
        "r_collection_status": f"WITH {_LATEST} SELECT count(*) FILTER (there) AS status_1, 0::BIGINT AS status_2, count(*) FILTER (NOT there) AS status_3, 0::BIGINT AS status_4 FROM r",
        "r_collection_chunks": f"WITH {_LATEST}, b AS (SELECT (('0x' || substr(sha256(file_name), 1, 16))::UBIGINT % {reference.CHUNKS})::INT AS chunk, sha256, max(least(size_bytes, 1048576)) AS n FROM r WHERE there GROUP BY ALL) SELECT chunk, count(*) AS blob_count, sum(n)::BIGINT AS blob_bytes FROM b GROUP BY 1",
        "r_collection_licences": f"WITH {_LATEST}, li AS (SELECT DISTINCT license_short_name, license AS license_identifier, license_url FROM r WHERE coalesce(license_short_name, license, license_url) IS NOT NULL) SELECT *, (row_number() OVER (ORDER BY license_short_name NULLS FIRST, license_identifier NULLS FIRST, license_url NULLS FIRST) - 1)::INT AS license_ordinal FROM li",
        "r_reference_set": "SELECT file_name, n FROM (" + reference.oracle_sql()["r_audio_references"] + ") WHERE file_name IS NOT NULL",
        "r_catalog_assets": f"WITH {_SHARDS} SELECT pack_id, pack_revision, file_name, 'https://host.example/releases/v-' || substr(pack_revision, 1, 8) || '/' || file_name AS url, sha256(pack_revision || '/' || shard_ordinal) AS sha256, size_bytes FROM s",
        "r_catalog_sizes": f"WITH {_SHARDS} SELECT pack_id, pack_revision, sum(size_bytes)::BIGINT AS installed_bytes, sum(size_bytes)::BIGINT AS asset_bytes, true AS agrees FROM s GROUP BY ALL",
        "r_catalog_errors": f"WITH {_SHARDS}, p AS (SELECT DISTINCT pack_revision FROM s), w AS (SELECT * FROM (VALUES ('sum', 'release.installed_bytes'), ('version', 'version'), ('cut', 'malformed JSON')) t(way, code)) SELECT pack_revision, way, code FROM p, w",
        "r_release_tags": f"WITH {_SHARDS} SELECT DISTINCT pack_id, pack_revision, 'v-' || substr(pack_revision, 1, 8) AS tag, 1::BIGINT AS n_tags FROM s",
        "r_published_differences": f"WITH {_SHARDS}, n AS (SELECT pack_revision || '/' || file_name AS file_name, file_name = max(file_name) OVER (PARTITION BY pack_revision) AS last, file_name = min(file_name) OVER (PARTITION BY pack_revision) AS first FROM s) SELECT file_name, CASE WHEN last THEN 'not published' ELSE 'size differs' END AS error FROM n WHERE last OR first",
        "r_line_scan": f"{ja} SELECT row_number() OVER (ORDER BY line_number) AS line_number, (coalesce(sum(octet_length(encode(source_json)) + 1) OVER (ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset, octet_length(encode(source_json))::INT AS n_bytes, sha256(source_json) AS sha256 FROM l0",
        "r_senses": f"""{ja}, {sense} SELECT line_number, sense_pos, {_list('s', 'glosses')} AS glosses, {_list('s', 'tags')} AS tags, {_list('s', 'raw_tags')} AS raw_tags, {_list('s', 'topics')} AS topics, {_list('s', 'categories')} AS categories,
            coalesce(array_to_string(list_filter([json_extract_string(s, '$.note'), nullif({_list('s', 'notes')}, '')], lambda x: x IS NOT NULL), '|'), '') AS notes, json_extract_string(s, '$.sense_index') AS sense_index,
            coalesce(array_to_string(list_transform(json_extract(s, '$.form_of[*]'), lambda x: json_extract_string(x, '$.word')), '|'), '') AS form_of, coalesce(json_array_length(s, '$.examples'), 0)::BIGINT AS n_examples, coalesce(json_array_length(s, '$.translations'), 0)::BIGINT AS n_translations FROM sn""",
        "r_examples": f"""{ja}, {sense}, x AS ({items('examples', 'sn', 's', 'line_number, sense_pos')}) SELECT line_number, sense_pos, item_pos, {get('text')}, coalesce(json_extract_string(x, '$.translation'), json_extract_string(x, '$.english')) AS translation, {get('reference=ref')},
            coalesce(array_to_string(list_transform(json_extract(x, '$.bold_text_offsets[*]'), lambda e: json_extract_string(e, '$[0]') || '-' || json_extract_string(e, '$[1]')), '|'), '') AS emphasis FROM x""",
        "r_projected_translations": f"{ja}, x AS ({items('translations')}) SELECT line_number, item_pos, {get('word', 'note')}, coalesce(json_extract_string(x, '$.lang_code'), json_extract_string(x, '$.code')) AS language_code, {get('language_name=lang', 'sense')}, {_list('x', 'tags')} AS tags FROM x",
        "r_forms": f"{ja}, x AS ({items('forms')}) SELECT line_number, item_pos, {get('form', 'roman', 'sense_index')}, {_list('x', 'tags')} AS tags FROM x",
        "r_pronunciations": f"{ja}, x AS ({items('sounds')}) SELECT line_number, item_pos, {get('ipa', 'other')}, {_list('x', 'homophones')} AS homophones, {_list('x', 'tags')} AS tags, json_extract_string(x, '$.not_same_pronunciation')::BOOLEAN AS not_same FROM x",
        "r_relations": f"{ja}, x AS ({relations}) SELECT line_number, kind, item_pos, {get('word', 'sense')} FROM x",
    }
