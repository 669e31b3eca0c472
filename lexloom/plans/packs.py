"""Queries over packs built from the domain's tables: their life cycle, entries, sections and checks, with their oracles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import lookup, pack, project
from lexloom.plans import reference
from lexloom.tables import materialized, shared_dir, table

_built: dict[tuple, str] = {}


def built(spark: SparkSession, sf: str) -> str:
    """The path of a pack of all good lines of the newest file, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        newest = table(spark, sf, "pack_metadata").where(F.col("pack_revision") == reference.newest_revision(spark, sf)).first().asDict()
        identity = {c: "" if v is None else v for c, v in newest.items() if c not in ("pack_revision", "format_version", "unicode_profile", "compatible_audio_collection")} | {"source_manifest": "{}"}
        identity |= {c: bytes(newest[c] or b"").hex() for c in ("compressed_source_sha256", "uncompressed_source_sha256")}
        bad = reference.examined(spark, sf).where("error is not null").select("line_number")
        out = f"{shared_dir(spark)}/pack-{key[0]}-{abs(hash(sf)):x}"
        pack.build_of(reference.lines(spark, sf).join(bad, "line_number", "left_anti"), identity, out)
        _built[key] = out
    return _built[key]


def opened(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], dict]:
    path = built(spark, sf)
    manifest = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/manifest").collect()))
    return pack.open_pack(spark, path, "installed", manifest["pack_revision"]), manifest


def r_pack_manifest(spark: SparkSession, sf: str) -> DataFrame:
    manifest = opened(spark, sf)[1]
    return spark.createDataFrame([(manifest["pack_id"], manifest["record_count"], manifest["uncompressed_bytes"])], "pack_id string, record_count long, uncompressed_bytes long")


def r_pack_entries(spark: SparkSession, sf: str) -> DataFrame:
    """All entries of the pack in order."""
    tables = opened(spark, sf)[0]
    return tables["entries"].select("selected_ordinal", "line_number", "byte_offset", "authored_headword", "language_code", "uncompressed_size_bytes", F.lower(F.hex("record_sha256")).alias("record_sha256"))


def r_pack_records(spark: SparkSession, sf: str) -> DataFrame:
    """All records, decompressed and authenticated."""
    facts = pack.authenticated(opened(spark, sf)[0])
    return facts.select("selected_ordinal", F.sha2("source_bytes", 256).alias("sha256"), "facts_agree", "size_agrees", "digest_agrees", "identity_agrees")


def r_pack_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """All headwords of the documents in the pack's own index, with the headwords found."""
    tables = opened(spark, sf)[0]
    hits = lookup.lookup(reference.asked(spark, sf), tables["lookup_keys"])
    return hits.join(tables["entries"].select("selected_ordinal", "authored_headword"), "selected_ordinal").select("query", "match_class", "rank", "authored_headword", "truncated")


def r_pack_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every check of an intact pack."""
    return pack.checks(*opened(spark, sf))


def r_pack_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """What each way to tamper with a pack breaks."""
    tables, manifest = opened(spark, sf)
    first = F.col("selected_ordinal") == 0
    other = lambda c, to: F.when(first, to).otherwise(F.col(c))
    ways = {
        "payload": tables | {"records": tables["records"].withColumn("payload", other("payload", F.lit(b"not a frame")))},
        "headword": tables | {"entries": tables["entries"].withColumn("authored_headword", other("authored_headword", F.concat("authored_headword", F.lit("x"))))},
        "entry": tables | {"entries": tables["entries"].where(~first)},
        "key": tables | {"lookup_keys": tables["lookup_keys"].where(~(first & (F.col("match_class") == 1)))},
        "shard": tables | {"data_shards": tables["data_shards"].withColumn("digest", F.when(F.col("shard_ordinal") == 0, F.lit("0" * 64)).otherwise(F.col("digest")))},
        "column": tables | {"entries": tables["entries"].withColumn("more", F.lit(1))},
    }
    made = None
    for way, changed in ways.items():
        broken = materialized(pack.checks(changed, manifest)).where("n_bad > 0").select(F.lit(way).alias("tampered"), "check")
        made = broken if made is None else made.unionByName(broken)
    return made


def references(spark: SparkSession, sf: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(line_number, pack_revision, entry_id): every entry, and for each entry of the first shard one reference of another revision and one with another identity."""
    revision = tables["pack_metadata"].first().pack_revision
    own = tables["entries"].select("line_number", "shard_ordinal", F.lit(revision).alias("pack_revision"), "entry_id")
    foreign = own.where("line_number % 7 = 0").select((-F.col("line_number")).alias("line_number"), "shard_ordinal", F.lit("0" * 64).alias("pack_revision"), "entry_id")
    unknown = own.where("line_number % 7 = 1").select((-F.col("line_number")).alias("line_number"), "shard_ordinal", "pack_revision", F.unhex(F.sha2("entry_id", 256)).alias("entry_id"))
    return own.unionByName(foreign).unionByName(unknown).drop("shard_ordinal")


def r_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry by its reference; references of other packs and unknown identities are refused (negative line numbers)."""
    tables = opened(spark, sf)[0]
    made = pack.entry(references(spark, sf, tables), tables)
    e = "entry."
    return made.select("line_number", f"{e}headword", f"{e}language_code", f"{e}part_of_speech", F.col(f"{e}senses.total").alias("n_senses"), F.array_join(F.col(f"{e}tags"), "|").alias("tags"), "error")


#: Sections whose items are texts or objects with one text to show.
SECTIONS = {"etymology": None, "notes": None, "categories": None, "pronunciations": "ipa", "hyphenations": "sense", "forms": "form", "translations": "word", "synonyms": "word", "derived": "word", "related": "word", "antonyms": "word"}


def r_section_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of every section of every entry that has any: how many there are, and what they show."""
    tables = opened(spark, sf)[0]
    refs = tables["entries"].select("line_number", F.lit(tables["pack_metadata"].first().pack_revision).alias("pack_revision"), "entry_id")
    found = materialized(pack.resolved(refs, tables).where("error is null").select("line_number", "source_json"))
    made = None
    for kind, shown in SECTIONS.items():
        page = project.section(found, "line_number", "source_json", kind, 0, 16)
        items = F.from_json("page", "array<string>")
        texts = items if shown is None else F.transform(items, lambda x: F.coalesce(F.get_json_object(x, f"$.{shown}"), F.lit("∅")))  # noqa: B023
        rows = page.where("total > 0 or error is not null").select("line_number", F.lit(kind).alias("section"), "total", F.array_join(texts, "|").alias("shown"), "error")
        made = rows if made is None else made.unionByName(rows)
    return made


NAMES = [r_pack_manifest, r_pack_entries, r_pack_records, r_pack_lookup, r_pack_checks, r_pack_tampered, r_entry, r_section_pages]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


_OWN = f"""{reference._LINES},
recs AS (SELECT line_number AS source_line_number, row_number() OVER (ORDER BY line_number) - 1 AS selected_ordinal FROM ja),
e AS (SELECT selected_ordinal, line_number, byte_offset, json_extract_string(j, '$.word') AS authored_headword, json_extract_string(j, '$.lang_code') AS language_code,
      octet_length(encode(source_json))::BIGINT AS uncompressed_size_bytes, sha256(source_json) AS record_sha256, j FROM ja JOIN recs ON source_line_number = line_number)"""

#: Every check of a pack, and what each way to tamper with one breaks.
CHECKS = "facts_agree size_agrees digest_agrees identity_agrees projection shard_digests schema keys orphan_keys shard_order shard_totals repeated_ids record_count".split()
BROKEN = {
    "payload": "size_agrees digest_agrees keys projection shard_digests",
    "headword": "facts_agree",
    "entry": "facts_agree size_agrees identity_agrees digest_agrees orphan_keys shard_order shard_totals record_count shard_digests",
    "key": "keys",
    "shard": "shard_digests",
    "column": "schema",
}


def _section_sql(kind: str, shown: str | None) -> str:
    name = {"pronunciations": "sounds"}.get(kind, kind)
    items = f"json_extract(j, '$.{name}[*]')"
    if kind == "etymology":
        items = "CASE WHEN json_extract(j, '$.etymology_text') IS NOT NULL THEN [json_extract(j, '$.etymology_text')] ELSE json_extract(j, '$.etymology_texts[*]') END"
    text = "json_extract_string(x, '$')" if shown is None else f"coalesce(json_extract_string(x, '$.{shown}'), '∅')"
    return f"SELECT line_number, '{kind}' AS section, len(x)::BIGINT AS total, array_to_string(list_transform(x[1:16], lambda x: {text}), '|') AS shown, NULL::VARCHAR AS error FROM (SELECT line_number, {items} AS x FROM e) WHERE len(x) > 0"


def oracle_sql() -> dict[str, str]:
    keys = f"{reference._EXPECTED}, stored AS (SELECT * FROM expected), {reference._HITS}"
    tags = "coalesce(array_to_string(list_transform(json_extract(j, '$.tags[*]'), lambda x: json_extract_string(x, '$')), '|'), '')"
    return {
        "r_pack_manifest": f"WITH {_OWN} SELECT 'ja-lexicon' AS pack_id, count(*) AS record_count, sum(uncompressed_size_bytes)::BIGINT AS uncompressed_bytes FROM e",
        "r_pack_entries": f"WITH {_OWN} SELECT * EXCLUDE (j) FROM e",
        "r_pack_records": f"WITH {_OWN} SELECT selected_ordinal, record_sha256 AS sha256, true AS facts_agree, true AS size_agrees, true AS digest_agrees, true AS identity_agrees FROM e",
        "r_pack_lookup": f"WITH {_OWN}, {keys} SELECT query, match_class, rank, authored_headword, truncated FROM hits JOIN e USING (selected_ordinal)",
        "r_pack_checks": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 0::BIGINT)" for c in CHECKS) + ') t("check", n_bad)',
        "r_pack_tampered": "SELECT * FROM (VALUES " + ", ".join(f"('{way}', '{c}')" for way, found in BROKEN.items() for c in found.split()) + ') t(tampered, "check")',
        "r_entry": f"""WITH {_OWN} SELECT line_number, authored_headword AS headword, language_code, json_extract_string(j, '$.pos') AS part_of_speech, coalesce(json_array_length(j, '$.senses'), 0)::BIGINT AS n_senses, {tags} AS tags, NULL AS error FROM e
            UNION ALL SELECT -line_number, NULL, NULL, NULL, NULL, NULL, 'UnknownEntry' FROM e WHERE line_number % 7 IN (0, 1)""",
        "r_section_pages": f"WITH {_OWN} " + " UNION ALL ".join(_section_sql(k, c) for k, c in SECTIONS.items()),
    }
