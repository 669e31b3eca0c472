"""Framed digests, identities and hash routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The domains that the digests begin with, and the profiles framed into revisions.
PACK_REVISION = "ELDICT-PACK-REVISION-V1"
ENTRY_ID = "ELDICT-ENTRY-ID-V1"
SELECTED_STREAM = "ELDICT-SELECTED-STREAM-V1"
SHARD_RECORDS = "ELDICT-SHARD-RECORDS-V1"
SNAPSHOT = "ELDICT-SNAPSHOT-V1"
AUDIO_REVISION = "ELDICT-AUDIO-REVISION-V1"
RECORDING_INPUTS = "ELDICT-AUDIO-RECORDING-INPUTS-V1"


def u64(number: Column) -> Column:
    """Eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def u32(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))


def field(value: Column) -> Column:
    """A field with its length before it. Strings count as UTF-8."""
    raw = value.cast("binary")
    return F.concat(u64(F.octet_length(raw)), raw)


def optional(value: Column) -> Column:
    """A byte for presence, then the field."""
    return F.when(value.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), field(value)))


def framed(domain: str, *parts: Column) -> Column:
    """The hex SHA-256 of a domain and already framed parts."""
    return F.sha2(F.concat(field(F.lit(domain)), *parts), 256)


def entry_id(revision_hex: Column, line_number: Column, record_sha256: Column) -> Column:
    return framed(ENTRY_ID, field(F.unhex(revision_hex)), field(u64(line_number)), field(record_sha256))


def pack_revision(columns: dict[str, Column], format_version: Column, unicode_profile: Column, compression_profile: Column, routing_policy: Column) -> Column:
    """The revision of a pack from everything that can change its behaviour; manifests enter by their digest."""
    text = lambda c: field(columns[c])
    return framed(
        PACK_REVISION,
        field(u32(format_version)),
        *[text(c) for c in ("pack_id", "corpus_language", "wiktionary_edition", "wiktionary_dump_date", "kaikki_extraction_date", "source_url", "compressed_source_sha256", "uncompressed_source_sha256")],
        *[text(c) for c in ("wiktextract_revision", "wikitextprocessor_revision", "builder_revision")],
        field(unicode_profile),
        field(compression_profile),
        field(routing_policy),
        field(u64(columns["target_shard_payload_bytes"])),
        field(F.unhex(F.sha2(columns["source_manifest"], 256))),
        field(F.unhex(F.sha2(columns["license_manifest_json"], 256))),
        field(F.lit("")),
        text("minimum_app_version"),
    )


def snapshot_revision(views: Column) -> Column:
    """The revision of an ordered list of views: array<struct<view_id, pack_id, pack_revision (hex), target_language>>."""
    one = lambda v: F.concat(
        field(v["view_id"]),
        field(v["pack_id"]),
        field(F.unhex(v["pack_revision"])),
        field(F.when(v["target_language"].isNull(), F.lit("monolingual")).otherwise(F.lit("bilingual"))),
        field(F.coalesce(v["target_language"], F.lit(""))),
    )
    body = F.unhex(F.array_join(F.transform(views, lambda v: F.hex(one(v))), ""))
    return framed(SNAPSHOT, field(u64(F.size(views))), body)


def audio_revision(c: dict[str, Column], format_version: Column, encoder_profile: Column) -> Column:
    """The revision of an audio collection."""
    return framed(
        AUDIO_REVISION,
        field(u32(format_version)),
        *[field(c[n]) for n in ("pack_id", "corpus_language", "source_corpus_pack_id")],
        field(F.unhex(c["source_corpus_revision"])),
        field(c["acquired_at"]),
        field(encoder_profile),
        field(c["builder_revision"]),
        field(c["delivery"]),
        field(u64(c["chunk_count"])),
        field(F.unhex(c["recording_input_digest"])),
        field(c["minimum_app_version"]),
    )


def recording_facts(c: dict[str, Column]) -> Column:
    """The framed facts of one recording. author_urls is an array; no license is a single zero byte."""
    urls = F.coalesce(c["author_urls"], F.array().cast("array<string>"))
    license_ = F.when(c["license_short_name"].isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(optional(c["license_short_name"]), optional(c["license_identifier"]), optional(c["license_url"])))
    one_byte = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))
    return F.concat(
        field(c["file_name"]),
        field(one_byte(c["status"])),
        optional(c["reason"]),
        field(u64(c["reference_count"])),
        optional(c["source_title"]),
        optional(c["source_sha1"]),
        optional(c["source_timestamp"]),
        optional(c["source_media_type"]),
        optional(u64(c["source_size_bytes"])),
        optional(c["description_url"]),
        license_,
        optional(c["author_text"]),
        field(u64(F.size(urls))),
        F.unhex(F.array_join(F.transform(urls, lambda u: F.hex(field(u))), "")),
        optional(F.when(c["attribution_required"].isNotNull(), one_byte(c["attribution_required"].cast("int")))),
    )


def chunk_for(name: Column, chunks: int) -> Column:
    """The chunk of a recording: the first eight bytes of its name's SHA-256, modulo ``chunks``."""
    if chunks < 1:
        raise ValueError("chunks must be positive")
    return (F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)") % chunks).cast("int")


def fnv_shard(name: Column, shards: int) -> Column:
    """1-based shard of a name: 64-bit FNV-1a over its UTF-8 bytes."""
    if shards < 1:
        raise ValueError("shards must be positive")
    wide = "decimal(20,0)"
    # The prime is 2^40 + 435: two products that each fit a decimal, modulo 2^64.
    whole = F.lit("18446744073709551616").cast("decimal(38,0)")
    bytes_ = F.transform(F.filter(F.split(F.regexp_replace(F.hex(name.cast("binary")), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        mixed = (h - low.cast(wide) + low.bitwiseXOR(b).cast(wide)).cast("decimal(38,0)")
        return ((mixed * F.lit("435").cast("decimal(4,0)") + (mixed % F.lit(1 << 24).cast("decimal(10,0)")).cast("decimal(10,0)") * F.lit(1 << 40).cast("decimal(15,0)")).cast("decimal(38,0)") % whole).cast(wide)

    hashed = F.aggregate(bytes_, F.lit("14695981039346656037").cast(wide), step)
    return (hashed % shards).cast("int") + 1
