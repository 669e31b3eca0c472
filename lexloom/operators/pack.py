"""Building, writing, opening and verifying packs: entries, records, keys, shards, metadata and manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import digest
from lexloom.functions.digest import field, u64
from lexloom.operators import keys, order, project
from lexloom.sources import jsonl
from lexloom.tables import files, materialized

#: The compression level of a record, versions, and bounds of assets.
ZSTD_LEVEL, FORMAT_VERSION, MANIFEST_VERSION, MAX_ASSETS, MAX_ASSET_BYTES = 6, 1, 1, 256, 1_900_000_000
#: Bounds of a stored record.
MAX_COMPRESSED, MAX_UNCOMPRESSED = 16 * 1024 * 1024, 64 * 1024 * 1024
#: The profiles that our own packs frame into their revisions.
PROFILES = {"unicode": "unicode-16", "compression": "zstd-6", "routing": "headword-and-forms"}


class PackError(Exception):
    """kind: InvalidPackId, Io, Malformed, Corrupt, UnknownEntry or Limit."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@F.pandas_udf(T.BinaryType())
def compressed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import zstandard

    tool = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    for batch in batches:
        yield batch.map(lambda b: None if b is None else tool.compress(bytes(b)))


@F.pandas_udf(T.BinaryType())
def decompressed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Null if the bytes aren't a frame or hold more than a record may."""
    import zstandard

    def one(b: bytes | None) -> bytes | None:
        try:
            return None if b is None else zstandard.ZstdDecompressor().decompress(bytes(b), max_output_size=MAX_UNCOMPRESSED)
        except zstandard.ZstdError:
            return None

    for batch in batches:
        yield batch.map(one)


def framed_record(ordinal: Column, line: Column, offset: Column, source: Column) -> Column:
    return F.concat(field(u64(ordinal)), field(u64(line)), field(u64(offset)), field(source))


def entries(selected: DataFrame, revision: str, target: int) -> DataFrame:
    """Selected records with ordinal, identity, sizes, payload and shard. selected: rows of jsonl.select without errors."""
    good = selected.where("error is null")
    ranked = order.prefix_sum(good, [], "line_number", F.lit(1).cast("long"), "selected_ordinal")
    made = ranked.select(
        "selected_ordinal", "line_number", "byte_offset", "source_bytes", F.col("word").alias("authored_headword"), F.col("lang_code").alias("language_code"), "routing_forms",
        F.unhex(F.sha2("source_bytes", 256)).alias("record_sha256"), F.octet_length("source_bytes").cast("long").alias("uncompressed_size_bytes"), compressed("source_bytes").alias("payload"),
    )
    made = made.withColumn("entry_id", digest.entry_id(F.lit(revision), F.col("line_number"), F.col("record_sha256"))).withColumn("compressed_size_bytes", F.octet_length("payload").cast("long"))
    made = materialized(made.withColumn("pack_revision", F.lit(revision)))
    shards = order.greedy_shards(made, "pack_revision", "selected_ordinal", "compressed_size_bytes", target).select("selected_ordinal", F.col("shard").alias("shard_ordinal"))
    return made.join(shards, "selected_ordinal")


def shard_stats(rows: DataFrame, by: list[str], language: Column) -> DataFrame:
    """Per shard: records, first and last ordinal, both sums of bytes, records of another language."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("record_count"), F.min("selected_ordinal").alias("first_ordinal"), F.max("selected_ordinal").alias("last_ordinal"),
        F.sum("uncompressed_size_bytes").alias("uncompressed_bytes"), F.sum("compressed_size_bytes").alias("compressed_bytes"), F.count_if(F.col("language_code") != language).alias("foreign_records"),
    )


def shard_routes(stats: DataFrame, series: list[str], shard: str) -> DataFrame:
    """Shards with the ordinal expected first, and whether ranges are dense and follow each other."""
    w = Window.partitionBy(*series).orderBy(shard) if series else Window.orderBy(shard)
    expected = F.coalesce(F.lag("last_ordinal").over(w) + 1, F.lit(0))
    return stats.withColumn("expected_first", expected).withColumn(
        "contiguous", (F.col("first_ordinal") == expected) & (F.col("last_ordinal") - F.col("first_ordinal") + 1 == F.col("record_count"))
    )


def identity_errors(identity: DataFrame) -> DataFrame:
    """(pack_id, error) for each incomplete or malformed field of an identity."""
    from lexloom.functions.text import is_hex_digest, is_iso_date_prefix, is_pack_id

    checks = [(~is_pack_id(F.col("pack_id")), "invalid pack id")]
    checks += [(F.coalesce(F.col(c), F.lit("")) == "", f"empty {c}") for c in ("corpus_language", "wiktionary_edition", "source_url", "builder_revision", "minimum_app_version")]
    checks += [(F.coalesce(F.col(c), F.lit("")) == "", f"empty {c}") for c in ("wiktextract_revision", "wikitextprocessor_revision")]
    checks += [(~F.coalesce(is_iso_date_prefix(F.col(c)), F.lit(False)), f"{c} is not an ISO date") for c in ("wiktionary_dump_date", "kaikki_extraction_date")]
    checks += [(F.col("kaikki_extraction_date") < F.col("wiktionary_dump_date"), "extraction predates its dump"), (~is_hex_digest(F.col("pack_revision")), "malformed revision")]
    checks += [(F.coalesce(F.octet_length(c), F.lit(0)) != 32, f"{c} is not 32 bytes") for c in ("compressed_source_sha256", "uncompressed_source_sha256")]
    checks += [(F.coalesce(F.col("target_shard_payload_bytes"), F.lit(0)) <= 0, "target_shard_payload_bytes must be positive")]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]))
    return identity.distinct().select("pack_id", "pack_revision", F.explode(found).alias("error"))


def build(spark: SparkSession, identity: dict, path: str, out: str, partitions: int = 8) -> dict:
    """Builds a pack of the records at ``path`` and publishes it at ``out``, which must not exist. Returns the manifest."""
    return build_of(jsonl.lines(spark, path), identity, out, partitions)


def revision_of(row: DataFrame) -> str:
    """The revision that an identity (one row of pack_metadata, digests as hexadecimal text) gives."""
    columns = {c: F.col(c) for c in row.columns} | {c: F.unhex(F.col(c)) for c in ("compressed_source_sha256", "uncompressed_source_sha256")}
    return row.select(digest.pack_revision(columns, F.lit(FORMAT_VERSION), *[F.lit(PROFILES[p]) for p in ("unicode", "compression", "routing")])).first()[0]


def build_of(scanned: DataFrame, identity: dict, out: str, partitions: int = 8) -> dict:
    """The same of scanned lines (line_number, byte_offset, source_bytes).

    Tables are written beside ``out`` and moved there in one step; nothing stays if it fails. A
    record may have at most MAX_UNCOMPRESSED bytes, MAX_COMPRESSED compressed.
    """
    spark = scanned.sparkSession
    fs, here = files(spark, out)
    if fs.exists(here(out)):
        raise PackError("Io", f"output exists: {out}")
    staging = f"{out}.staging-{uuid.uuid4().hex}"
    try:
        selected = materialized(jsonl.select(scanned, identity["corpus_language"]))
        wrong = selected.where("error is not null").orderBy("line_number").select("line_number", "byte_offset", "error").first()
        if wrong:
            raise PackError("Malformed", f"line {wrong.line_number} at byte {wrong.byte_offset} {wrong.error}")
        row = spark.createDataFrame([{k: v for k, v in identity.items()}])
        revision = revision_of(row)
        made = materialized(entries(selected, revision, identity["target_shard_payload_bytes"]))
        total = made.agg(F.count(F.lit(1)).alias("n"), F.sum("uncompressed_size_bytes").alias("b")).first()
        large = made.where((F.col("uncompressed_size_bytes") > MAX_UNCOMPRESSED) | (F.col("compressed_size_bytes") > MAX_COMPRESSED)).agg(F.min("line_number").alias("line")).first().line
        if large is not None:
            raise PackError("Limit", f"line {large} is larger than a record may be")
        if not total.n:
            raise PackError("Malformed", f"no records of language `{identity['corpus_language']}`")
        frame = framed_record(F.col("selected_ordinal"), F.col("line_number"), F.col("byte_offset"), F.col("source_bytes"))
        stream = order.stream_digests(made, ["pack_revision"], "selected_ordinal", digest.SELECTED_STREAM, frame).first().digest
        shards = order.stream_digests(made, ["shard_ordinal"], "selected_ordinal", digest.SHARD_RECORDS, frame)
        index = keys.key_table(made.select("selected_ordinal", F.col("authored_headword").alias("word"), "routing_forms"))
        facts = ["selected_ordinal", "shard_ordinal", "entry_id", "line_number", "byte_offset", "authored_headword", "language_code", "uncompressed_size_bytes", "compressed_size_bytes", "record_sha256"]
        made.select(*facts).sortWithinPartitions("selected_ordinal").write.parquet(f"{staging}/entries")
        made.select(*facts, "payload").repartition("shard_ordinal").sortWithinPartitions("shard_ordinal", "selected_ordinal").write.partitionBy("shard_ordinal").parquet(f"{staging}/records")
        keys.sorted_index(index, partitions).write.parquet(f"{staging}/lookup_keys")
        shard_stats(made, ["shard_ordinal"], F.lit(identity["corpus_language"])).join(shards, "shard_ordinal").drop("n_records").write.parquet(f"{staging}/data_shards")
        row.withColumn("pack_revision", F.lit(revision)).write.parquet(f"{staging}/pack_metadata")
        n_shards = spark.read.parquet(f"{staging}/data_shards").count()
        if n_shards + 1 > MAX_ASSETS:
            raise PackError("Limit", f"{n_shards} shards are more than a pack may have")
        manifest = {"manifest_version": MANIFEST_VERSION, "format_version": FORMAT_VERSION, "pack_id": identity["pack_id"], "pack_revision": revision, "record_count": total.n, "uncompressed_bytes": total.b, "selected_stream_sha256": stream, "lookup_rows": spark.read.parquet(f"{staging}/lookup_keys").count(), "shards": n_shards}
        spark.createDataFrame([(json.dumps(manifest, indent=2) + "\n",)], "value string").coalesce(1).write.text(f"{staging}/manifest")
        if not fs.rename(here(staging), here(out)):
            raise PackError("Io", f"could not publish {out}")
        return manifest
    finally:
        if fs.exists(here(staging)):
            fs.delete(here(staging), True)


def open_pack(spark: SparkSession, path: str, level: str = "open", expected: str | None = None) -> dict[str, DataFrame]:
    """The tables of a pack. level: open (manifest agrees with metadata), installed (and with ``expected``) or verify (every check of ``checks``)."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("entries", "records", "lookup_keys", "data_shards", "pack_metadata")}
    manifest = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/manifest").collect()))
    meta = tables["pack_metadata"].collect()
    if len(meta) != 1 or meta[0].pack_revision != manifest["pack_revision"] or meta[0].pack_id != manifest["pack_id"]:
        raise PackError("Corrupt", "manifest and metadata differ")
    if revision_of(tables["pack_metadata"].drop("pack_revision")) != manifest["pack_revision"]:
        raise PackError("Corrupt", "the metadata give another revision")
    if level != "open" and expected is not None and manifest["pack_revision"] != expected:
        raise PackError("Corrupt", "unexpected revision")
    if level == "verify":
        bad = checks(tables, manifest).where("n_bad > 0").collect()
        if bad:
            raise PackError("Corrupt", ", ".join(f"{r.check}: {r.n_bad}" for r in bad))
    return tables


def authenticated(tables: dict[str, DataFrame]) -> DataFrame:
    """Entries joined with their records, one boolean per fact that must agree."""
    e, r = tables["entries"].alias("e"), tables["records"].withColumn("source_bytes", decompressed("payload")).alias("r")
    facts = ["line_number", "byte_offset", "authored_headword", "language_code", "uncompressed_size_bytes", "compressed_size_bytes", "record_sha256", "entry_id"]
    revision = F.lit(tables["pack_metadata"].first().pack_revision)
    joined = e.join(r, (F.col("e.selected_ordinal") == F.col("r.selected_ordinal")) & (F.col("e.shard_ordinal") == F.col("r.shard_ordinal")), "full")
    agree = F.lit(True)
    for c in facts:
        agree = agree & F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}"))
    return joined.select(
        F.coalesce("e.selected_ordinal", "r.selected_ordinal").alias("selected_ordinal"),
        F.col("r.source_bytes").alias("source_bytes"),
        agree.alias("facts_agree"),
        (F.octet_length("r.source_bytes") == F.col("e.uncompressed_size_bytes")).alias("size_agrees"),
        (F.unhex(F.sha2("r.source_bytes", 256)) == F.col("e.record_sha256")).alias("digest_agrees"),
        (digest.entry_id(revision, F.col("e.line_number"), F.col("e.record_sha256")) == F.col("e.entry_id")).alias("identity_agrees"),
    )


def resolved(references: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """References with selected_ordinal, shard_ordinal and source_json of their entries, and error.

    references: pack_revision, entry_id and any other columns. error is UnknownEntry for another
    pack's revision and for an identity that this pack doesn't have; such rows stay. Entries are
    joined to records by shard and ordinal, so that only the shards that are asked for are read.
    """
    revision = F.lit(tables["pack_metadata"].first().pack_revision)
    known = tables["entries"].select(F.col("entry_id").alias("__id"), "selected_ordinal", "shard_ordinal")
    found = references.join(known, (F.col("entry_id") == F.col("__id")) & (F.col("pack_revision") == revision), "left")
    records = tables["records"].select("shard_ordinal", "selected_ordinal", "payload")
    read = found.join(records, ["shard_ordinal", "selected_ordinal"], "left")
    return read.select(*references.columns, "selected_ordinal", "shard_ordinal", decompressed("payload").cast("string").alias("source_json"), F.when(F.col("__id").isNull(), "UnknownEntry").alias("error"))


def entry(references: DataFrame, tables: dict[str, DataFrame], bounds: project.Bounds = project.DETAIL, target: str | None = None) -> DataFrame:
    """References with entry (struct, see project.entries) or error: UnknownEntry, or why the record can't be projected."""
    found = resolved(references, tables).withColumnRenamed("error", "__unknown")
    made = project.entries(found.where("__unknown is null"), "source_json", bounds, target)
    unknown = found.where("__unknown is not null").select(*found.columns, F.lit(None).cast(project.ENTRY).alias("entry"), F.col("__unknown").alias("error"))
    return made.unionByName(unknown).drop("__unknown", "source_json")


def section_page(references: DataFrame, tables: dict[str, DataFrame], kind: str, offset: int, limit: int, sense: int | None = None, target: str | None = None) -> DataFrame:
    """(pack_revision, entry_id, total, page, error): one page of a section of each referred entry, see project.section."""
    found = resolved(references.select("pack_revision", "entry_id"), tables).withColumn("key", F.concat_ws(" ", "pack_revision", F.hex("entry_id")))
    made = project.section(found.where("error is null"), "key", "source_json", kind, offset, limit, sense, target)
    unknown = found.where("error is not null").select("key", F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("page"), "error")
    parts = F.split("key", " ")
    return made.unionByName(unknown).select(parts[0].alias("pack_revision"), F.unhex(parts[1]).alias("entry_id"), "total", "page", "error")


def record_at(tables: dict[str, DataFrame], shard: int, ordinal: int) -> DataFrame:
    """The record of one ordinal in one shard: one partition is read."""
    return tables["records"].where((F.col("shard_ordinal") == shard) & (F.col("selected_ordinal") == ordinal)).withColumn("source_bytes", decompressed("payload")).drop("payload")


#: The columns that each table of a pack must have, no more and no fewer.
SCHEMAS = {
    "entries": "selected_ordinal shard_ordinal entry_id line_number byte_offset authored_headword language_code uncompressed_size_bytes compressed_size_bytes record_sha256",
    "records": "selected_ordinal shard_ordinal entry_id line_number byte_offset authored_headword language_code uncompressed_size_bytes compressed_size_bytes record_sha256 payload",
    "lookup_keys": "match_class key selected_ordinal authored_key_ordinal",
    "data_shards": "shard_ordinal record_count first_ordinal last_ordinal uncompressed_bytes compressed_bytes foreign_records digest",
}


def schema_errors(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, missing or surplus) of tables whose columns aren't those of a pack."""
    out = []
    for name, columns in SCHEMAS.items():
        have, want = set(tables[name].columns), set(columns.split())
        out += [(name, c, "missing") for c in sorted(want - have)] + [(name, c, "surplus") for c in sorted(have - want)]
    return out


def checks(tables: dict[str, DataFrame], manifest: dict) -> DataFrame:
    """(check, n_bad): every rule a pack must satisfy and how often it is broken. Every record is projected, and every shard's digest derived anew."""
    language = tables["pack_metadata"].first().corpus_language
    facts = materialized(authenticated(tables))
    bad = lambda c: facts.agg(F.count_if(~F.coalesce(F.col(c), F.lit(False))).alias("n_bad")).select(F.lit(c).alias("check"), "n_bad")
    found = bad("facts_agree")
    for c in ("size_agrees", "digest_agrees", "identity_agrees"):
        found = found.unionByName(bad(c))
    parsed = jsonl.select(facts.select(F.col("selected_ordinal").alias("line_number"), F.lit(0).cast("long").alias("byte_offset"), "source_bytes"), language)
    expected = keys.key_table(parsed.where("error is null").select(F.col("line_number").alias("selected_ordinal"), "word", "routing_forms"))
    columns = ["match_class", "key", "selected_ordinal", "authored_key_ordinal"]
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    routes = shard_routes(shard_stats(tables["entries"], ["shard_ordinal"], F.lit(language)), [], "shard_ordinal")
    stored = tables["data_shards"].select("shard_ordinal", "record_count", "first_ordinal", "last_ordinal", "uncompressed_bytes", "compressed_bytes")
    counted = routes.select(*stored.columns)
    count = tables["entries"].agg((F.count(F.lit(1)) != manifest["record_count"]).cast("long").alias("n_bad")).select(F.lit("record_count").alias("check"), "n_bad")
    numbers = ["line_number", "byte_offset"]
    placed = facts.select("selected_ordinal", "source_bytes").join(tables["entries"].select("selected_ordinal", "shard_ordinal", *numbers), "selected_ordinal")
    frame = framed_record(F.col("selected_ordinal"), F.col("line_number"), F.col("byte_offset"), F.coalesce("source_bytes", F.lit(b"")))
    derived = order.stream_digests(placed, ["shard_ordinal"], "selected_ordinal", digest.SHARD_RECORDS, frame).select("shard_ordinal", "digest")
    readable = project.entries(facts.select("selected_ordinal", F.col("source_bytes").cast("string").alias("source_json")), "source_json", project.EXHAUSTIVE)
    return (
        found.unionByName(one("projection", readable.where("error is not null")))
        .unionByName(one("shard_digests", keys.differences(derived, tables["data_shards"], ["shard_ordinal", "digest"])))
        .unionByName(tables["entries"].sparkSession.createDataFrame([("schema", len(schema_errors(tables)))], "check string, n_bad long"))
        .unionByName(one("keys", keys.differences(expected, tables["lookup_keys"], columns)))
        .unionByName(one("orphan_keys", keys.orphans(tables["lookup_keys"], tables["entries"], "selected_ordinal")))
        .unionByName(one("shard_order", routes.where("not contiguous or foreign_records > 0")))
        .unionByName(one("shard_totals", keys.differences(counted, stored, stored.columns)))
        .unionByName(one("repeated_ids", tables["entries"].groupBy("entry_id").count().where("count > 1")))
        .unionByName(count)
    )
