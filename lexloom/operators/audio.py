"""Recordings: references, facts, dictionaries of licences and authors, chunks and digests."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import digest, text
from lexloom.operators.order import dense_ordinals, stream_digests
from lexloom.tables import broadcast_if_small, files

#: Bounds of what is served, and how many redirects a title may take.
MAX_RECORDING_BYTES, MAX_SOURCE_SECONDS, MAX_ALIASES = 1024 * 1024, 60, 4


def references(sounds: DataFrame) -> DataFrame:
    """(file_name, authored, n): how often each recording is referred to; file_name is null for values that name no file, counted by value.

    sounds: audio. Null values don't count.
    """
    named = sounds.where("audio is not null").select("audio", text.commons_file_name(F.col("audio")).alias("file_name"))
    return named.select("file_name", F.when(F.col("file_name").isNull(), F.col("audio")).alias("authored")).groupBy("file_name", "authored").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key, the latest one; equal rows and ties resolve to one."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(by), F.xxhash64(*columns))).alias("x"))
    return best.select(key, "x.*")


def with_authors(recordings: DataFrame, authors: DataFrame) -> DataFrame:
    """Recordings with their author's text and links, null where unresolved. Repeated author rows join once."""
    known = authors.groupBy("author_ordinal").agg(F.max("author_text").alias("author_text"), F.max("author_urls_json").alias("author_urls_json"))
    # A third of all recordings may have one author: the authors' side is broadcast where it is small, and adaptive execution splits the rest.
    return recordings.join(broadcast_if_small(known), "author_ordinal", "left")


def dictionary(rows: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """Distinct values with dense ordinals from 0, in order; rows that are null in all columns are left out."""
    kept = rows.select(*columns).where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()).distinct()
    return dense_ordinals(kept, [F.col(c).asc_nulls_first() for c in columns], ordinal).withColumn(ordinal, F.col(ordinal).cast("int"))


def encoded(rows: DataFrame, words: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """Replaces the columns by their ordinal; nulls are equal to nulls."""
    w = broadcast_if_small(words.select(*[F.col(c).alias(f"__{c}") for c in columns], ordinal))
    match = F.lit(True)
    for c in columns:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(w, match, "left").drop(*columns, *[f"__{c}" for c in columns])


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of files from the API's pages. pages: page (JSON text). A missing page, or one without an image, has null facts."""
    p = F.try_parse_json("page").alias("p")
    get = lambda path, kind="string": F.try_variant_get("p", path, kind)
    meta = lambda name: get(f"$.imageinfo[0].extmetadata.{name}.value")
    return pages.select(p).select(
        get("$.title").alias("source_title"), get("$.imageinfo[0].sha1").alias("source_sha1"), get("$.imageinfo[0].timestamp").alias("source_timestamp"), get("$.imageinfo[0].size", "long").alias("source_size_bytes"),
        get("$.imageinfo[0].mime").alias("source_media_type"), F.substring_index(get("$.imageinfo[0].descriptionurl"), "?", 1).alias("description_url"), F.substring_index(get("$.imageinfo[0].url"), "?", 1).alias("original_url"),
        meta("LicenseShortName").alias("license_short_name"), meta("License").alias("license_identifier"), meta("LicenseUrl").alias("license_url"), meta("Restrictions").alias("restrictions"), meta("Artist").alias("artist_html"),
        F.lower(meta("AttributionRequired")).try_cast("boolean").alias("attribution_required"),
    )


def resolve_aliases(titles: DataFrame, aliases: DataFrame, hops: int = MAX_ALIASES) -> DataFrame:
    """(title, resolved): follows source to target at most ``hops`` times. aliases: source, target, one target each."""
    known = broadcast_if_small(aliases.groupBy("source").agg(F.max("target").alias("target")))
    out = titles.select("title", F.col("title").alias("resolved"))
    for _ in range(hops):
        out = out.join(known, out.resolved == F.col("source"), "left").select("title", F.coalesce("target", "resolved").alias("resolved"))
    return out


def chunked(blobs: DataFrame, chunks: int) -> DataFrame:
    """One row per chunk and content. blobs: file_name, sha256, size_bytes; the same content counts once in a chunk, with the largest size given."""
    return blobs.withColumn("chunk", digest.chunk_for(F.col("file_name"), chunks)).where("sha256 is not null").groupBy("chunk", "sha256").agg(F.max("size_bytes").alias("size_bytes"))


def chunk_totals(distinct_blobs: DataFrame) -> DataFrame:
    return distinct_blobs.groupBy("chunk").agg(F.count(F.lit(1)).alias("blob_count"), F.sum("size_bytes").alias("blob_bytes"))


def compact(recordings: DataFrame) -> DataFrame:
    """Title and page URL only where they differ from what the file name gives."""
    title = text.commons_title(F.col("file_name"))
    url = text.description_url(F.coalesce("source_title", title))
    return recordings.select(*[c for c in recordings.columns if c not in ("source_title", "description_url")], F.nullif("source_title", title).alias("source_title"), F.nullif("description_url", url).alias("description_url"))


def restored(recordings: DataFrame) -> DataFrame:
    """The inverse of compact, for recordings whose digest is known."""
    title = F.when(F.col("source_sha1").isNotNull(), F.coalesce("source_title", text.commons_title(F.col("file_name")))).otherwise(F.col("source_title"))
    url = F.when(F.col("source_sha1").isNotNull(), F.coalesce("description_url", text.description_url(title))).otherwise(F.col("description_url"))
    return recordings.withColumn("description_url", url).withColumn("source_title", title)


def input_digest(recordings: DataFrame, columns: dict[str, Column], collection: str) -> DataFrame:
    """(collection, digest, n_records): over all recordings' facts in the order of their file names."""
    rows = recordings.select(F.col(collection), F.col("file_name").cast("binary").alias("__o"), digest.recording_facts(columns).alias("__f"))
    return stream_digests(rows, [collection], "__o", digest.RECORDING_INPUTS, F.col("__f"))


def opus_milliseconds(data: bytes | None) -> int | None:
    """The length of an Ogg Opus stream: last granule less the pre-skip, at 48 kHz, rounded up. None if it isn't one complete stream."""
    if not data:
        return None
    at, serial, skip, granule, ended, first = 0, None, None, None, False, True
    while at < len(data):
        if ended or len(data) - at < 27 or data[at : at + 4] != b"OggS" or data[at + 4] != 0:
            return None
        flags, position = data[at + 5], int.from_bytes(data[at + 6 : at + 14], "little", signed=True)
        here = data[at + 14 : at + 18]
        table = data[at + 27 : at + 27 + data[at + 26]]
        if len(table) != data[at + 26] or serial not in (None, here):
            return None
        body = at + 27 + len(table)
        if body + sum(table) > len(data):
            return None
        if first:
            head = data[body : body + sum(table)]
            if not flags & 2 or len(head) < 19 or head[:8] != b"OpusHead":
                return None
            skip = int.from_bytes(head[10:12], "little")
        serial, first = here, False
        if position >= 0:
            granule = position
        ended = bool(flags & 4)
        at = body + sum(table)
    if not ended or granule is None or skip is None or granule < skip:
        return None
    return -(-(granule - skip) // 48)


@F.pandas_udf(T.LongType())
def opus_duration(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([opus_milliseconds(None if b is None else bytes(b)) for b in batch], dtype="Int64")


def audio_read_errors(recordings: DataFrame) -> DataFrame:
    """(file_name, error) of blobs that can't be served: missing, too large, of another size or digest."""
    error = (
        F.when(F.col("bytes").isNull(), "missing blob")
        .when(F.octet_length("bytes") > MAX_RECORDING_BYTES, "too large")
        .when(F.octet_length("bytes") != F.col("size_bytes"), "size differs")
        .when(F.sha2("bytes", 256) != F.col("sha256"), "digest differs")
    )
    return recordings.select("file_name", error.alias("error")).where("error is not null")


COLLECTION = ["recordings", "licenses", "authors", "chunks", "collection"]


def build_collection(recordings: DataFrame, out: str, meta: dict[str, str], chunks: int) -> str:
    """Writes a collection's tables at ``out``, which must not exist, and returns its revision. Tables are moved there in one step; nothing stays if it fails.

    recordings: file_name (distinct), status, reason, reference_count, source_title, source_sha1, source_timestamp,
    source_media_type, source_size_bytes, description_url, license_short_name, license_identifier, license_url,
    author_text, author_urls, attribution_required, blob_sha256, blob_size_bytes. meta: pack_id,
    corpus_language, source_corpus_pack_id, source_corpus_revision, acquired_at, delivery,
    builder_revision, minimum_app_version, encoder_profile, format_version.
    """
    fs, here = files(recordings.sparkSession, out)
    if fs.exists(here(out)):
        raise FileExistsError(out)
    staging = f"{out}.staging-{uuid.uuid4().hex}"
    try:
        revision = _write_collection(recordings, staging, meta, chunks)
        if not fs.rename(here(staging), here(out)):
            raise OSError(f"could not publish {out}")
        return revision
    finally:
        if fs.exists(here(staging)):
            fs.delete(here(staging), True)


def _write_collection(recordings: DataFrame, out: str, meta: dict[str, str], chunks: int) -> str:
    spark = recordings.sparkSession
    licence, author = ["license_short_name", "license_identifier", "license_url"], ["author_text", "author_urls_json"]
    rows = recordings.withColumn("author_text", F.nullif("author_text", F.lit(""))).withColumn("chunk", digest.chunk_for(F.col("file_name"), chunks)).withColumn("all", F.lit(0))
    found = input_digest(rows, {c: F.col(c) for c in rows.columns}, "all").first()
    inputs = found.digest if found else hashlib.sha256(len(digest.RECORDING_INPUTS).to_bytes(8, "big") + digest.RECORDING_INPUTS.encode()).hexdigest()
    row = spark.createDataFrame([{k: str(v) for k, v in meta.items()} | {"chunk_count": chunks, "recording_input_digest": inputs}])
    revision = row.select(digest.audio_revision({c: F.col(c) for c in row.columns}, F.col("format_version"), F.col("encoder_profile"))).first()[0]
    flat = rows.withColumn("author_urls_json", F.when(F.size("author_urls") > 0, F.to_json("author_urls"))).drop("author_urls", "all")
    licences, authors = dictionary(flat, licence, "license_ordinal"), dictionary(flat, author, "author_ordinal")
    licences.write.parquet(f"{out}/licenses")
    authors.write.parquet(f"{out}/authors")
    coded = encoded(encoded(compact(flat), licences, licence, "license_ordinal"), authors, author, "author_ordinal")
    coded.repartition("chunk").sortWithinPartitions("chunk", "file_name").write.partitionBy("chunk").parquet(f"{out}/recordings")
    blobs = flat.where("status = 1 and blob_sha256 is not null").select("file_name", F.col("blob_sha256").alias("sha256"), F.col("blob_size_bytes").alias("size_bytes"))
    chunk_totals(chunked(blobs, chunks)).write.parquet(f"{out}/chunks")
    row.withColumn("revision", F.lit(revision)).write.parquet(f"{out}/collection")
    return revision


def open_collection(spark: SparkSession, path: str, expected: str | None = None) -> dict[str, DataFrame]:
    """The tables of a collection; recordings come with licence, author and derived facts restored."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in COLLECTION}
    if expected is not None and [r.revision for r in tables["collection"].collect()] != [expected]:
        raise ValueError("unexpected revision")
    joined = tables["recordings"].join(broadcast_if_small(tables["licenses"]), "license_ordinal", "left").join(broadcast_if_small(tables["authors"]), "author_ordinal", "left")
    return tables | {"recordings": restored(joined).withColumn("author_urls", F.from_json("author_urls_json", "array<string>")).drop("author_urls_json")}


def collection_errors(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, n_bad): chunk assignment, statuses with and without reasons, unknown ordinals, chunk totals, repeated names."""
    n = tables["collection"].first().chunk_count
    rows = tables["recordings"]
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
    blobs = rows.where("status = 1 and blob_sha256 is not null").select("file_name", F.col("blob_sha256").alias("sha256"), F.col("blob_size_bytes").alias("size_bytes"))
    counted = chunk_totals(chunked(blobs, n))
    return (
        one("chunk", rows.where(digest.chunk_for(F.col("file_name"), n) != F.col("chunk")))
        .unionByName(one("status", rows.where(~F.col("status").between(1, 4) | ((F.col("status") == 1) != F.col("reason").isNull()))))
        .unionByName(one("license", rows.where("license_ordinal is not null and coalesce(license_short_name, license_identifier, license_url) is null")))
        .unionByName(one("author", rows.where("author_ordinal is not null and coalesce(author_text, cast(author_urls as string)) is null")))
        .unionByName(one("chunk_totals", counted.exceptAll(tables["chunks"].select(*counted.columns)).unionByName(tables["chunks"].select(*counted.columns).exceptAll(counted))))
        .unionByName(one("digest", rows.where("(blob_sha256 is not null and not rlike(blob_sha256, '^([0-9a-f]{2})+$')) or (status = 1) <> (blob_sha256 is not null)")))
        .unionByName(one("size", rows.where((F.col("blob_size_bytes") > MAX_RECORDING_BYTES) | (F.col("blob_size_bytes") <= 0))))
        .unionByName(one("delivery", tables["collection"].where("coalesce(delivery, '') not in ('remote', 'bundled')")))
        .unionByName(one("repeated_names", rows.groupBy("file_name").count().where("count > 1")))
    )


def reference_lines(references_found: DataFrame) -> Iterator[str]:
    """The references as JSON, a line at a time: names with counts and invalid values with counts, both in byte order. Sorted by the executors; the driver holds one partition."""
    yield '{\n  "schema_version": 1'
    for name, column in (("files", "file_name"), ("invalid", "authored")):
        yield f',\n  "{name}": ['
        rows = references_found.where(F.col(column).isNotNull() if name == "files" else F.col("file_name").isNull()).orderBy(F.col(column).cast("binary")).select(column, "n")
        for i, r in enumerate(rows.toLocalIterator()):
            yield f"{',' * (i > 0)}\n    {json.dumps([r[0], r.n], ensure_ascii=False)}"
        yield "\n  ]"
    yield "\n}\n"


def reference_set(references_found: DataFrame) -> str:
    """The whole of reference_lines, for sets that fit in one text."""
    return "".join(reference_lines(references_found))


def write_reference_set(references_found: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(reference_lines(references_found))
