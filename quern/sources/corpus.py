"""Reading and publishing corpora: chunks as JSON or Parquet, their meta rows, and guards before publishing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType

EMBEDDER = "sentence-transformers/all-MiniLM-L6-v2"
ENVELOPE = "version int, embedder string, embedding_dim int, chunks array<struct<id: string, url: string, title: string, section: string, category: string, source_product: string, source_version: string, source_page: int, source_url: string, text: string, embedding: array<double>>>"
# What a build must have before it replaces a published one.
SITE_GUARD = {"pages": 20, "chunks": 100}
SOURCES_GUARD = {"sources": 8, "chunks": 500}
META_KEYS = ("built_at", "pages_crawled", "source_host")


class CorpusError(ValueError):
    """A corpus that cannot be served: no chunks, or another embedder's vectors."""


class PublishError(ValueError):
    """A build that is too small to replace the published one."""


def read_envelope(spark: SparkSession, path: str, embedder: str | None = EMBEDDER) -> DataFrame:
    """Chunks, with pos, of a corpus in one JSON document. CorpusError if it has no chunks or another embedder."""
    rows = spark.read.schema(ENVELOPE).json(path, multiLine=True)
    head = rows.select("embedder", F.size("chunks").alias("n")).first()
    if head is None or (head["n"] or 0) <= 0:
        raise CorpusError("the corpus has no chunks")
    check_embedder(head["embedder"], embedder)
    return rows.select(F.posexplode("chunks").alias("pos", "c")).select(F.col("pos").cast("long").alias("pos"), "c.*")


def check_embedder(found: str | None, wanted: str | None) -> None:
    if wanted is not None and found != wanted:
        raise CorpusError(f"the corpus was embedded by {found!r}, not {wanted!r}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_meta(spark: SparkSession, path: str) -> dict:
    """The known keys of a meta document, with the types that they have in it; empty if it is absent or no JSON object."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as e:  # the reader's own error for a path that is absent; anything else is raised
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    try:
        found = json.loads(row["value"]) if row else {}
    except ValueError:
        return {}
    return {k: found[k] for k in META_KEYS if k in found} if isinstance(found, dict) else {}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def sitemap_locations(xml: DataFrame, value: str = "value") -> DataFrame:
    """(source, locations): of each sitemap its loc elements' texts, of any namespace, in order; null where it is no XML document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                try:
                    found = ElementTree.fromstring(text or "").iter()
                    out.append([(e.text or "").strip() for e in found if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "loc"])
                except (ElementTree.ParseError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(out, pa.list_(pa.string()))], names=["source", "locations"])

    return xml.select(F.xxhash64(value).alias("source"), F.col(value).alias("text")).mapInArrow(run, "source long, locations array<string>")


def sitemap_urls(xml: DataFrame, host: str, keep: Column | None = None) -> DataFrame:
    """Distinct, sorted URLs of the loc elements of sitemaps (value), of one host, without fragments; documents that are no XML give none."""
    urls = sitemap_locations(xml).select(F.explode("locations").alias("url")).select(F.regexp_replace("url", "(?s)#.*$", "").alias("url"))
    urls = urls.filter(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1) == host)
    return (urls if keep is None else urls.filter(keep)).distinct().orderBy("url")


def fetched(spark: SparkSession, path: str) -> DataFrame:
    """(key, body, modified) of a fetch cache: files named by the key of their URL."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([0-9a-f]{16})[^/]*$", 1).alias("key"), F.col("content").alias("body"), F.col("modificationTime").alias("modified"))


def to_fetch(wanted: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """The rows of ``wanted`` that the cache (key, body) has no sound entry for: absent, empty, or a page that is no text in UTF-8."""
    sound = F.coalesce(F.octet_length("body") > 0, F.lit(False)) & (F.substring("body", 1, 5).eqNullSafe(F.lit(b"%PDF-")) | F.is_valid_utf8(F.col("body").cast("string")))
    return wanted.withColumn("__key", key).join(cache.filter(sound).select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def pdf_pages(files: DataFrame, reader: Callable[[bytes], Iterable[tuple[int, str]]]) -> DataFrame:
    """(path, page_num, text, error) of PDF files (path, content), by a reader that gives (page number, text) of one file's bytes.

    No PDF library is needed here: the caller brings one. A file that the reader fails on gives one row with its error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, error = [], None
                try:
                    rows = [(path, n, text, None) for n, text in reader(content or b"")]
                except Exception as e:  # whatever the caller's reader raises is the file's fault, and spoils no other file
                    error = f"{type(e).__name__}: {e}"
                rows += [(path, None, None, error)] if error else []
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page_num", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_num int, text string, error string")


def fingerprint(chunks: DataFrame) -> DataFrame:
    """(chunk_count, corpus_bytes, corpus_sha256): the same for the same chunks in the same order, whatever the files are.

    Each chunk is digested where it is; what is put in order and digested again are the digests, by 1,000s of pos.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(chunks.columns)]))
    each = chunks.select("pos", F.octet_length(line).alias("bytes"), F.sha2(line, 256).alias("digest"))
    joined = lambda by, what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what]), ""), 256)
    parts = each.groupBy(F.floor(F.col("pos") / 1000).alias("part")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), joined("pos", "digest").alias("digest"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("corpus_bytes"), joined("part", "digest").alias("corpus_sha256"))


def meta(chunks: DataFrame, **facts: object) -> DataFrame:
    """One row: the facts, when it was built, and the fingerprint of the chunks."""
    return fingerprint(chunks).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("built_at"), *[F.lit(v).alias(k) for k, v in facts.items()], "*")


def guard(counts: dict[str, int], least: dict[str, int]) -> None:
    """PublishError if any count is below what is asked for."""
    short = [f"{k}: {counts.get(k, 0)} of {n}" for k, n in least.items() if counts.get(k, 0) < n]
    if short:
        raise PublishError("too few " + ", ".join(short))


def shortfalls(counts: DataFrame, least: dict[str, int]) -> DataFrame:
    """(what, found, least, enough) of one row of counts: the guard as a table."""
    rows = [F.struct(F.lit(k).alias("what"), F.col(k).cast("long").alias("found"), F.lit(n).cast("long").alias("least")) for k, n in least.items()]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*", (F.col("x.found") >= F.col("x.least")).alias("enough"))


def publish(chunks: DataFrame, path: str, counts: dict[str, int], least: dict[str, int]) -> None:
    """Replaces the corpus at ``path``, in the order of pos, unless the build is too small."""
    guard(counts | {"chunks": chunks.count()}, least)
    chunks.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)


def append_missing(rows: DataFrame, existing: DataFrame | None, keys: Iterable[str]) -> DataFrame:
    """The rows whose keys are not there yet, so that what people have edited is kept."""
    return rows if existing is None else rows.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def _json(value: Column, kind: DataType) -> Column:
    """A value as JSON; numbers from 0.000001 on are written out, where the writer would give those under 0.001 an exponent."""
    plain = F.to_json(F.array(value))
    plain = F.substring(plain, F.lit(2), F.length(plain) - 2)
    if not isinstance(kind, DoubleType):
        return plain
    return F.when(F.abs(value).between(1e-6, 1e-3), F.regexp_replace(value.cast("decimal(38,24)").cast("string"), "0+$", "")).otherwise(plain)


def _json_object(fields: dict[str, tuple[Column, DataType]]) -> Column:
    """The fields that are not null, in order."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(c.isNotNull(), F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), _json(c, t))) for k, (c, t) in fields.items()]), F.lit("}"))


def response(results: DataFrame, facts: dict) -> DataFrame:
    """(query_id, response): JSON with the query, its results in order and the corpus's facts; absent values are left out."""
    kinds = {f.name: f.dataType for f in results.schema if f.name not in ("query_id", "query")}
    grouped = results.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in kinds]))).alias("results"))
    listed = F.array_join(F.transform("results", lambda x: _json_object({c: (x[c], t) for c, t in kinds.items()})), ",")
    kept = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in facts.items()]) if facts else F.create_map())
    query = F.when(F.col("query").isNotNull(), F.concat(F.lit('"query":'), _json(F.col("query"), results.schema["query"].dataType), F.lit(","))).otherwise("")
    return grouped.select("query_id", F.concat(F.lit("{"), query, F.lit('"results":['), listed, F.lit('],"corpus_meta":'), kept, F.lit("}")).alias("response"))
