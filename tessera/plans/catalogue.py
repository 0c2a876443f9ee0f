"""Registered queries over the archive tables, each with the SQL that gives the same rows.

The main archive holds the documents as ``lang/source/doc_id.txt`` with their folders. A second one is
derived from it with the labels: low-quality documents are gone, toxic ones have a line more, and
those of one source have moved. Redaction and multi-file requests name files by their labels too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fmt, paths, udfs
from ..functions.enums import EntryFlag
from ..operators import archive as ar
from ..operators import content, diffing, listing, minhash, names, vectors
from ..operators.ordering import in_order
from ..operators.work import keep
from . import kernel_sql

BLOCK = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPTIONS = ar.WriteOptions(codec="none", block_size=BLOCK)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entries(spark, sf) -> DataFrame:
    return ar.entries_of_documents(table(spark, sf, "documents"))


def unordered(spark, sf) -> DataFrame:
    """Files without ``file_id``, for what needs no order."""
    return ar.storable(entries(spark, sf))


def files(spark, sf) -> DataFrame:
    return ar.number_files(entries(spark, sf))


def digested(spark, sf) -> DataFrame:
    """Numbered files with digests in place of the content, which stays out of the sort."""
    e = unordered(spark, sf).withColumns({"md5": F.md5("content"), "sha256": F.sha2("content", 256)}).drop("content")
    return in_order(e, ["name"], "file_id")


def hashed(spark, sf) -> DataFrame:
    f = unordered(spark, sf)
    return f.withColumn("hash", F.when(F.col("entry_type") == "file", F.unhex(F.sha2("content", 256)))).withColumn("entry_flags", F.lit(0))


def planned(spark, sf) -> DataFrame:
    return ar.plan_blocks(files(spark, sf).withColumn("canonical_id", F.col("file_id")), OPTIONS)


def chunked(spark, sf) -> DataFrame:
    return ar.chunks(planned(spark, sf), OPTIONS)


def deduped(spark, sf) -> DataFrame:
    return ar.canonical_files(digested(spark, sf).drop("md5").withColumnRenamed("sha256", "digest"))


def shared_spans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Files and spans of the deduplicated archive."""
    f = keep(deduped(spark, sf), "files")
    spans = ar.spans_of(f, ar.chunks(ar.plan_blocks(f, OPTIONS), OPTIONS))
    return f.withColumn("entry_flags", F.lit(int(EntryFlag.STRONG_HASH))).withColumn("hash", F.col("digest")), spans


def labelled(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    return table(spark, sf, "documents").join(lab, "doc_id", "left")


def second_archive(spark, sf) -> DataFrame:
    """(name, entry_type, logical_size, hash) of the later state of the main archive."""
    d = labelled(spark, sf).filter("coalesce(quality, 1) <> 0")
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("\nrevised"))).otherwise(F.col("text"))
    source = F.when(F.col("source") == "src7", "moved").otherwise(F.col("source"))
    e = ar.entries_of_documents(d.select("doc_id", "lang", source.alias("source"), text.alias("text")))
    return e.withColumn("logical_size", F.octet_length("content").cast("long")).withColumn("hash", F.when(F.col("entry_type") == "file", F.unhex(F.sha2("content", 256))))


def toxic_names(spark, sf) -> DataFrame:
    return labelled(spark, sf).filter("toxic = 1").select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"))


def wanted(spark, sf) -> DataFrame:
    """(pos, name): low-quality documents, and names of benchmark items that no archive has."""
    low = labelled(spark, sf).filter("quality = 0").select(F.col("doc_id").alias("pos"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("name"))
    lost = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("pos"), F.concat(F.lit("lost/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"))
    return low.unionByName(lost)


# --- SQL building blocks

_FILES = """
ent AS (
  SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, 'file' AS entry_type, octet_length(encode(coalesce(text, ''))) AS logical_size,
         CAST(33188 AS BIGINT) AS mode, 1700000000 + doc_id AS mtime, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT DISTINCT lang || '/' || source, 'dir', 0, 16877, 1700000000, '' FROM documents
  UNION ALL SELECT DISTINCT lang, 'dir', 0, 16877, 1700000000, '' FROM documents),
files AS (SELECT row_number() OVER (ORDER BY name) - 1 AS file_id, * FROM ent)"""
_CHUNKS = f"""
sized AS (SELECT file_id, logical_size, greatest(CAST(ceil(logical_size / {BLOCK}.0) AS BIGINT), 1) AS n FROM files WHERE entry_type = 'file'),
flat AS (SELECT file_id, logical_size, unnest(range(n)) AS seq FROM sized),
chunks AS (SELECT file_id, seq, row_number() OVER (ORDER BY file_id, seq) - 1 AS block_id, least({BLOCK}, logical_size - seq * {BLOCK}) AS raw_size FROM flat)"""
_DEDUP = f"""
dig AS (SELECT *, sha256(text) AS h FROM files),
one AS (SELECT h, min(file_id) AS fid, arg_min(logical_size, file_id) AS fsize FROM dig WHERE entry_type = 'file' AND logical_size > 0 GROUP BY h),
dd AS (SELECT d.*, CASE WHEN d.entry_type = 'file' AND d.logical_size > 0 AND one.fsize = d.logical_size THEN one.fid ELSE d.file_id END AS canonical_id FROM dig d LEFT JOIN one ON d.h = one.h),
csz AS (SELECT file_id, logical_size, greatest(CAST(ceil(logical_size / {BLOCK}.0) AS BIGINT), 1) AS n FROM dd WHERE entry_type = 'file' AND canonical_id = file_id),
cfl AS (SELECT file_id, logical_size, unnest(range(n)) AS seq FROM csz),
cch AS (SELECT file_id AS canonical_id, seq, row_number() OVER (ORDER BY file_id, seq) - 1 AS block_id, least({BLOCK}, logical_size - seq * {BLOCK}) AS raw_size FROM cfl),
spans AS (SELECT dd.file_id, dd.name, cch.seq, cch.block_id, cch.raw_size FROM dd JOIN cch ON dd.canonical_id = cch.canonical_id WHERE dd.entry_type = 'file')"""
_LAB = """
lab AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
ld AS (SELECT d.*, lab.quality, lab.toxic, lang || '/' || source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS name FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id)"""
_SECOND = f"""{_LAB},
sd AS (SELECT lang, CASE WHEN source = 'src7' THEN 'moved' ELSE source END AS source, doc_id, CASE WHEN toxic = 1 THEN coalesce(text, '') || chr(10) || 'revised' ELSE coalesce(text, '') END AS text FROM ld WHERE coalesce(quality, 1) <> 0),
second AS (
  SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, octet_length(encode(text)) AS logical_size, sha256(text) AS hash FROM sd
  UNION ALL SELECT DISTINCT lang || '/' || source, 0, NULL FROM sd
  UNION ALL SELECT DISTINCT lang, 0, NULL FROM sd)"""


def _diff(old_hash: str, new_hash: str, changed: str) -> str:
    return f"""
o AS (SELECT name AS path, logical_size AS old_size, {old_hash} AS old_hash, true AS a FROM files),
w AS (SELECT name AS path, logical_size AS new_size, {new_hash} AS new_hash, true AS b FROM second),
diff AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' WHEN old_size <> new_size OR {changed} THEN 'modified' ELSE 'unchanged' END AS status,
  old_size, new_size, old_hash, new_hash FROM o FULL OUTER JOIN w ON o.path = w.path)"""


_HASH = "CASE WHEN entry_type = 'file' THEN sha256(text) END"
_STRICT, _LENIENT = "coalesce(old_hash, '') <> coalesce(new_hash, '')", "coalesce(old_hash <> new_hash, false)"
_DIFF = f"WITH {_FILES}, {_SECOND}, {_diff(_HASH, 'hash', _STRICT)}"


def sql_bytes(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""CASE WHEN {v} < 1024 THEN printf('%.2f B', {v}) WHEN {v} / 1024.0 < 1024 THEN printf('%.2f KB', {v} / 1024.0) WHEN {v} / 1048576.0 < 1024 THEN printf('%.2f MB', {v} / 1048576.0)
 WHEN {v} / 1073741824.0 < 1024 THEN printf('%.2f GB', {v} / 1073741824.0) ELSE printf('%.2f TB', {v} / 1099511627776.0) END"""


# --- listings


@query(f"WITH {_FILES} SELECT file_id, name, entry_type, logical_size, CASE entry_type WHEN 'dir' THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode_text FROM files")
def list_entries(spark, sf):
    return listing.list_entries(files(spark, sf))


@query(f"WITH {_FILES} SELECT file_id, CASE WHEN entry_type = 'dir' THEN name || '/' ELSE name END AS line FROM files")
def list_plain_dirs(spark, sf):
    return listing.list_plain(files(spark, sf))


@query(f"""WITH {_FILES} SELECT file_id, CASE entry_type WHEN 'dir' THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END || '     0     0 ' || lpad(CAST(logical_size AS VARCHAR), 12, ' ') || ' ' || strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || ' ' || name AS line FROM files""")
def list_table_mode(spark, sf):
    return listing.list_table(files(spark, sf).withColumns({"uid": F.lit(0), "gid": F.lit(0)}))


@query(f"""WITH {_FILES} SELECT file_id, '{{"name":"' || name || '","type":"' || entry_type || '","size":' || CAST(logical_size AS VARCHAR) || '}}' AS line FROM files""")
def list_json(spark, sf):
    return listing.list_json(files(spark, sf))


@query(f"WITH {_FILES} SELECT count(*) AS n_entries, CAST(sum(logical_size) AS BIGINT) AS total_size FROM files")
def list_totals(spark, sf):
    return listing.totals(unordered(spark, sf))


@query(f"WITH {_FILES} SELECT entry_type, count(*) AS n_entries, CAST(sum(logical_size) AS BIGINT) AS total_size FROM files GROUP BY entry_type")
def entry_type_counts(spark, sf):
    return listing.by_type(unordered(spark, sf))


@query(f"WITH {_FILES}, {_CHUNKS} SELECT (SELECT count(*) FROM files) AS n_files, 'directory-based' AS layout, count(*) AS n_blocks, max(block_id) AS max_block_id, CAST(sum(raw_size) AS BIGINT) AS raw_size FROM chunks")
def header_summary(spark, sf):
    f = files(spark, sf)
    c = chunked(spark, sf)
    at = ar.ArchiveTables(f, c, c.withColumn("stored_size", F.col("raw_size")))
    return listing.header_summary(at).drop("stored_size")


@query(f"WITH {_FILES} SELECT CAST(length(name) - length(replace(name, '/', '')) + 1 AS BIGINT) AS depth, count(*) AS n_entries FROM files GROUP BY 1")
def path_depth_hist(spark, sf):
    return listing.depth_histogram(unordered(spark, sf))


@query("""WITH d AS (SELECT lang, source, octet_length(encode(coalesce(text, ''))) AS s FROM documents)
SELECT lang AS directory, count(*) AS n_files, CAST(sum(s) AS BIGINT) AS total_size FROM d GROUP BY lang UNION ALL SELECT lang || '/' || source, count(*), CAST(sum(s) AS BIGINT) FROM d GROUP BY lang, source""")
def dir_rollup_sizes(spark, sf):
    return listing.directory_sizes(unordered(spark, sf))


@query(f"WITH {_FILES} SELECT file_id, {sql_bytes('logical_size')} AS size_text, CASE WHEN logical_size >= 1000000 THEN CAST(logical_size // 1000000 AS VARCHAR) || 'M' WHEN logical_size >= 1000 THEN CAST(logical_size // 1000 AS VARCHAR) || 'K' ELSE CAST(logical_size AS VARCHAR) END AS count_text FROM files")
def size_formats(spark, sf):
    return files(spark, sf).select("file_id", fmt.format_bytes(F.col("logical_size")).alias("size_text"), fmt.format_count(F.col("logical_size")).alias("count_text"))


# --- lookup and paths


def _joined(alias: str) -> str:
    return f"SELECT ld.doc_id AS pos, {alias} FROM ld JOIN files USING (name) WHERE quality = 0"


@query(f"WITH {_FILES}, {_LAB} {_joined('file_id, name, files.entry_type, files.logical_size')}")
def get_many(spark, sf):
    return content.find(files(spark, sf), wanted(spark, sf)).select("pos", "file_id", "name", "entry_type", "logical_size")


@query(f"WITH {_FILES} SELECT file_id, name, md5(text) AS md5 FROM files WHERE name = (SELECT min(name) FROM files WHERE entry_type = 'file')")
def get_by_name(spark, sf):
    least = unordered(spark, sf).filter("entry_type = 'file'").agg(F.min("name").alias("name")).withColumn("pos", F.lit(0))
    return content.find(digested(spark, sf), least).select("file_id", "name", "md5")


@query("SELECT -1 - item_id AS pos, 'lost/' || CAST(item_id AS VARCHAR) || '.txt' AS name FROM benchmark")
def find_missing(spark, sf):
    return content.missing(unordered(spark, sf), wanted(spark, sf))


@query(f"WITH {_FILES} SELECT file_id, regexp_replace(name, '^[^/]*/', '') AS stripped FROM files WHERE contains(name, '/')")
def strip_components_1(spark, sf):
    return files(spark, sf).select("file_id", paths.strip_components(F.col("name"), 1).alias("stripped")).filter("stripped IS NOT NULL")


@query(f"WITH {_FILES} SELECT file_id, regexp_replace(name, '^[^/]*/[^/]*/', '') AS stripped FROM files WHERE regexp_matches(name, '^[^/]*/[^/]*/.')")
def strip_components_2(spark, sf):
    return files(spark, sf).select("file_id", paths.strip_components(F.col("name"), 2).alias("stripped")).filter("stripped IS NOT NULL")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '#' || CAST(page_id AS VARCHAR) AS name FROM pages)
SELECT page_id, len(list_filter(string_split(name, '/'), lambda s: s <> '')) AS n_segments, NOT (starts_with(name, '/') OR list_contains(string_split(name, '/'), '..')) AS safe FROM p""")
def page_segments(spark, sf):
    p = table(spark, sf, "pages")
    name = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("#"), F.col("page_id").cast("string"))
    return p.select("page_id", F.size(paths.segments(name)).cast("long").alias("n_segments"), paths.is_safe(name).alias("safe"))


# --- blocks


@query(f"WITH {_FILES}, {_CHUNKS} SELECT file_id, seq AS sequence_order, block_id, seq * {BLOCK} AS \"offset\", raw_size FROM chunks")
def block_chunks(spark, sf):
    return chunked(spark, sf).withColumn("sequence_order", F.col("sequence_order").cast("long"))


@query(f"""WITH {_FILES}, {_CHUNKS}, n AS (SELECT f.file_id, count(c.seq) AS span_count FROM files f LEFT JOIN chunks c ON f.file_id = c.file_id GROUP BY f.file_id)
SELECT file_id, CAST(coalesce(sum(span_count) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start, span_count FROM n""")
def spans_csr(spark, sf):
    return names.csr(chunked(spark, sf), files(spark, sf))


@query(f"""WITH {_FILES}, {_CHUNKS} SELECT block_id, CAST(64 + coalesce(sum((raw_size + 32 + 63) // 64 * 64) OVER (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset, raw_size FROM chunks""")
def block_offsets(spark, sf):
    b = chunked(spark, sf).select("block_id", "raw_size", F.col("raw_size").alias("stored_size"), *[F.lit(None).alias(c) for c in ("comp_algo", "checksum_type", "checksum", "payload")])
    return ar.lay_out(b, OPTIONS).select("block_id", "block_offset", "raw_size")


@query(f"WITH {_FILES}, {_CHUNKS} SELECT f.file_id, coalesce(string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY block_id), '') AS block_ids FROM files f LEFT JOIN chunks c ON f.file_id = c.file_id AND c.raw_size > 0 GROUP BY f.file_id")
def file_block_ids(spark, sf):
    c = chunked(spark, sf).withColumn("length", F.col("raw_size"))
    at = ar.ArchiveTables(files(spark, sf), c, c)
    return content.file_block_ids(at).select("file_id", F.array_join("block_ids", ",").alias("block_ids"))


@query(f"WITH {_FILES} SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS block_index FROM files WHERE entry_type = 'file'")
def single_file_block_index(spark, sf):
    return listing.single_file_block_index(files(spark, sf))


@query(f"WITH {_FILES} SELECT file_id, md5(text) AS md5, logical_size AS size FROM files WHERE entry_type = 'file'")
def reassemble_md5(spark, sf):
    at = ar.build_archive(entries(spark, sf), ar.WriteOptions(codec="zstd", checksum="crc32c", block_size=BLOCK, dedup=True))
    return content.read_files(at).select("file_id", F.md5("content").alias("md5"), F.octet_length("content").cast("long").alias("size"))


@query(f"WITH {_FILES} SELECT file_id AS pos, name, CAST(coalesce(sum(logical_size) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", logical_size AS size FROM files WHERE entry_type = 'file'")
def cat_offsets(spark, sf):
    return content.cat_plan(files(spark, sf).withColumn("entry_flags", F.lit(0)))


@query(f"WITH {_FILES} SELECT file_id, md5(text) AS md5, sha256(text) AS sha256 FROM files WHERE entry_type = 'file'")
def content_digest(spark, sf):
    return digested(spark, sf).filter("entry_type = 'file'").select("file_id", "md5", "sha256")


# --- deduplication


@query(f"WITH {_FILES}, {_DEDUP} SELECT file_id, canonical_id, canonical_id <> file_id AS shared FROM dd")
def dedup_canonical(spark, sf):
    return deduped(spark, sf).select("file_id", "canonical_id", (F.col("canonical_id") != F.col("file_id")).alias("shared"))


@query(f"WITH {_FILES}, {_DEDUP} SELECT CAST(count_if(canonical_id <> file_id) AS BIGINT) AS n_shared, CAST(sum(CASE WHEN canonical_id <> file_id THEN logical_size ELSE 0 END) AS BIGINT) AS saved_bytes, CAST(sum(logical_size) AS BIGINT) AS total_bytes FROM dd")
def dedup_savings(spark, sf):
    shared = F.col("canonical_id") != F.col("file_id")
    return deduped(spark, sf).agg(F.count_if(shared).alias("n_shared"), F.sum(F.when(shared, F.col("logical_size")).otherwise(0)).alias("saved_bytes"), F.sum("logical_size").alias("total_bytes"))


@query(f"WITH {_FILES}, {_DEDUP} SELECT file_id, seq AS sequence_order, block_id, raw_size AS length FROM spans")
def dedup_spans(spark, sf):
    return shared_spans(spark, sf)[1].select("file_id", F.col("sequence_order").cast("long").alias("sequence_order"), "block_id", "length")


# --- comparison


def compared(spark, sf) -> DataFrame:
    return diffing.diff_files(hashed(spark, sf), second_archive(spark, sf))


@query(f"{_DIFF} SELECT path, status, CAST(old_size AS DOUBLE) AS old_size, CAST(new_size AS DOUBLE) AS new_size, old_hash, new_hash FROM diff")
def diff_files(spark, sf):
    return compared(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("old_size", "new_size")})


@query(f"{_DIFF} SELECT status, count(*) AS n_files, CAST(sum(CASE WHEN status = 'added' THEN new_size ELSE old_size END) AS BIGINT) AS n_bytes FROM diff GROUP BY status")
def diff_stats(spark, sf):
    return diffing.diff_stats(compared(spark, sf))


@query(f"{_DIFF} SELECT count(*) AS n_files, CAST(count_if(status <> 'unchanged') AS BIGINT) AS n_changed FROM diff")
def diff_total(spark, sf):
    return diffing.diff_total(compared(spark, sf))


@query(f"""{_DIFF} SELECT path, CASE status
 WHEN 'added' THEN 'A  ' || path || CASE WHEN new_size > 0 THEN ' (' || {sql_bytes('new_size')} || ')' ELSE '' END
 WHEN 'deleted' THEN 'D  ' || path || CASE WHEN old_size > 0 THEN ' (' || {sql_bytes('old_size')} || ')' ELSE '' END
 ELSE 'M  ' || path || ' (' || {sql_bytes('old_size')} || ' -> ' || {sql_bytes('new_size')} || ')' || CASE WHEN coalesce(old_hash <> new_hash, false) THEN ' [' || substr(old_hash, 1, 8) || ' -> ' || substr(new_hash, 1, 8) || ']' ELSE '' END END AS line
 FROM diff WHERE status <> 'unchanged'""")
def diff_delta_lines(spark, sf):
    return diffing.diff_lines(compared(spark, sf))


@query(f"WITH {_FILES}, {_SECOND}, {_diff('CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)', _STRICT)} SELECT path, status FROM diff")
def diff_no_hashes(spark, sf):
    none = F.lit(None).cast("binary")
    return diffing.diff_files(hashed(spark, sf).withColumn("hash", none), second_archive(spark, sf).withColumn("hash", none)).select("path", "status")


@query(f"""WITH {_FILES}, {_SECOND}, {_diff(_HASH, 'CAST(NULL AS VARCHAR)', _STRICT)}, d2 AS (SELECT path, CASE WHEN status = 'modified' AND old_size = new_size THEN 'unchanged' ELSE status END AS lenient, status FROM diff)
SELECT status AS strict, lenient, count(*) AS n_files FROM d2 GROUP BY ALL""")
def diff_one_side_hash(spark, sf):
    a, b = hashed(spark, sf), second_archive(spark, sf).withColumn("hash", F.lit(None).cast("binary"))
    strict, lenient = (diffing.diff_files(a, b, m).select("path", F.col("status").alias(n)) for m, n in (("modified", "strict"), ("unchanged", "lenient")))
    return strict.join(lenient, "path").groupBy("strict", "lenient").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {_FILES}, {_SECOND} SELECT name FROM second EXCEPT SELECT name FROM files")
def added_paths(spark, sf):
    return second_archive(spark, sf).select("name").join(unordered(spark, sf), "name", "left_anti").distinct()


@query(f"WITH {_FILES}, {_SECOND} SELECT name FROM files EXCEPT SELECT name FROM second")
def deleted_paths(spark, sf):
    return unordered(spark, sf).select("name").join(second_archive(spark, sf), "name", "left_anti").distinct()


@query(f"""WITH {_FILES}, {_SECOND}, old AS (SELECT sha256(text) AS h FROM files WHERE entry_type = 'file' GROUP BY 1)
SELECT CASE WHEN old.h IS NULL THEN 'add' ELSE 'keep' END AS action, count(*) AS n FROM second LEFT JOIN old ON second.hash = old.h WHERE second.hash IS NOT NULL GROUP BY 1""")
def block_delta(spark, sf):
    """Whole-file blocks that the later archive can keep or must add."""
    blocks = lambda e: e.filter("entry_type = 'file'").select(F.monotonically_increasing_id().alias("block_id"), F.col("content").alias("payload"))
    d = diffing.block_delta(blocks(entries(spark, sf)), blocks(second_archive(spark, sf)))
    return d.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# --- redaction and validation

_HIT = f"""{_LAB}, tox AS (SELECT name FROM ld WHERE toxic = 1), bb AS (SELECT DISTINCT block_id FROM spans WHERE name IN (SELECT name FROM tox)), hit AS (SELECT DISTINCT file_id FROM spans WHERE block_id IN (SELECT block_id FROM bb))"""


@query(f"WITH {_FILES}, {_DEDUP}, {_HIT} SELECT block_id FROM bb")
def redact_blocks(spark, sf):
    f, spans = shared_spans(spark, sf)
    return content.redacted_blocks(f, spans, toxic_names(spark, sf))


@query(f"WITH {_FILES}, {_DEDUP}, {_HIT} SELECT dd.file_id, CASE WHEN hit.file_id IS NULL THEN 2 ELSE 1 END AS entry_flags, CASE WHEN hit.file_id IS NULL THEN dd.h END AS hash FROM dd LEFT JOIN hit ON dd.file_id = hit.file_id")
def redact_result(spark, sf):
    f, spans = shared_spans(spark, sf)
    return content.redacted_files(f, spans, toxic_names(spark, sf)).select("file_id", "entry_flags", "hash")


@query(f"""WITH {_FILES}, {_DEDUP}, {_HIT} SELECT (SELECT count(*) FROM tox) AS n_requested, (SELECT count(*) FROM hit) AS n_affected, (SELECT count(*) FROM bb) AS n_blocks""")
def redact_affected(spark, sf):
    f, spans = shared_spans(spark, sf)
    t = toxic_names(spark, sf)
    flags = content.redacted_files(f, spans, t).agg(F.count_if(F.col("entry_flags") == 1).alias("n_affected"))
    return t.agg(F.count(F.lit(1)).alias("n_requested")).crossJoin(flags).crossJoin(content.redacted_blocks(f, spans, t).agg(F.count(F.lit(1)).alias("n_blocks")))  # one row each


def damaged(spark, sf) -> ar.ArchiveTables:
    """The blocks of an archive whose redacted files are skipped and whose short blocks carry a wrong checksum."""
    at = ar.build_archive(entries(spark, sf), ar.WriteOptions(codec="none", checksum="crc32c", block_size=BLOCK, dedup=True))
    broken = F.when((F.col("raw_size") > 0) & (F.col("raw_size") < 100), F.when(F.col("checksum") == 1, 2).otherwise(1)).otherwise(F.col("checksum"))
    return at.with_(blocks=at.payloads.withColumn("checksum", broken.cast("long")), files=content.redacted_files(at.files, at.spans, toxic_names(spark, sf)))


_VALID = f"WITH {_FILES}, {_DEDUP}, {_HIT}, skip AS (SELECT DISTINCT block_id FROM spans WHERE file_id IN (SELECT file_id FROM hit)), v AS (SELECT block_id, raw_size = 0 OR raw_size >= 100 AS valid FROM cch WHERE block_id NOT IN (SELECT block_id FROM skip))"


@query(f"{_VALID} SELECT block_id, valid, CASE WHEN NOT valid THEN 'checksum' END AS reason FROM v")
def validate_blocks(spark, sf):
    return content.validate(damaged(spark, sf))


@query(f"{_VALID} SELECT bool_and(valid) AS all_valid, count(*) AS n_blocks FROM v")
def validate_all(spark, sf):
    return content.all_valid(damaged(spark, sf))


# --- names

_FRONT = f"""WITH {_FILES}, prev AS (SELECT file_id, name, lag(name) OVER (ORDER BY file_id) AS previous FROM files),
pre AS (SELECT *, CASE WHEN file_id % 16 = 0 OR previous IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(least(length(name), length(previous))), lambda i: substr(name, i + 1, 1) <> substr(previous, i + 1, 1))), least(length(name), length(previous))) END AS prefix_len FROM prev)"""


@query(f"{_FRONT} SELECT file_id, prefix_len, length(name) - prefix_len AS suffix_len FROM pre")
def name_front_coding(spark, sf):
    return names.front_coding(files(spark, sf)).select("file_id", F.col("prefix_len").cast("long").alias("prefix_len"), F.col("suffix_len").cast("long").alias("suffix_len"))


@query(f"""{_FRONT}, seg AS (SELECT name, prefix_len, string_split(name, '/') AS s, string_split(coalesce(previous, ''), '/') AS p, previous FROM pre),
k AS (SELECT *, CASE WHEN previous IS NULL THEN 0 ELSE len(list_filter(range(1, len(s) + 1), lambda i: len(p) >= i AND array_to_string(s[1:i], '/') = array_to_string(p[1:i], '/'))) END AS keep FROM seg),
e AS (SELECT count(*) AS n_names, bool_and(previous IS NULL OR previous <= name) AS is_sorted, CAST(sum(length(name) + 4) + 4 AS BIGINT) AS raw_bytes, CAST(sum(length(name) - prefix_len + 4) + 8 AS BIGINT) AS front_bytes,
  CAST(coalesce(sum(list_sum(list_transform(s[keep + 1:], lambda x: length(x) + 4))), 0) + 8 AS BIGINT) AS trie_bytes FROM k)
SELECT *, CASE WHEN n_names < 100 THEN 'raw' WHEN is_sorted AND front_bytes <= 0.9 * raw_bytes THEN 'front_coded' WHEN n_names >= 5000 AND trie_bytes < 0.5 * raw_bytes AND front_bytes > 0.85 * raw_bytes THEN 'trie' ELSE 'raw' END AS name_format FROM e""")
def name_format_recommendation(spark, sf):
    return names.recommend_format(files(spark, sf))


@query("""WITH n AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS prefix, 3 AS depth, CAST(0 AS BIGINT) AS n_children FROM documents
UNION ALL SELECT lang || '/' || source, 2, count(*) FROM documents GROUP BY lang, source UNION ALL SELECT lang, 1, count(DISTINCT source) FROM documents GROUP BY lang)
SELECT prefix, CAST(depth AS BIGINT) AS depth, true AS is_entry, n_children FROM n""")
def name_trie_nodes(spark, sf):
    return names.trie_nodes(files(spark, sf))


@query(f"WITH {_FILES}, p AS (SELECT name, lag(name) OVER (ORDER BY file_id) AS b FROM files) SELECT bool_and(b IS NULL OR b <= name) AS is_sorted FROM p")
def names_sorted(spark, sf):
    return names.is_sorted(files(spark, sf))


# --- vectors

_VEC = """r AS (SELECT CAST(embedding AS DOUBLE[]) AS ref FROM embeddings ORDER BY vec_id LIMIT 1),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, ref FROM embeddings, r),
sim AS (SELECT vec_id, CASE WHEN sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(ref, ref)) < 1e-8 THEN 0.0 ELSE list_inner_product(e, ref) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(ref, ref))) END AS cosine,
  0.0 - list_sum(list_transform(list_zip(e, ref), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS euclidean FROM v)"""


@query(f"WITH {_VEC} SELECT vec_id, round(cosine, 6) AS similarity FROM sim")
def vector_cosine(spark, sf):
    return vectors.similarity(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_VEC} SELECT vec_id, round(euclidean, 6) AS similarity FROM sim")
def vector_euclidean(spark, sf):
    return vectors.similarity(table(spark, sf, "embeddings"), "vec_id", "embedding", "euclidean").select("vec_id", F.round("similarity", 6).alias("similarity"))


def coarse(spark, sf) -> DataFrame:
    """Similarities rounded to 9 places, so that both engines cut the same bins."""
    return vectors.similarity(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("similarity", 9).alias("similarity"))


_BIN = "CASE WHEN hi > lo THEN least(999, CAST(floor((s - lo) / (hi - lo) * 999.0) AS BIGINT)) ELSE 0 END"


@query(f"WITH {_VEC}, c AS (SELECT vec_id, round(cosine, 9) AS s FROM sim), m AS (SELECT min(s) AS lo, max(s) AS hi FROM c) SELECT vec_id, {_BIN} AS bin FROM c, m")
def vector_sweep_bins(spark, sf):
    return vectors.sweep_bins(coarse(spark, sf), "vec_id").select("vec_id", "bin")


@query(f"""WITH {_VEC}, c AS (SELECT vec_id, round(cosine, 9) AS s, (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS batch FROM sim), m AS (SELECT batch, min(s) AS lo, max(s) AS hi FROM c GROUP BY batch),
b AS (SELECT vec_id, c.batch, {_BIN} AS bin FROM c JOIN m ON c.batch = m.batch) SELECT row_number() OVER (ORDER BY batch, bin DESC, vec_id) - 1 AS position, batch, vec_id, bin FROM b""")
def vector_batched_order(spark, sf):
    d = in_order(coarse(spark, sf), ["vec_id"], "_row")
    b = vectors.sweep_bins(d, "vec_id", batch=F.floor(F.col("_row") / 100)).withColumn("_major", F.col("batch") * 1001 - F.col("bin"))
    return in_order(b, ["_major", "vec_id"], "position").select("position", "batch", "vec_id", "bin")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(greatest(-127, least(127, CAST(round(CAST(x AS DOUBLE) * 127.0) AS INTEGER))) / 127.0 AS FLOAT) AS DOUBLE))), 3) + 0.0 AS total FROM embeddings")
def int8_decode(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", vectors.encode_int8(F.col("embedding")).alias("q"))
    return e.select("vec_id", (F.round(F.aggregate(vectors.decode_int8(F.col("q")), F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias("total"))


@query("SELECT count(*) AS n_items, CAST(max(len(embedding)) * 4 AS BIGINT) AS bytes_per_item, CAST(count(*) * max(len(embedding)) * 4 AS BIGINT) AS estimated_bytes FROM embeddings")
def vector_memory_stats(spark, sf):
    return vectors.memory_stats(table(spark, sf, "embeddings"), "embedding")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
p AS (SELECT q.vec_id AS query, n.vec_id, CASE WHEN q.norm * n.norm < 1e-8 THEN 0.0 ELSE round(list_inner_product(q.e, n.e) / (q.norm * n.norm), 6) END AS similarity FROM n AS q, n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC) AS place FROM p) SELECT query, place, similarity FROM r WHERE place <= 10""")
def vector_top_k(spark, sf):
    """The ten best similarities of every vector whose id is divisible by 20, against all; ids are left out, since rounded similarities may tie."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings")
    top = vectors.top_k(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), "vec_id", "embedding", 10)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id"))
    return top.select("query", place.cast("long").alias("place"), F.round("similarity", 6).alias("similarity"))


# --- similarity index

#: Lanes of the sketches that SQL can make over whole tables.
LANES = 4


def texts(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.col("doc_id").cast("string").alias("name"), F.lit("file").alias("entry_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def items(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("file_id"), F.col("item_id").cast("string").alias("name"), F.lit("file").alias("entry_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


_TEXTS = "d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)"


def _sketched(spark, sf, num_hashes: int, bits: int = 64) -> DataFrame:
    return minhash.build(texts(spark, sf), num_hashes, bits)


def _shown(index: DataFrame) -> DataFrame:
    return index.select("file_id", "num_hashes", "bit_width", "seed", F.array_join(F.transform("sketch", lambda x: F.lower(F.hex(x))), ",").alias("sketch_hex"))


@query()
def minhash_sketch(spark, sf):
    """Default sketches of every document; lanes as text."""
    return _shown(_sketched(spark, sf, 128))


@query(f"""WITH {_TEXTS}, {kernel_sql.sketches('d', 'doc_id', LANES, 64)}
SELECT doc_id AS file_id, {LANES} AS num_hashes, 64 AS bit_width, CAST(42 AS BIGINT) AS seed, string_agg(lower(hex(v)), ',' ORDER BY i) AS sketch_hex FROM sketch GROUP BY doc_id""")
def minhash_sketch_4(spark, sf):
    """Sketches of few lanes, which SQL can follow over whole texts."""
    return _shown(_sketched(spark, sf, LANES))


def _found(spark, sf, num_hashes: int, bits: int) -> DataFrame:
    index = _sketched(spark, sf, num_hashes, bits)
    return minhash.search_all(index, index.filter("file_id % 20 = 0").select(F.col("file_id").alias("query"), "sketch"), num_hashes, bits)


@query()
def minhash_search(spark, sf):
    """All documents that share a lane with a document whose id is divisible by 20, for all of those."""
    return _found(spark, sf, 128, 32)


@query(f"""WITH {_TEXTS}, {kernel_sql.sketches('d', 'doc_id', LANES, 64)}, s AS (SELECT * FROM sketch WHERE v <> 18446744073709551615)
SELECT q.doc_id AS query, s.doc_id AS file_id, count(*) / {LANES}.0::DOUBLE AS score FROM s AS q JOIN s ON q.i = s.i AND q.v = s.v WHERE q.doc_id % 20 = 0 GROUP BY ALL""")
def minhash_search_4(spark, sf):
    return _found(spark, sf, LANES, 64)


def _best(spark, sf, num_hashes: int, bits: int) -> DataFrame:
    asked = minhash.build(items(spark, sf), num_hashes, bits).select(F.col("file_id").alias("query"), "sketch")
    return minhash.best(minhash.search_all(_sketched(spark, sf, num_hashes, bits), asked, num_hashes, bits, top_n=5), 5)


@query()
def minhash_top_n(spark, sf):
    """The five documents most like each benchmark item."""
    return _best(spark, sf, 128, 32)


@query(f"""WITH {_TEXTS}, {kernel_sql.sketches('d', 'doc_id', LANES, 64)}, b AS (SELECT item_id, hex(encode(coalesce(text, ''))) AS x FROM benchmark), {kernel_sql.sketches('b', 'item_id', LANES, 64, name='asked')},
p AS (SELECT item_id AS query, doc_id AS file_id, count(*) / {LANES}.0::DOUBLE AS score FROM asked JOIN sketch ON asked.i = sketch.i AND asked.v = sketch.v WHERE asked.v <> 18446744073709551615 GROUP BY ALL)
SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file_id) AS place FROM p) WHERE place <= 5""")
def minhash_top_n_4(spark, sf):
    return _best(spark, sf, LANES, 64)


_CUT = "CASE WHEN length({t}) >= 8 THEN list_distinct(list_transform(range(1, length({t}) - 6), lambda i: substr({t}, i, 8))) WHEN length({t}) > 0 THEN [{t}] ELSE [] END"


@query(f"""WITH a AS (SELECT item_id AS query, {_CUT.format(t='text')} AS s FROM benchmark), b AS (SELECT doc_id AS file_id, {_CUT.format(t='text')} AS s FROM documents),
p AS (SELECT query, file_id, count(*) AS common FROM (SELECT query, unnest(s) AS x FROM a) JOIN (SELECT file_id, unnest(s) AS x FROM b) USING (x) GROUP BY ALL)
SELECT query, file_id, common, round(common / (len(a.s) + len(b.s) - common), 9) AS jaccard FROM p JOIN a USING (query) JOIN b USING (file_id)""")
def shingle_jaccard_exact(spark, sf):
    """Exact similarity of all documents with all benchmark items that share a shingle with them."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return minhash.shingle_jaccard(d, asked).select("query", "file_id", "common", F.round("jaccard", 9).alias("jaccard"))


# --- kernels

_BLOCKS = f"""b AS (SELECT doc_id AS file_id, hex(encode(coalesce(text, ''))) AS whole FROM documents),
d AS (SELECT file_id, k AS sequence_order, substr(whole, k * {2 * BLOCK} + 1, {2 * BLOCK}) AS x FROM (SELECT *, unnest(range(greatest(1, (length(whole) + {2 * BLOCK - 1}) // {2 * BLOCK}))) AS k FROM b))"""


def text_blocks(spark, sf) -> DataFrame:
    """(file_id, sequence_order, raw): every document's bytes in blocks; an empty one has an empty block."""
    n = F.greatest(F.ceil(F.octet_length("content") / F.lit(BLOCK)), F.lit(1)).cast("int")
    t = texts(spark, sf).select("file_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return t.select("file_id", F.col("k").cast("long").alias("sequence_order"), F.substring("content", F.col("k") * BLOCK + 1, F.lit(BLOCK)).alias("raw"))


@query(f"WITH {_BLOCKS}, {kernel_sql.h64('d')} SELECT file_id, sequence_order, CAST(h % 4294967296 AS BIGINT) AS checksum, lpad(lower(hex(CAST(h AS UBIGINT))), 16, '0') AS digest FROM hashed")
def block_checksum_h64(spark, sf):
    return text_blocks(spark, sf).select("file_id", "sequence_order", udfs.block_checksum(F.col("raw"), "h64").alias("checksum"), udfs.digest_h64(F.col("raw")).alias("digest"))


@query(f"WITH {_BLOCKS}, {kernel_sql.crc32c('d')} SELECT file_id, sequence_order, CAST(h AS BIGINT) AS checksum FROM hashed")
def block_checksum_crc32c(spark, sf):
    return text_blocks(spark, sf).select("file_id", "sequence_order", udfs.block_checksum(F.col("raw"), "crc32c").alias("checksum"))


@query(f"WITH {_BLOCKS}, {kernel_sql.xxh32('d')} SELECT file_id, sequence_order, CAST(h AS BIGINT) AS checksum FROM hashed")
def block_checksum_xxh32(spark, sf):
    return text_blocks(spark, sf).select("file_id", "sequence_order", udfs.block_checksum(F.col("raw"), "xxh32").alias("checksum"))


def _codec(name: str) -> None:
    def run(spark, sf):
        t = texts(spark, sf).select("file_id", F.octet_length("content").cast("long").alias("size"), udfs.compress(F.col("content"), name).alias("p"))
        return t.select("file_id", F.md5(udfs.decompress(F.col("p"), F.lit(name), F.col("size"))).alias("md5"))

    QUERIES[f"codec_roundtrip_{name}"] = run
    ORACLES[f"codec_roundtrip_{name}"] = "SELECT doc_id AS file_id, md5(coalesce(text, '')) AS md5 FROM documents"


for _name in ("none", "gzip", "zstd", "lz4", "bzip2"):
    _codec(_name)


def _js(c: str) -> str:
    return f"""list_aggregate(list_transform(range(octet_length(encode({c}))), lambda i: CASE
 WHEN b[i + 1] = 34 THEN '\\"' WHEN b[i + 1] = 92 THEN '\\\\' WHEN b[i + 1] = 8 THEN '\\b' WHEN b[i + 1] = 12 THEN '\\f' WHEN b[i + 1] = 10 THEN '\\n' WHEN b[i + 1] = 13 THEN '\\r' WHEN b[i + 1] = 9 THEN '\\t'
 WHEN b[i + 1] < 32 OR b[i + 1] >= 127 THEN '\\u00' || lower(lpad(printf('%x', b[i + 1]), 2, '0')) ELSE chr(CAST(b[i + 1] AS INTEGER)) END), 'string_agg', '')"""


@query(f"""WITH h AS (SELECT item_id, text, hex(encode(text)) AS x FROM benchmark),
a AS (SELECT item_id, text, list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT)) AS b FROM h)
SELECT item_id, {_js('text')} AS escaped FROM a""")
def json_escape_latin1(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", fmt.json_bytes(F.encode("text", "UTF-8")).alias("escaped"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", octet_length(encode(coalesce(text, ''))) AS length FROM conversations""")
def conversation_spans(spark, sf):
    """Turns as spans of one block per conversation: offsets within it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size: Column = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf, "conversations").withColumn("length", size).select("conv_id", "turn", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), "length")
