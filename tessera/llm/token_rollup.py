"""Token counts as rollups that are maintained by signed deltas.

Totals per (source, language, tokenizer version) are additive: documents, tokens and characters. A batch of
changes is reduced to one signed row per key (inserts +, deletes -, a revision - old + new) and
committed under a batch id. The commit is one rename of a finished folder, so a batch is there as a whole or not at all, and
a batch id that is there is never applied again: retries and replays change nothing.
Totals are the sum of the last compaction and the deltas behind it.

Only keys are grouped, with partial sums before the shuffle, so a source with a third of all rows costs no
more than another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import save, workspace

KEY = ("source", "lang", "tokenizer_version")
SUMS = ("docs", "tokens", "chars")
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long, chars long"


def pieces_count(text: Column) -> Column:
    """Runs of ASCII letters, of digits, and single other non-space characters."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "[0-9]+", "0")
    t = F.regexp_replace(t, "[A-Za-z]+", "a")
    return F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long")


#: Tokenizer versions that DataFrame functions count; others bring their counts along (see lexicon.token_counts).
COUNTERS = {"words-1": word_count, "pieces-2": pieces_count}


def changes(docs: DataFrame, versions: tuple[str, ...], sign: int, text: str = "text") -> DataFrame:
    """Signed SCHEMA rows for each row of ``docs`` and version; null text has no tokens."""
    counts = F.array(*[F.struct(F.lit(v).alias("version"), COUNTERS[v](F.col(text)).alias("n")) for v in versions])
    d = docs.select("source", "lang", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), F.explode(counts).alias("c"))
    return d.select("source", "lang", F.col("c.version").alias("tokenizer_version"), F.lit(sign).cast("long").alias("docs"), (F.col("c.n") * sign).alias("tokens"), (F.col("chars") * sign).alias("chars"))


def revisions(docs: DataFrame, versions: tuple[str, ...], old: str, new: str) -> DataFrame:
    """Signed rows that replace the counts of text column ``old`` by those of ``new``."""
    return changes(docs, versions, -1, old).unionByName(changes(docs, versions, 1, new))


def _rolled(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEY).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


class Rollup:
    """Totals in a folder on any Hadoop file system: ``deltas/<batch>`` and ``base/<n>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        self.fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for sub in ("deltas", "base", "tmp"):
            self.fs.mkdirs(self._p(f"{self.path}/{sub}"))

    def _names(self, sub: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._p(f"{self.path}/{sub}")))

    def _publish(self, df: DataFrame, to: str) -> bool:
        """Write aside, then rename; False if ``to`` is there already."""
        if self.fs.exists(self._p(to)):
            return False
        part = f"{self.path}/tmp/{uuid.uuid4().hex}"
        df.write.parquet(part)
        if self.fs.exists(self._p(to)) or not self.fs.rename(self._p(part), self._p(to)):
            self.fs.delete(self._p(part), True)
            return False
        inner = self._p(f"{to}/{part.rsplit('/', 1)[1]}")
        if self.fs.exists(inner):  # a rename into a folder that appeared meanwhile
            self.fs.delete(inner, True)
            return False
        return True

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply signed SCHEMA rows as batch ``batch``; False, without reading them, if it was applied before."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.fs.exists(self._p(f"{self.path}/deltas/{batch}")) or self._in_base(batch):
            return False
        return self._publish(_rolled(deltas.select(*KEY, *SUMS)), f"{self.path}/deltas/{batch}")

    def batches(self) -> list[str]:
        return sorted({*self._names("deltas"), *self._compacted()[1]})

    def _in_base(self, batch: str) -> bool:
        base = self._base()
        return base is not None and not self.spark.read.parquet(f"{base}/batches").filter(F.col("batch") == batch).isEmpty()

    def _base(self) -> str | None:
        bases = self._names("base")
        return f"{self.path}/base/{max(bases, key=int)}" if bases else None

    def _compacted(self) -> tuple[str | None, list[str]]:
        path = self._base()
        if path is None:
            return None, []
        done = self.spark.read.parquet(f"{path}/batches").collect()  # one short row per batch
        return path, [r.batch for r in done]

    def totals(self) -> DataFrame:
        """SCHEMA with the sums of all committed batches; keys without documents, tokens and characters left are absent."""
        base, done = self._compacted()
        return self._summed(base, [b for b in self._names("deltas") if b not in done])

    def _summed(self, base: str | None, deltas: list[str]) -> DataFrame:
        parts = [f"{self.path}/deltas/{b}" for b in deltas] + ([f"{base}/totals"] if base else [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return _rolled(self.spark.read.schema(SCHEMA).parquet(*parts)).filter("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def compact(self) -> None:
        """Fold the deltas into a new base; a crash on the way leaves the old base and all deltas.

        Deltas are listed once: a batch that is committed meanwhile is in neither the sums nor the list, and stays a delta.
        """
        base, done = self._compacted()
        names = self._names("deltas")
        n = 1 + max([0, *map(int, self._names("base"))])
        part = f"{self.path}/tmp/{uuid.uuid4().hex}"
        self._summed(base, [b for b in names if b not in done]).write.parquet(f"{part}/totals")
        self.spark.createDataFrame([(b,) for b in sorted({*names, *done})], "batch string").write.parquet(f"{part}/batches")
        if self.fs.rename(self._p(part), self._p(f"{self.path}/base/{n}")):
            for b in names:
                self.fs.delete(self._p(f"{self.path}/deltas/{b}"), True)


def maintain(docs: DataFrame, path: str, versions: tuple[str, ...] = tuple(COUNTERS)) -> Rollup:
    """The life of a corpus as four batches, one of them delivered twice, and a compaction.

    1. ``load``: all documents are inserted under every version.
    2. ``revise``: every text without its digits replaces the text.
    3. ``dedup``: of rows with equal (revised) text all but one in each source and language are deleted.
    4. ``revise`` comes again and is ignored.
    ``docs`` is (text, source, lang, any others); null sources and languages are keys of their own; null texts
    count no tokens. An empty table leaves empty totals.
    """
    spark = docs.sparkSession
    r = Rollup(spark, path)
    new = F.regexp_replace("text", "[0-9]+", "")

    def counts(text: Column) -> Column:
        return F.array(*[COUNTERS[v](text) for v in versions])

    def chars(text: Column) -> Column:
        return F.coalesce(F.length(text), F.lit(0)).cast("long")

    # Texts are counted once; all batches are made from this slim table.
    d = docs.select("source", "lang", "text", new.alias("new"))
    d = d.select("source", "lang", chars(F.col("text")).alias("c0"), chars(F.col("new")).alias("c1"), counts(F.col("text")).alias("n0"), counts(F.col("new")).alias("n1"), F.sha2(F.coalesce("new", F.lit("\0")).cast("binary"), 256).alias("h"))
    d = save(d, f"{workspace(spark, 'counts')}/texts")

    def signed(rows: DataFrame, n: str, c: str, times: Column) -> DataFrame:
        rows = rows.select("source", "lang", times.cast("long").alias("docs"), F.col(c).alias("chars"), F.explode(F.arrays_zip(F.array(*map(F.lit, versions)).alias("v"), F.col(n).alias("n"))).alias("z"))
        return rows.select("source", "lang", F.col("z.v").alias("tokenizer_version"), "docs", (F.col("docs") * F.col("z.n")).alias("tokens"), (F.col("docs") * F.col("chars")).alias("chars"))

    revise = signed(d, "n0", "c0", F.lit(-1)).unionByName(signed(d, "n1", "c1", F.lit(1)))
    copies = d.groupBy("source", "lang", "h").agg(F.count(F.lit(1)).alias("k"), F.first("c1").alias("c1"), F.first("n1").alias("n1")).filter("k > 1")
    r.commit("load", signed(d, "n0", "c0", F.lit(1)))
    r.commit("revise", revise)
    r.commit("dedup", signed(copies, "n1", "c1", 1 - F.col("k")))
    r.commit("revise", revise)
    r.compact()
    return r


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after the maintained life of all documents."""
    return maintain(spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "rollup")).totals()


ORACLE = r"""
WITH d AS (SELECT source, lang, regexp_replace(text, '[0-9]+', '', 'g') AS t FROM documents),
u AS (SELECT DISTINCT source, lang, coalesce(t, chr(0)) AS h, t FROM d),
c AS (
  SELECT source, lang, coalesce(length(t), 0) AS chars,
         length(regexp_replace(regexp_replace(coalesce(t, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS words,
         length(regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS pieces
  FROM u)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS docs, CAST(sum(words) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars FROM c GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-2', count(*), CAST(sum(pieces) AS BIGINT), CAST(sum(chars) AS BIGINT) FROM c GROUP BY source, lang
"""
