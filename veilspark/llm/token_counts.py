"""Token counts as rollups that are maintained by deltas.

A batch of changes is a frame of signed rows: inserts count +1, deletes -1, a revised
count is the old one with -1 and the new one with +1. Each batch is summed up by
source, language and tokenizer version and committed once under its name; totals are
the sums of all commits. Sums are additive, so batches may come in any order, and a batch that
is sent again is passed over.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import n_words, scratch, table

KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"
#: Committed batches from which ``compact`` is worth while.
COMPACT_FROM = 64


# Tokenizers: a version's name and how it counts


def words_v1(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return n_words(text)


def words_v2(text: Column) -> Column:
    """Runs of letters and digits, and every other character but white space by itself."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]")), F.lit(0)).cast("long")


def bytes_v1(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ranked_bpe(path: str, pattern: str):
    """Counts the tokens of a byte-pair vocabulary in ``path`` (base64 token and rank in each line), in Arrow batches.

    Workers read the file once; it must be there on every executor.
    """
    loaded: dict = {}

    def encoding():
        if path not in loaded:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
            loaded[path] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return loaded[path]

    def tokenizer(text: Column) -> Column:
        @F.pandas_udf("long")
        def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = encoding()
            for batch in texts:
                yield pd.Series([len(own.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch], dtype="int64")

        return count(text)

    return tokenizer


TOKENIZERS = {"words-1": words_v1, "words-2": words_v2, "bytes-1": bytes_v1}


# Changes


def signed(docs: DataFrame, sign: int, tokenizers: dict) -> DataFrame:
    """``sign, source, lang, tokenizer, tokens``: a row for each row of ``docs`` and tokenizer version; null has 0 tokens."""
    counts = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(docs["text"]).alias("tokens")) for name, count in tokenizers.items()])
    return docs.select("source", "lang", F.explode(counts).alias("c")).select(
        F.lit(sign).cast("long").alias("sign"), "source", "lang", F.col("c.tokenizer").alias("tokenizer"), F.col("c.tokens").cast("long").alias("tokens")
    )


def inserts(docs: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    return signed(docs, 1, tokenizers)


def deletes(docs: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """``docs`` as they were counted."""
    return signed(docs, -1, tokenizers)


def revisions(before: DataFrame, after: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    return deletes(before, tokenizers).unionByName(inserts(after, tokenizers))


def rollup(changes: DataFrame) -> DataFrame:
    """Signed sums by source, language and tokenizer version; null is a group of its own. Summed in the tasks first."""
    return changes.groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))


# The table


class RollupTable:
    """A folder of committed batches, each a small rollup under the batch's name.

    A batch is written under a temporary name and renamed; the rename fails if the name is
    there, so of two writers of a batch one wins, and a batch sent twice counts once. A
    compaction is committed in the same way, as a snapshot that names what it sums up.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))

    def _name(self, batch: str) -> str:
        """A batch's folder: its name in hexadecimal, so that any name will do."""
        return f"{self.folder}/batches/batch-{batch.encode().hex()}"

    def committed(self, batch: str) -> bool:
        if self._fs.exists(self._path(self._name(batch))):
            return True
        last = self._snapshot()
        return last is not None and not self._summed_up(last).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes; False if one of that name has been committed before."""
        return not self.committed(batch) and self._rename(rollup(changes), self._name(batch))

    def _rename(self, rows: DataFrame, name: str) -> bool:
        temporary = f"{self.folder}/temporary-{uuid.uuid4().hex}"
        rows.write.parquet(temporary)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(temporary), self._path(name), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            self._fs.delete(self._path(temporary), True)
            return False
        return True

    def _listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().toString() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _snapshot(self) -> str | None:
        """The last snapshot; each is named by its number."""
        found = [p for p in self._listed("snapshots")]
        return found[-1] if found else None

    def _summed_up(self, snapshot: str) -> DataFrame:
        """``batch``: names of all that a snapshot sums up."""
        return self.spark.read.schema(f"{_TOTALS}, batch string").parquet(snapshot).where("batch IS NOT NULL").select("batch")

    def _fresh(self, last: str | None) -> dict[str, str]:
        """Names and folders of the batches that are there now and not in the snapshot ``last``."""
        listed = [(bytes.fromhex(p.rsplit("batch-", 1)[1]).decode(), p) for p in self._listed("batches")]
        if last is not None and listed:
            names = self.spark.createDataFrame(listed, "batch string, path string")
            listed = [tuple(r) for r in names.join(self._summed_up(last), "batch", "left_anti").collect()]
        return dict(sorted(listed))

    def _totals(self, last: str | None, fresh: dict[str, str]) -> DataFrame:
        rows = self.spark.createDataFrame([], _TOTALS)
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(_TOTALS).parquet(*fresh.values()))
        if last is not None:
            rows = rows.unionByName(self.spark.read.schema(f"{_TOTALS}, batch string").parquet(last).where("batch IS NULL").drop("batch"))
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.where("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` over all committed batches; groups without documents and tokens are left out."""
        last = self._snapshot()
        return self._totals(last, self._fresh(last))

    def compact(self) -> bool:
        """Sums up all batches so far in a snapshot; their names stay known. False if another writer was first.

        Batches are listed once: those in the sums are those that are named, whatever is
        committed meanwhile.
        """
        last = self._snapshot()
        fresh = self._fresh(last)
        rows = self._totals(last, fresh).withColumn("batch", F.lit(None).cast("string"))
        rows = rows.unionByName(self.spark.createDataFrame([(b,) for b in fresh], "batch string"), allowMissingColumns=True)
        if last is not None:
            rows = rows.unionByName(self._summed_up(last), allowMissingColumns=True)
        self._fs.mkdirs(self._path(f"{self.folder}/snapshots"))
        number = int(last.rsplit("/", 1)[1]) + 1 if last else 0
        return self._rename(rows.select(*KEYS, "documents", "tokens", "batch"), f"{self.folder}/snapshots/{number:08d}")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, a batch of deletions and one of revisions, some of them sent twice.

    All documents are inserted; then those with an id divisible by 7 are deleted, and the
    texts of the others divisible by 5 are revised to their first half and source ``revised``.
    Rows without an id are only inserted.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    gone, edited = F.col("doc_id") % 7 == 0, (F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 5 == 0)
    before = docs.where(edited)
    half = F.substring("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int"))
    after = before.withColumns({"text": half, "source": F.lit("revised")})
    rollups = RollupTable(spark, scratch(spark, "token-counts"))
    for batch, changes in (
        ("load", inserts(docs)),
        ("deletions", deletes(docs.where(gone))),
        ("load", inserts(docs)),
        ("revisions", revisions(before, after)),
        ("deletions", deletes(docs.where(gone))),
    ):
        rollups.commit(batch, changes)
    return rollups.totals()


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, lang,
    CASE WHEN doc_id % 5 = 0 THEN 'revised' ELSE source END AS source,
    CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS text
  FROM documents WHERE COALESCE(doc_id % 7, 1) <> 0),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM d
  UNION ALL
  SELECT source, lang, 'words-2',
         COALESCE(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')), 0)::BIGINT FROM d
  UNION ALL
  SELECT source, lang, 'bytes-1', COALESCE(strlen(text), 0)::BIGINT FROM d)
SELECT source, lang, tokenizer, COUNT(*)::BIGINT AS documents, SUM(tokens)::BIGINT AS tokens
FROM c GROUP BY source, lang, tokenizer
"""
