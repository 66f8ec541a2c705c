"""Token counts as delta-maintained rollups: signed changes update additive totals, batch by idempotent batch."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a byte-level BPE vocabulary cuts a text into pieces before it merges bytes: a fixed value.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"
#: Characters that go to the tokenizer at once; longer texts are cut where no piece spans the cut.
CHUNK = 1 << 16
SAFE_CUT = re.compile(r"\S(?=\s\S)")


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read by Spark, so that any store will do."""
    lines = spark.read.text(path).collect()
    return {base64.b64decode(a): int(b) for a, b in (r["value"].split(" ") for r in lines if r["value"])}


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], out: str = "n_tokens", pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the number of tokens of each whole text in the long column ``out``; a null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for texts in parts:
            yield pd.Series([sum(len(encoding.encode_ordinary(x)) for x in pieces(t)) for t in texts], dtype="int64")

    return docs.withColumn(out, count("text"))


def pieces(text: str | None) -> Iterator[str]:
    """Parts of a text whose token counts add up to the text's: cuts fall between a character and a single white space
    that another character follows, where the pattern always ends a piece."""
    text = text or ""
    start = 0
    while len(text) - start > CHUNK:
        cut = SAFE_CUT.search(text, start + CHUNK)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class Rollup:
    """Totals by source, language and tokenizer version, kept as a folder of signed batches.

    A batch is one folder with the changes of its documents' counts (the ledger) and their sums (the totals), which is
    written under a temporary name and then renamed: a batch is committed as a whole or not at all. A batch that has
    been committed is passed over when it comes again, so a job that died may simply be run again. Totals are the sum of
    all batches; they never read a document twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        if not self.fs.exists(self.path(self.root)):
            return []
        if self.fs.exists(self.path(f"{self.root}/_compacted/_SUCCESS")):
            self._drop_compacted()
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)))
        return sorted(unquote(n.removeprefix("batch_")) for n in names if n.startswith("batch_"))

    def _folder(self, batch: str) -> str:
        return f"{self.root}/batch_{quote(batch, safe='')}"

    def _read(self, table: str, kind: str) -> DataFrame:
        found = [f"{self._folder(b)}/{table}" for b in self.batches()]
        if not found:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*found)

    def totals(self) -> DataFrame:
        """The sums over all committed batches; groups without documents are left out."""
        sums = self._read("totals", TOTALS).groupBy("source", "lang", "tokenizer")
        sums = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, counted: DataFrame, tokenizer: str, deletes: DataFrame | None = None) -> bool:
        """Commit inserts and revisions ``counted`` (doc_id, source, lang, n_tokens) and ``deletes`` (doc_id).

        What the ledger holds of a changed or deleted document under this tokenizer version is taken back, so a
        document that comes again is revised, not counted twice. Without earlier batches nothing is looked up. Rows that
        repeat within a batch count each; a null doc_id is counted, but can't be revised; an empty batch is committed
        too. Returns whether the batch is new. One writer at a time commits; a batch that can't be put in its place is
        an error.
        """
        if batch in self.batches():
            return False
        new = counted.select(
            F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens"
        ).withColumn("sign", F.lit(1))
        if self.batches():
            changed = counted.select(F.col("doc_id").cast("long").alias("doc_id"))
            if deletes is not None:
                changed = changed.unionByName(deletes.select(F.col("doc_id").cast("long").alias("doc_id")))
            old = self.ledger_rows(tokenizer, changed.distinct())
            new = new.unionByName(old.select(*new.columns[:-1], F.expr("-sign").alias("sign")))
        temporary = f"{self.root}/_writing-{quote(batch, safe='')}"
        self.fs.delete(self.path(temporary), True)
        new.write.parquet(f"{temporary}/ledger")
        written = self.spark.read.parquet(f"{temporary}/ledger")
        sums = written.groupBy("source", "lang", "tokenizer").agg(
            F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
        )
        sums.write.parquet(f"{temporary}/totals")
        if not self.fs.rename(self.path(temporary), self.path(self._folder(batch))):
            raise OSError(f"batch {batch!r} could not be committed")
        return True

    def ledger_rows(self, tokenizer: str | None = None, ids: DataFrame | None = None) -> DataFrame:
        """The ledger's rows that still count, of one tokenizer version and the given ``ids`` (doc_id) where they are
        named: signed rows summed by document and value."""
        rows = self._read("ledger", LEDGER)
        if tokenizer is not None:
            rows = rows.where(F.col("tokenizer") == tokenizer)
        if ids is not None:
            rows = rows.join(ids, "doc_id", "left_semi")
        rows = rows.groupBy("doc_id", "source", "lang", "tokenizer", "n_tokens")
        return rows.agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")

    def compact(self, batch: str) -> bool:
        """Replace all batches by one of the name ``batch`` with the same totals and the ledger rows that still count,
        so that a long history stays cheap to read. Batches that it replaces can't be recognised when they come again;
        compact what is past its time of redelivery. A job that dies leaves the history as it was, or a note of what
        is left to do, ``_compacted``, which the next call of any method carries out."""
        old = self.batches()
        self.fs.delete(self.path(f"{self.root}/_compacted"), True)
        if not old or batch in old:
            return False
        temporary = f"{self.root}/_writing-{quote(batch, safe='')}"
        self.fs.delete(self.path(temporary), True)
        self.ledger_rows().write.parquet(f"{temporary}/ledger")
        self.totals().write.parquet(f"{temporary}/totals")
        lines = self.spark.createDataFrame([(b,) for b in [batch, *old]], "value string").coalesce(1)
        lines.write.parquet(f"{self.root}/_compacted")
        self._drop_compacted()
        return True

    def _drop_compacted(self) -> None:
        """Finish a compaction: put the new batch in its place and delete the old ones."""
        note = f"{self.root}/_compacted"
        names = [r["value"] for r in self.spark.read.parquet(note).collect()]
        temporary = self.path(f"{self.root}/_writing-{quote(names[0], safe='')}")
        for b in names[1:]:
            self.fs.delete(self.path(self._folder(b)), True)
        if self.fs.exists(temporary) and not self.fs.rename(temporary, self.path(self._folder(names[0]))):
            raise OSError(f"batch {names[0]!r} could not be committed")
        self.fs.delete(self.path(note), True)
