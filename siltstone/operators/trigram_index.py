"""A written inverted index of trigrams: text searches read the postings of their own trigrams, not every record."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions import text
from siltstone.operators import search
from siltstone.sources.persisted import read_table, write_table
from siltstone.sources.scratch import broadcast_if_small, written

#: Postings of a bucket aimed at, and the trigrams of a term, the rarest ones, whose postings are read at most.
BUCKET, RAREST = 4_000_000, 3
#: Records whose trigrams are made, and rows that are passed on, at once.
RECORDS, ROWS = 64, 10_000


def _postings(many: int, id_type: pa.DataType):
    """(kind, bucket, id, n, joined): a record's trigrams of each kind and bucket, distinct and joined to one string.
    Rows are passed on in batches of a bounded number, however many buckets there are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, RECORDS):
                some = batch.slice(start, RECORDS)
                for id_, title, said in zip(*(some.column(c).to_pylist() for c in ("id", "title", "said"))):
                    windows = {said[i : i + 3] for i in range(max(1, len(said) - 2))} if said else ()
                    for kind, grams, n in (("title", title, len(title)), ("text", windows, None)):
                        by: dict[int, list[str]] = {}
                        for g in grams:
                            by.setdefault(zlib.crc32(g.encode("utf-8", "surrogatepass")) % many, []).append(g)
                        for bucket, own in by.items():
                            yield kind, bucket, id_, n, "".join(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, found = (pa.string(), pa.int32(), id_type, pa.int32(), pa.string()), rows(batches)
        while some := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["kind", "bucket", "id", "n", "joined"])

    return run


def haystack() -> Column:
    """What a substring search looks through: title, content and tags, lower-cased."""
    blank = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    tags = F.lower(F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " "))
    return F.concat_ws(" ", blank("title"), blank("content"), tags)


class TrigramIndex:
    """The postings of records (id, title, content, tags) in a folder, and the records themselves.

    ``postings`` (kind, gram, id, n) are partitioned by a hash of the trigram and sorted by it: kind ``title`` has the
    trigrams of a title's padded words and their number n, kind ``text`` the strings of three characters of the whole
    record. ``grams`` (kind, gram, postings, bucket) tells how frequent each is. A trigram that all records have is written
    by many tasks, and read only by searches without a rarer one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.grams, self.records = (read_table(spark, f"{path}/{name}") for name in ("postings", "grams", "records"))
        self.buckets_read: set[int] = set()

    @classmethod
    def build(cls, records: DataFrame, path: str, bucket: int = BUCKET) -> TrigramIndex:
        """Writes the index of ``records``; ids are unique. Null titles and texts count as empty."""
        spark = records.sparkSession
        write_table(records, f"{path}/records")
        kept = read_table(spark, f"{path}/records")
        said = kept.select("id", text.trigrams(F.coalesce("title", F.lit(""))).alias("title"), haystack().alias("said"))
        many = max(16, -(-(kept.agg(F.sum(F.length(haystack()).cast("long"))).first()[0] or 0) // bucket))
        kind = kept.schema["id"].dataType
        rows = said.mapInArrow(_postings(many, to_arrow_type(kind)), f"kind string, bucket int, id {kind.simpleString()}, n int, joined string")
        dealt = rows.repartition("bucket", F.expr("pmod(xxhash64(id), 4)"))
        # every trigram has three characters but the one of a shorter text, which is alone in its row
        gram = F.explode(F.regexp_extract_all("joined", F.lit("(?s).{1,3}"), F.lit(0))).alias("gram")
        dealt = dealt.select("kind", gram, "id", "n", "bucket").sortWithinPartitions("bucket", "kind", "gram", "id")
        write_table(dealt, f"{path}/postings", "bucket", {"parquet.writer.version": "PARQUET_2_0"})
        counts = read_table(spark, f"{path}/postings").groupBy("kind", "gram", "bucket").agg(F.count("*").alias("postings"))
        write_table(counts.repartition("bucket").sortWithinPartitions("gram"), f"{path}/grams")
        return cls(spark, path)

    def _of(self, kind: str, grams: DataFrame) -> DataFrame:
        """The postings of some trigrams (gram, bucket: a few, held by the driver), which prune buckets and row groups."""
        found = [(r.gram, r.bucket) for r in grams.select("gram", "bucket").collect()]
        self.buckets_read |= {b for _, b in found}
        wanted = F.col("bucket").isin(sorted({b for _, b in found})) & F.col("gram").isin([g for g, _ in found])
        return self.postings.where((F.col("kind") == kind) & wanted)

    def alike(self, query: str, least: float) -> DataFrame:
        """(id): records whose title's trigram similarity to the query is over ``least``, exactly: the shared trigrams
        are the postings found, and n has the title's number."""
        own = self.spark.range(1).select(text.trigrams(F.lit(query))).first()[0]
        listed = self.grams.where((F.col("kind") == "title") & F.col("gram").isin(own))
        shared = self._of("title", listed).groupBy("id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        return shared.where(F.col("shared") / (F.col("n") + len(own) - F.col("shared")) > least).select("id")

    def holding(self, term: str) -> DataFrame:
        """(id): records that may hold the term, none of those that do left out: those that have the rarest of its
        strings of three characters. A shorter term is looked for in the list of trigrams."""
        low = term.lower()
        listed = self.grams.where("kind = 'text'")
        if len(low) < 3:
            # many trigrams may hold a short term; their postings are joined, not listed
            found = listed.where(F.contains("gram", F.lit(low))).select("gram", "bucket")
            buckets = [r.bucket for r in found.select("bucket").distinct().collect()]
            self.buckets_read |= set(buckets)
            some = self.postings.where((F.col("kind") == "text") & F.col("bucket").isin(buckets))
            return some.join(broadcast_if_small(found.select("gram")), "gram", "left_semi").select("id").distinct()
        own = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        known = listed.where(F.col("gram").isin(own)).orderBy("postings", "gram")
        if known.count() < len(own):  # a trigram that no record has
            return self.records.select("id").limit(0)
        rarest = known.limit(RAREST)
        counts = self._of("text", rarest).groupBy("id").agg(F.count("*").alias("n"))
        return counts.where(F.col("n") == min(RAREST, len(own))).select("id")

    def _any(self, sets: list[DataFrame]) -> DataFrame:
        """The records of any of the sets of ids."""
        ids = sets[0]
        for more in sets[1:]:
            ids = ids.unionByName(more)
        ids = written(ids.distinct(), "candidates")
        return self.records.join(broadcast_if_small(ids), "id", "left_semi")

    def ranked(self, query: str, limit: int = 20) -> DataFrame:
        """The rows of ``search.ranked``, scored for the candidates of the query's terms alone."""
        terms = search.search_terms(query)
        if not query or not terms:
            return search.ranked(self.records, query, limit)
        sets = [s for t in terms for s in (self.holding(t), self.alike(t, 0.15))]
        return search.ranked(self._any(sets), query, limit)

    def relaxed(self, task: str, least: float = 0.08, limit: int = 30) -> DataFrame:
        """The rows of ``search.relaxed``, likewise."""
        terms = search.search_terms(task)
        if not terms:
            return search.relaxed(self.records, task, least, limit)
        return search.relaxed(self._any([self.holding(t) for t in terms]), task, least, limit)

    def hybrid(self, query: str, limit: int = 10) -> DataFrame:
        """The rows of ``search.hybrid`` without a vector, likewise."""
        return search.hybrid(self._any([self.alike(query, 0.03), self.holding(query)]), query, None, limit)
