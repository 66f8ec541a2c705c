"""A written table of the entities of all records, by buckets of their normalised names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.search import entity_index
from siltstone.sources.persisted import read_table, write_table

#: Buckets of names, and the files over which the rows of one are dealt, so that a name that most records have is no one task.
BUCKETS, FILES = 64, 8


class EntityTable:
    """(id, entity, normalized_entity, entity_type, weight), written under ``path``. A lookup reads the buckets of its names."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = read_table(spark, path)

    @classmethod
    def build(cls, records: DataFrame, path: str) -> EntityTable:
        """Writes the entities of ``records`` (id, content, tags); ids are unique."""
        rows = entity_index(records).withColumn("bucket", bucket_of(F.col("normalized_entity")))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(FILES)))
        write_table(dealt.sortWithinPartitions("bucket", "normalized_entity", "id"), path, "bucket")
        return cls(records.sparkSession, path)

    def named(self, *names: str) -> DataFrame:
        """The rows of some normalised names; the bucket prunes folders, the name row groups."""
        buckets = [bucket_of(F.lit(n)) for n in names]
        return self.rows.where(F.col("bucket").isin(*buckets) & F.col("normalized_entity").isin(*names)).drop("bucket")


def bucket_of(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")
