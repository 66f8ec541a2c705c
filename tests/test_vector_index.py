"""The written vector index against scans of all vectors: same rows, ties included, and fewer cells opened."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import curation, search
from siltstone.operators.vector_index import VectorIndex
from siltstone.sources.persisted import persisted
from siltstone.sources.scratch import shared_folder

KIND = "id long, embedding array<float>, label int"


def clustered(n, wide, spread, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(wide, dim))[np.arange(n) % wide] + spread * rng.normal(size=(n, dim))


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], KIND)


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_nearest_equals_a_scan_and_opens_fewer_cells_on_clusters(spark, folder, spread):
    x = clustered(900, 30, spread)
    x[700:760] = x[3]  # copies: more than k rows tie
    vectors = table(spark, x)
    index = VectorIndex.build(vectors, f"{folder}/index", cell=32, fan=8)
    leaves = index.nodes.where("leaf").count()
    assert index.nodes.where("leaf").agg(F.sum("n")).first()[0] == 900 and leaves > 20
    for query in (x[3], x[17] * 7):
        asked = [float(v) for v in query]
        for k, threshold, labels in ((25, 0.4, (1,)), (100, -1.0, (0, 1, 2))):
            got = index.nearest(asked, k, threshold, F.col("label").isin(*labels)).collect()
            want = search.nearest(vectors.where(F.col("label").isin(*labels)), asked, k, threshold).collect()
            assert sorted(got, key=lambda r: (-r.score, r.id)) == sorted(want, key=lambda r: (-r.score, r.id))
    index.nearest([float(v) for v in x[17]], 10)
    assert index.opened <= (leaves / 3 if spread < 1 else leaves + 1)


def test_a_search_reads_the_partitions_of_its_cells_alone(spark, folder):
    index = VectorIndex.build(table(spark, clustered(600, 30, 0.05)), f"{folder}/index", cell=30, fan=8)
    some = index.nodes.where("leaf").orderBy("node").select("part", "node").first()
    plan = index.cells([(some.part, some.node)])._jdf.queryExecution().executedPlan().toString()
    assert f"(part#" in plan.split("PartitionFilters: [")[1] and "(cell," in plan.split("PushedFilters: [")[1]
    read = index.cells([(some.part, some.node)]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("part=")[1].split("/")[0] for r in read} == {some.part}


@pytest.mark.parametrize("spread, least", [(0.05, 0.3), (0.4, 0.9)])
def test_pairs_equal_the_tiles(spark, folder, spread, least):
    x = clustered(500, 20, spread, seed=5)
    x[100:110] = x[7]
    vectors = table(spark, x)
    units = curation.units(vectors.withColumn("block", F.lit(0)).drop("label"))
    plain = {(r.a, r.b): round(r.score, 9) for r in curation.similar_pairs(units, least).collect()}
    index = VectorIndex.build(vectors, f"{folder}/index", cell=24, fan=5)
    assert {(r.a, r.b): round(r.score, 9) for r in index.pairs(least).collect()} == plain


def test_clusters_leave_most_cells_unvisited(spark, folder):
    vectors = table(spark, clustered(800, 40, 0.03))
    index = VectorIndex.build(vectors, f"{folder}/index", cell=25, fan=8)
    units = curation.units(vectors).select("id", "unit")
    visits, leaves = index.visits(units, F.lit(0.9)), index.nodes.where("leaf").count()
    assert visits.count() < 800 * leaves / 6


def test_awkward_vectors(spark, folder):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [None, 1.0], 0), (5, [math.nan, 1.0], 0), (6, [1.0, 0.0, 0.0], 0),
            (7, [2.0, 0.0], None), (None, [1.0, 0.0], 0), (8, [], 0), (9, [-1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, KIND).withColumn("Unit", F.lit("x")).withColumnRenamed("Unit", "extra")
    index = VectorIndex.build(vectors, f"{folder}/index")
    assert [(r.id, r.score) for r in index.nearest([3.0, 0.0], 10).collect()] == [(1, 1.0), (7, 1.0), (2, 0.0), (9, -1.0)]
    assert [(r.a, r.b) for r in index.pairs(0.5).collect()] == [(1, 7)]
    assert index.nearest([0.0, 0.0], 10).count() == 4
    none = VectorIndex.build(vectors.limit(0), f"{folder}/none")
    assert none.nearest([1.0, 0.0]).count() == 0 and none.pairs(0.5).count() == 0


def test_an_index_is_built_once_for_its_files(spark, folder):
    source, made = f"{folder}/source", []
    table(spark, clustered(50, 5, 0.1)).write.parquet(source)

    def build(path):
        made.append(path)
        VectorIndex.build(spark.read.parquet(source), path)

    def cut_off(path):
        VectorIndex.build(spark.read.parquet(source), path)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        persisted(spark, "vectors", [source], cut_off, folder)
    paths = {persisted(spark, "vectors", [source], build, folder) for _ in range(2)}
    assert paths == set(made) and len(made) == 1
    table(spark, clustered(5, 5, 0.1)).withColumn("id", F.col("id") + 100).write.mode("append").parquet(source)
    assert persisted(spark, "vectors", [source], build, folder) not in paths
    assert VectorIndex(spark, made[1]).vectors.count() == 55
