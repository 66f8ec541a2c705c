"""Near-duplicate documents by MinHash: many universal hash minima, banding, verification on signatures, then on whole
shingle sets, and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, drop_rows, forest, grouped, inner_name, small, texts
from siltstone.llm.components import connected_components
from siltstone.llm.shingles import MinHash, shingle_sets, sizes_of_intersections

#: Members of a block: a larger bucket or family is dealt over blocks of about so many (see ``_linked``).
BUCKET_BLOCK, FAMILY_BLOCK = 256, 128
#: Standard errors of a signature's estimate by which a pair may fall short and still be verified on its whole sets.
SLACK = 5.0


def _signatures(width: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            ids = batch.column(0)
            for first, parts in texts(batch.column(1)):
                out: dict[str, list] = {"n": [], "set_key": [], "bands": [], "signature": []}
                for hashes in shingle_sets(parts, width):
                    out["n"].append(len(hashes))
                    if len(hashes):
                        minima = minhash.minima(hashes)
                        out["set_key"].append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                        out["bands"].append(minhash.keys(minima))
                        out["signature"].append(minima.astype(np.uint16).tobytes())
                    else:
                        for k in ("set_key", "bands", "signature"):
                            out[k].append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(parts)),
                        pa.array(out["n"], pa.int64()),
                        pa.array(out["set_key"], pa.binary()),
                        pa.array(out["bands"], pa.list_(pa.int64())),
                        pa.array(out["signature"], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
                )

    return run


def _links(tiles: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The spanning forests of tiles as links (u, v), some thousand to a batch."""
    us, vs, size = [], [], 0
    for nodes, label in tiles:
        away = np.flatnonzero(label != np.arange(len(nodes)))
        us.append(nodes[away])
        vs.append(nodes[label[away]])
        size += len(away)
        if size > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
            us, vs, size = [], [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _plausible(least: float) -> Callable:
    """Links of each tile's pairs whose signatures agree in at least the share ``least``."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t in grouped(batches, "tile"):
            node = t.column("node").to_numpy()
            if len(node) < 2:
                continue
            order = np.argsort(node, kind="stable")
            node, raw = node[order], t.column("signature").take(pa.array(order)).to_pylist()
            signs = np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(len(node), -1)
            a, b = [], []
            for i in range(len(node) - 1):
                near = (signs[i + 1 :] == signs[i]).mean(axis=1) >= least
                near = np.flatnonzero(near | (node[i + 1 :] == node[i])) + i + 1
                a.append(np.full(len(near), i))
                b.append(near)
            yield node, forest(len(node), np.concatenate(a), np.concatenate(b))

    return lambda batches: _links(tiles(batches))


def _confirmed(percent: int) -> Callable:
    """Links of each tile's pairs with 100 * intersection >= percent * union of their whole sets.

    Rows that are connected already are not compared again, so a tile of like copies costs little more than one
    comparison a row.
    """

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for t in grouped(batches, "tile"):
            node = t.column("node").to_numpy()
            if len(node) < 2:
                continue
            order = np.argsort(node, kind="stable")
            node = node[order]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("hashes").take(pa.array(order)).to_pylist()]
            sizes = np.array([len(x) for x in sets])
            label = np.arange(len(node))
            for i in range(len(node) - 1):
                like = np.minimum(sizes, sizes[i]) * 100 >= percent * np.maximum(sizes, sizes[i])
                rest = np.flatnonzero(like & ((label != label[i]) | (node == node[i])))
                rest = rest[rest > i]
                if not len(rest):
                    continue
                begins = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
                shared = sizes_of_intersections(sets[i], np.concatenate([sets[j] for j in rest]), begins)
                linked = rest[(100 * shared >= percent * (sizes[i] + sizes[rest] - shared)) | (node[rest] == node[i])]
                if len(linked):
                    joined = np.isin(label, np.append(label[linked], label[i]))
                    label[joined] = label[joined].min()
            yield node, label

    return lambda batches: _links(tiles(batches))


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for first, parts in texts(batch.column("text")):
                part = rest.slice(first, len(parts))
                hashes = pa.array([x.tobytes() for x in shingle_sets(parts, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, hashes], [*part.schema.names, "hashes"])

    return run


def _linked(members: DataFrame, compare: Callable[[DataFrame], DataFrame], block: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) that connect what the pairs within groups connect, for ``members`` (group, node), a written table.

    ``compare`` makes links of (tile, node). First every group is cut into blocks of about ``block`` members by a hash
    of the node, and each row meets its block alone. For a group of one block that is all. In larger ones what is still
    apart is compared across blocks: the members in the largest component so far meet those outside it, which also meet
    one another. So a group of near copies costs rows in proportion to its size, and only members that are unlike each
    other cost more: one tile for each pair of blocks of such.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("size"))
    sizes = scratch.save(sizes.where("size > 1"), "groups")
    dealt = members.join(sizes, "group")
    near = F.expr("xxhash64(group, pmod(xxhash64(node), blocks))")
    links = scratch.save(compare(dealt.select(near.alias("tile"), "node")), "links")
    large = sizes.where("blocks > 1").select("group")
    if large.isEmpty():
        return links

    components = connected_components(links, scratch)
    named = members.join(large, "group").join(components, "node", "left")
    named = scratch.save(named.select("group", "node", F.coalesce("component", "node").alias("component")), "apart")
    parts = named.groupBy("group", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("group").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.ceil(F.max("n") / block).alias("mains"),
        F.ceil((F.sum("n") - F.max("n")) / block).alias("others"),
    )
    rows = named.join(parts.where("others > 0"), "group")
    inside, outside = rows.where("component = main"), rows.where("component <> main")
    inside = inside.withColumn("i", F.expr("pmod(xxhash64(node), mains)")).withColumn("j", F.explode(F.expr("sequence(0L, others - 1)")))
    outside = outside.withColumn("own", F.expr("pmod(xxhash64(node), others)"))
    across = outside.withColumn("i", F.explode(F.expr("sequence(0L, mains - 1)"))).withColumn("j", F.col("own"))
    among = outside.withColumn("other", F.explode(F.expr("sequence(0L, others - 1)")))
    among = among.select("node", F.expr("xxhash64(group, 'among', least(own, other), greatest(own, other))").alias("tile"))
    tiles = F.expr("xxhash64(group, 'across', i, j)").alias("tile")
    again = inside.select("node", tiles).unionByName(across.select("node", tiles)).unionByName(among)
    return links.unionByName(scratch.save(compare(again), "links"))


def near_duplicates(
    docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, bands: int = 30, rows: int = 5
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text string; more are ignored).

    Two documents are linked if their sets of ``width``-word shingles have 100 * intersection >= ``percent`` * union;
    component_id is the smallest doc_id reachable by links, itself included; kept marks the rows whose doc_id that is.

    1. Every whole text gets ``bands`` * ``rows`` hash minima. Documents with equal sets form a class; its smallest
       doc_id stands for it from here on, so thousands of copies cost no more than one.
    2. A band's minima name a bucket. Within buckets pairs whose signatures agree to within SLACK standard errors of the
       threshold are found, and each tile gives a spanning forest of them, never all pairs (see ``_linked``).
    3. The components of these links are families. Their texts alone are read again, and pairs within a family are
       confirmed on their whole sets in the same way; the components of the confirmed links are the result.

    A pair at the threshold is missed with a probability below 1e-5: it shares no band (see MinHash), or its signature
    falls SLACK standard errors short.

    Null or wordless texts have n_shingles 0 and are linked with nothing. Rows with a null doc_id are kept, with a
    null component_id. Rows that repeat a doc_id count as one document, which has the links of all its texts. An empty
    table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, n_shingles long, set_key binary, bands array<bigint>, signature binary"
    signed = scratch.save(source.mapInArrow(_signatures(width, bands, rows), kind), "signed")
    whole = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(whole.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")

    keys = ["set_key", "doc_id"]
    heads = whole.join(classes.withColumnRenamed("node", "doc_id"), keys).withColumnRenamed("doc_id", "node")
    heads = scratch.save(heads.select("node", "bands", "signature"), "heads")
    entries = scratch.save(heads.select("node", F.explode("bands").alias("group")), "entries")
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5

    def by_signature(tiles: DataFrame) -> DataFrame:
        signed = tiles.join(heads.select("node", "signature"), "node").select("tile", "node", "signature")
        return signed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_plausible(least), "u long, v long")

    def by_sets(tiles: DataFrame) -> DataFrame:
        told = tiles.join(source, F.col("doc_id") == F.col("node")).select("tile", "node", "text")
        sets = told.mapInArrow(_sets(width), "tile long, node long, hashes binary")
        return sets.repartition("tile").sortWithinPartitions("tile").mapInArrow(_confirmed(percent), "u long, v long")

    families = connected_components(_linked(entries, by_signature, BUCKET_BLOCK, scratch), scratch)
    families = scratch.save(families.select(F.col("component").alias("group"), "node"), "families")
    confirmed = _linked(families, by_sets, FAMILY_BLOCK, scratch)
    named = whole.select("doc_id", "set_key").distinct()
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = named.join(small(scratch.save(repeated, "repeated")), "doc_id").join(classes, "set_key")
    same = same.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = connected_components(confirmed.unionByName(same), scratch)

    named = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    named = scratch.save(named, "named")
    copies = whole.select("doc_id", "n_shingles", "set_key").join(named, "set_key")
    alone = signed.where("n_shingles = 0 or doc_id is null").withColumn("component", F.col("doc_id"))
    scratch.drop(heads)
    return copies.unionByName(alone.select(*copies.columns)).select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one document of each group of near-duplicates.

    The one with the smallest doc_id stays. Of rows that repeat a doc_id, the one with the smallest text does. Rows
    with a null doc_id all stay, as do rows without words, unless they repeat a doc_id.
    """
    judged = near_duplicates(docs, scratch, width, percent).where("doc_id is not null")
    gone = judged.where("not kept").select("doc_id").distinct()
    left = drop_rows(docs, scratch.save(gone, "gone"))
    repeated = judged.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = small(scratch.save(repeated, "repeated"))
    rank = inner_name(docs, "rank")
    some = left.join(repeated, "doc_id", "left_semi")
    some = some.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    once = left.join(repeated, "doc_id", "left_anti")
    return once.unionByName(some.where(F.col(rank) == 1).drop(rank))
