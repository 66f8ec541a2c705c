"""Rule curation: every record is judged in one pass over its own columns; groups by title key take one shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text, vector
from siltstone.functions.scores import days_before
from siltstone.model import FRAGMENT_SOURCES, PRECIOUS, Curation

#: Vectors of one side of a tile of ``similar_pairs``.
TILE = 4096


def rules(as_of: str, c: Curation = Curation()) -> dict[str, Column]:
    """The candidate lists as conditions on a record's columns. Frozen records are in none of them."""
    before = lambda column, days: F.col(column) < days_before(as_of, days)
    kind, status = F.col("type"), F.col("status")
    importance = F.coalesce("importance", F.lit(0.5))
    feedback = F.coalesce("feedback_score", F.lit(0.0))
    effectiveness = F.coalesce("effectiveness_score", F.lit(0.5))
    injected = F.coalesce("injected_count", F.lit(0))
    decay = F.coalesce("decay_policy", F.lit("review"))
    precious, episodic = kind.isin(*PRECIOUS), kind == "episodic_memory"
    loose = ~decay.isin("freeze", "stable")
    unseen = F.col("last_accessed_at").isNull()
    out = {
        "revival": (status == "stale") & ~episodic & (F.col("last_injected_at") >= days_before(as_of, c.revival_days))
        & (effectiveness >= c.revival_effectiveness) & (feedback >= c.revival_feedback),
        "promote": (status == "candidate")
        & (((importance >= c.promote_importance) & (feedback >= 0)) | (injected >= c.promote_injected)),
        "low_feedback": status.isin("active", "candidate") & (feedback < c.low_feedback) & ~precious,
        "precious_stale": (status == "active") & precious & (feedback < c.precious_feedback)
        & (importance < c.precious_importance) & loose,
        "episodic_stale": episodic & (status == "active") & before("updated_at", c.episodic_stale_days)
        & (importance < c.episodic_importance),
        "stale": (status == "active") & ~precious & ~episodic & before("updated_at", c.stale_days)
        & (importance < c.stale_importance) & (feedback <= c.stale_feedback) & loose,
        "episodic_archive": episodic & (status == "stale") & before("updated_at", c.episodic_archive_days),
        "archive": (status == "stale") & ~episodic & before("updated_at", c.archive_days),
        "dead": (status == "candidate") & (
            (episodic & before("updated_at", c.episodic_candidate_days) & (importance < c.episodic_importance))
            | (precious & before("updated_at", c.precious_candidate_days) & (importance < 0.4) & (feedback < 0))
            | (~precious & ~episodic & before("updated_at", c.candidate_days) & (importance < 0.5))
        ),
        "never_accessed": (status == "candidate") & unseen & (injected == 0)
        & before("updated_at", c.never_accessed_days) & ~precious,
        "unused": (status == "active") & (injected == 0) & ~precious & (importance < 0.9)
        & before("updated_at", c.unused_days) & loose,
        "unused_fragment": (status == "active") & (injected == 0) & F.col("source").isin(*FRAGMENT_SOURCES)
        & before("created_at", c.fragment_days) & loose,
        "contradicted": (status == "contradicted") & (unseen | before("last_accessed_at", c.contradicted_days)),
        "auto_decay": (status == "active") & (decay == "review") & (unseen | before("last_accessed_at", c.decay_days))
        & (effectiveness < 0.3) & (importance < 0.5) & (injected > 0)
        & (F.coalesce("confidence", F.lit(0.7)) > c.least_confidence),
        "skill_promotion": (kind == "skill_candidate") & status.isin("active", "candidate")
        & (importance >= c.skill_importance) & (feedback >= c.skill_feedback),
        "evolution": status.isin("active", "candidate")
        & ((F.length(F.coalesce("content", F.lit(""))) < 50) | (feedback < -1.5)),
    }
    return {k: F.coalesce((decay != "freeze") & v, F.lit(False)) for k, v in out.items()}


#: (rule, action, reason, status that follows) in the order in which rules claim a record: fixed values.
PLAN = (
    ("revival", "revive", "stale_revival", "active"),
    ("promote", "promote", "high_importance_candidate", "active"),
    ("low_feedback", "mark_stale", "low_feedback", "stale"),
    ("precious_stale", "mark_stale", "precious_negative_feedback", "stale"),
    ("episodic_stale", "mark_stale", "episodic_aged", "stale"),
    ("stale", "mark_stale", "stale_candidate", "stale"),
    ("episodic_archive", "archive", "episodic_archive", "archived"),
    ("archive", "archive", "archive_candidate", "archived"),
    ("dead", "archive", "dead_candidate", "archived"),
    ("never_accessed", "archive", "never_accessed_candidate", "archived"),
    ("unused", "mark_stale", "unused_30_days", "stale"),
    ("unused_fragment", "mark_stale", "unused_fragment_14_days", "stale"),
    ("contradicted", "archive", "contradicted_expired", "archived"),
)


def candidates(memories: DataFrame, as_of: str, c: Curation = Curation()) -> DataFrame:
    """(id, and a boolean for each rule)."""
    return memories.select("id", *(cond.alias(name) for name, cond in rules(as_of, c).items()))


def summary(memories: DataFrame, as_of: str, c: Curation = Curation()) -> DataFrame:
    """One row: how many records each rule finds, and how many there are."""
    return memories.agg(F.count("*").alias("scanned"), *(F.count_if(v).alias(k) for k, v in rules(as_of, c).items()))


def action_plan(
    memories: DataFrame, as_of: str, c: Curation = Curation(), allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()
) -> DataFrame:
    """(id, action, reason, target_status, old_status): the first rule that claims each record. An action that isn't
    allowed leaves the record to later rules."""
    found = rules(as_of, c)
    steps = [s for s in PLAN if (not allow or s[1] in allow) and s[1] not in deny]
    names = ("action", "reason", "target_status")
    whens = [F.when(found[s[0]], F.struct(*(F.lit(x).alias(n) for n, x in zip(names, s[1:])))) for s in steps]
    planned = memories.select("id", "status", F.coalesce(*whens).alias("plan")).where("plan is not null")
    return planned.select("id", "plan.*", F.col("status").alias("old_status"))


def applied(memories: DataFrame, plan: DataFrame, as_of: str, c: Curation = Curation()) -> DataFrame:
    """(id, status, confidence) after the plan and the decay of confidences; children follow their parents out."""
    target = plan.select("id", F.col("target_status"))
    out = memories.select("id", "parent_id", "status", "confidence", rules(as_of, c)["auto_decay"].alias("decays"))
    out = out.join(target, "id", "left").withColumn("new", F.coalesce("target_status", "status"))
    parents = target.where("target_status <> 'active'").select(F.col("id").alias("parent_id"), F.col("target_status").alias("of_parent"))
    out = out.join(parents, "parent_id", "left")
    lower = F.greatest(F.lit(c.least_confidence), F.round(F.col("confidence") - c.decay_step, 4))
    return out.select(
        "id", F.coalesce("of_parent", "new").alias("status"), F.when(F.col("decays"), lower).otherwise(F.col("confidence")).alias("confidence")
    )


def keyed(memories: DataFrame) -> DataFrame:
    return memories.withColumn("title_key", text.title_key(F.col("title"))).where("title_key <> ''")


def duplicate_titles(memories: DataFrame) -> DataFrame:
    """(title_key, n, first_id) of keys that several records share."""
    groups = keyed(memories).groupBy("title_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return groups.where("n > 1")


def supersessions(memories: DataFrame) -> DataFrame:
    """(old_id, new_id, review_required): active records whose key, type, scope and project a newer one has. The newest
    of each is found by an aggregate and joined back, so a key that many records share is no task of its own."""
    group = ["title_key", "type", "scope", "project_path"]
    active = keyed(memories.where("status = 'active'"))
    newest = F.max_by("id", F.struct(F.coalesce("updated_at", "created_at"), -F.col("id"))).alias("new_id")
    heads = active.groupBy(*(F.col(c).alias(f"of_{c}") for c in group)).agg(newest)
    active = active.join(heads, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group])
    review = F.col("type").isin(*PRECIOUS) | (F.coalesce("importance", F.lit(0.0)) >= 0.7)
    return active.where("id <> new_id").select(F.col("id").alias("old_id"), "new_id", review.alias("review_required"))


def contradictions(memories: DataFrame) -> DataFrame:
    """(title_key, n_active, n_contradicted) of keys that active and contradicted records share."""
    n = lambda s: F.count_if(F.col("status") == s)
    groups = keyed(memories).groupBy("title_key").agg(n("active").alias("n_active"), n("contradicted").alias("n_contradicted"))
    return groups.where("n_active > 0 and n_contradicted > 0")


def similar_pairs(vectors: DataFrame, least: float, k: int = 6) -> DataFrame:
    """(a, b, score) of pairs in either side's ``k`` - 1 nearest vectors of its own block (id, block, unit), at ``least``.

    A block, which may be the whole table, is cut into tiles of about TILE by TILE vectors. Each is a product of two
    matrices in one task that keeps a row's nearest ones, by score and then id, before the tiles' rows meet. Every pair
    within a block is looked at: the products grow with the square of its size, rows that leave a tile do not.
    """
    given = vectors.where("id is not null and block is not null").select("id", "block", "unit", F.size("unit").alias("width"))
    sizes = given.groupBy("block", "width").agg(F.ceil(F.count("*") / TILE).alias("cuts"))
    dealt = given.join(sizes, ["block", "width"])
    every = F.explode(F.expr("sequence(0L, cuts - 1)"))
    left = dealt.withColumn("i", F.expr("pmod(xxhash64(id), cuts)")).withColumn("j", every).withColumn("left", F.lit(True))
    right = dealt.withColumn("j", F.expr("pmod(xxhash64(id), cuts)")).withColumn("i", every).withColumn("left", F.lit(False))
    tiles = left.unionByName(right).groupBy("block", "width", "i", "j")
    kind = f"a {vectors.schema['id'].dataType.simpleString()}, b {vectors.schema['id'].dataType.simpleString()}, score double"
    near = tiles.applyInPandas(_nearest(least, k - 1), kind)
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    top = near.withColumn("nth", nth).where(F.col("nth") < k)
    return top.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def _nearest(least: float, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The ``k`` nearest right rows of each left row of a tile. Scores are rounded so that equal vectors tie."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = tile[tile["left"]], tile[~tile["left"]].sort_values("id")
        ids, others = ours["id"].to_numpy(), theirs["id"].to_numpy()
        out = [(ids[:0], others[:0], np.zeros(0))]
        if len(ids) and len(others):
            x, y = np.stack(ours["unit"].to_list()), np.stack(theirs["unit"].to_list())
            for s in range(0, len(ids), 256):
                score = np.round(x[s : s + 256] @ y.T, 12)
                score[~(score >= least) | (ids[s : s + 256, None] == others)] = -np.inf
                last = np.partition(score, max(0, len(others) - k), axis=1)[:, max(0, len(others) - k), None]
                kept = (score >= last) & (last > -np.inf) | (score > last)
                for tied in np.flatnonzero(kept.sum(axis=1) > k):
                    equal = np.flatnonzero(score[tied] == last[tied])
                    kept[tied, equal[k - (score[tied] > last[tied]).sum() :]] = False
                row, column = np.nonzero(kept)
                out.append((ids[s + row], others[column], score[row, column]))
        a, b, score = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"a": a, "b": b, "score": score})

    return run


def units(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``unit``, the embedding in doubles at length one, in place of the embedding; zero ones go."""
    d = vectors.withColumn("unit", vector.doubles(F.col("embedding")))
    d = d.withColumn("length", vector.norm(F.col("unit"))).where("length > 0")
    return d.withColumn("unit", F.transform("unit", lambda x: x / F.col("length"))).drop("embedding", "length")


def cooled_down(pairs: DataFrame, reviews: DataFrame, since: Column) -> DataFrame:
    """Pairs (a, b) neither side of which was reviewed (id, created_at) since the instant."""
    recent = reviews.where(F.col("created_at") >= since).select("id").distinct()
    out = pairs.join(recent.withColumnRenamed("id", "a"), "a", "left_anti")
    return out.join(recent.withColumnRenamed("id", "b"), "b", "left_anti")


def rollup_groups(memories: DataFrame, as_of: str, count: int = 30, aged: int = 5, hours: float = 24.0) -> DataFrame:
    """(scope, source_agent, project_path, n, oldest, trigger): groups of episodic candidates due for a rollup, because
    they are many, or some of them old. The oldest group goes first."""
    groups = memories.where("type = 'episodic_memory' and status in ('active', 'candidate')")
    groups = groups.groupBy("scope", "source_agent", "project_path").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))
    old = F.col("oldest") <= days_before(as_of, hours / 24)
    trigger = F.when(F.col("n") >= count, "count").when((F.col("n") >= aged) & old, "age")
    return groups.withColumn("trigger", trigger).where("trigger is not null")
