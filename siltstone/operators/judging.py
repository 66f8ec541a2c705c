"""Questions to a judge (a model that the caller brings), asked once each, in batches that survive a restart."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.parse import model_json
from siltstone.sources.scratch import broadcast_if_small, written

#: Answers to a list of prompts, in order; None where there is no answer.
Judge = Callable[[list[str]], "list[str | None]"]
REPLIES = "question string, reply string"
#: What a judge may find of a pair, each with the record that stays: fixed values.
ACTIONS = ("merge", "archive", "keep_both")


class Judgements:
    """Replies kept under ``path`` by a digest of what was asked. A batch is put in place by one rename when all of it is
    answered, so a run that ends after any batch goes on with the next, whoever starts it. Two runs at once may ask the same."""

    def __init__(self, spark: SparkSession, path: str, version: str = ""):
        """``version`` names judge and wording; another one asks anew."""
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/replies"))

    def question(self, prompts: DataFrame) -> DataFrame:
        """``prompts`` with the digest of each ``prompt``."""
        return prompts.withColumn("question", F.sha2(F.concat(F.lit(f"{self.version}\n"), F.col("prompt")), 256))

    def replies(self) -> DataFrame:
        """(question, reply) of all batches; of a question that two runs asked, one reply."""
        folders = [f.getPath().toString() for f in self._fs.listStatus(self._hadoop.Path(f"{self.path}/replies"))]
        if not folders:
            return self.spark.createDataFrame([], REPLIES)
        return self.spark.read.schema(REPLIES).parquet(*folders).groupBy("question").agg(F.min("reply").alias("reply"))

    def ask(self, prompts: DataFrame, judge: Judge, budget: int = 8_000_000, calls: int = 16, most: int | None = None) -> int:
        """Asks the judge for each distinct prompt (a column ``prompt``; null ones are passed over) that has no reply yet, in
        batches of about ``budget`` characters (a longer prompt is a batch of its own), ``calls`` prompts a call, and ends
        after ``most`` batches; the number of batches. A prompt without an answer is asked again by the next run, and one
        whose executor was lost, again at once."""
        return self.ask_kept(self.kept(prompts), judge, budget, calls, most)

    def kept(self, prompts: DataFrame) -> DataFrame:
        """``prompts`` with the digest of each, its length (size) and a number (nth), written: the one place where they are stored."""
        size = F.length("prompt").cast("long").alias("size")
        return written(self.question(prompts).select("*", size, F.monotonically_increasing_id().alias("nth")), "prompts")

    def ask_kept(self, kept: DataFrame, judge: Judge, budget: int = 8_000_000, calls: int = 16, most: int | None = None) -> int:
        """``ask`` for prompts that ``kept`` has written. Repeated and answered ones are told by their digests alone; the texts are
        read, and travel, only with their batch."""
        ends = self._dealt(kept.select("question", "size", "nth"), budget)
        numbers = ends.agg(F.min("batch"), F.max("batch")).first()
        done = 0
        for number in range(numbers[0], numbers[1] + 1) if numbers[0] is not None else ():
            if most is not None and done >= most:
                break
            mine = ends.where(F.col("batch") == number).select("nth")
            first, last = mine.agg(F.min("nth"), F.max("nth")).first()
            if first is None:  # a longer prompt has taken this one's characters
                continue
            batch = kept.where(F.col("nth").between(first, last)).join(broadcast_if_small(mine), "nth", "left_semi")
            tasks = self.spark.sparkContext.defaultParallelism
            said = batch.select("question", "prompt").repartition(tasks, "question").mapInPandas(_asked(judge, calls), REPLIES)
            name = uuid.uuid4().hex
            draft, place = (self._hadoop.Path(f"{self.path}/{folder}/{name}") for folder in ("drafts", "replies"))
            said.where("reply is not null").write.parquet(draft.toString())
            if not self._fs.rename(draft, place):
                raise OSError(f"can't put {place} in place")
            done += 1
        return done

    def _dealt(self, asked: DataFrame, budget: int) -> DataFrame:
        """(nth, batch) of the first prompt of each question without a reply, by running sums of their lengths in the order of
        their numbers. A batch is a range of numbers, which row groups prune."""
        once = asked.where("question is not null").groupBy("question").agg(F.min(F.struct("nth", "size")).alias("p")).select("question", "p.*")
        open_ = once.join(self.replies().select("question"), "question", "left_anti")
        sliced = written(open_.select("nth", "size", F.shiftrightunsigned("nth", 33).alias("slice")), "questions")  # a slice is a task that wrote prompts
        sums = sliced.groupBy("slice").agg(F.sum("size").alias("size"))
        before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))  # a row a slice
        own = F.sum("size").over(Window.partitionBy("slice").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
        run = sliced.select("nth", "slice", F.coalesce(own, F.lit(0)).alias("own")).join(F.broadcast(starts), "slice")
        return written(run.select("nth", F.floor((F.col("start") + F.col("own")) / budget).alias("batch")), "batches")


def _asked(judge: Judge, calls: int):
    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), calls):
                some = part.iloc[i : i + calls]
                answers = judge(some.prompt.tolist())
                if len(answers) != len(some):
                    raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
                yield pd.DataFrame({"question": some.question, "reply": pd.Series(answers, index=some.index, dtype=object)})

    return ask


def pair_prompts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, prompt): a pair's whole records (id, type, title, content) as one JSON object, the smaller id first; pairs with
    an unknown record are left out, repeated and turned ones are one."""
    once = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: records.select(F.col("id").alias(c), F.struct("id", "type", "title", "content").alias(f"record_{c}"))
    both = once.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.to_json(F.struct(F.col("record_a").alias("a"), F.col("record_b").alias("b")), {"ignoreNullFields": "false"}).alias("prompt"))


def curated(pairs: DataFrame, records: DataFrame, store: Judgements, judge: Judge, **how) -> DataFrame:
    """(a, b, action, keep, drop, reason, state): what a judge finds of the pairs, asked through a store. A reply that isn't
    JSON, has another action or keeps a record outside of the pair is ``invalid``; a pair without a reply is ``open``."""
    prompts = store.kept(pair_prompts(pairs, records))
    store.ask_kept(prompts, judge, **how)
    said = prompts.select("a", "b", "question").join(store.replies(), "question", "left")
    read = said.withColumn("r", model_json(F.col("reply"), "action string, keep long, reason string"))
    good = F.col("r.action").isin(*ACTIONS) & ((F.col("r.action") == "keep_both") | F.col("r.keep").isin(F.col("a"), F.col("b")))
    state = F.when(F.col("reply").isNull(), "open").when(F.coalesce(good, F.lit(False)), "judged").otherwise("invalid")
    one = (state == "judged") & (F.col("r.action") != "keep_both")
    return read.select(
        "a", "b", F.when(state == "judged", F.col("r.action")).alias("action"), F.when(one, F.col("r.keep")).alias("keep"),
        F.when(one, F.when(F.col("r.keep") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("drop"),
        F.when(state == "judged", F.col("r.reason")).alias("reason"), state.alias("state"),
    )
