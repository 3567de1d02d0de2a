"""Rewriting stage: cached answers, a pluggable rewriter, checks, and the best of several attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postloom.functions import text as tx
from postloom.operators import redact, style
from postloom.plans.lineage import cut


class CacheMiss(RuntimeError):
    """Offline mode, and an answer isn't in the cache."""


class BudgetExceeded(RuntimeError):
    """The answers so far cost more than allowed."""


#: Takes prompts, gives (text, cost) for each.
Rewriter = Callable[[list[str]], list[tuple[str, float]]]


def prompt_key(*parts: Column) -> Column:
    """Digest of what is sent: equal prompts share their answer."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts)))), 256)


CACHE = "prompt_key string, text string, cost double, model string"


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """Cached answers of a folder; none if it isn't there yet."""
    if path is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)


def write_cache(new: DataFrame, path: str) -> None:
    """Adds new answers to the folder of cached ones."""
    new.select("prompt_key", "text", "cost", "model").write.mode("append").parquet(path)


def patiently(rewriter: Rewriter, tries: int = 6, wait: float = 1.0) -> Rewriter:
    """The rewriter, asked again after a growing pause when it raises an error of connection or time."""

    def ask(prompts: list[str]) -> list[tuple[str, float]]:
        for k in range(tries):
            try:
                return rewriter(prompts)
            except (ConnectionError, TimeoutError):
                if k + 1 == tries:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError

    return ask


def answer(prompts: DataFrame, cache: DataFrame, rewriter: Rewriter | None, model: str, budget: float | None = None, workers: int = 2, batch: int = 100_000, cost_each: float = 0.0, cache_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, new) for ``prompts(id, prompt)``: answers of the ``cache(prompt_key, text, cost, model)`` first, the rest by the rewriter.

    Equal prompts are asked once. Without rewriter (offline) a prompt that isn't cached is an error. The rewriter runs in ``workers`` tasks, so
    as many requests are under way at a time; its answers are cut into the checkpoint folder, so a lost executor doesn't ask again, and added
    to the cache at ``cache_path``. Prompts are asked in batches of about ``batch``; before each, what was spent and what it will cost
    (``cost_each`` a prompt) is held against the budget.
    """
    keyed = prompts.withColumn("prompt_key", prompt_key(F.lit(model), F.col("prompt")))
    missing = keyed.join(cache.select("prompt_key"), "prompt_key", "left_anti").select("prompt_key", "prompt").dropDuplicates(["prompt_key"])
    new = cache.limit(0).select("prompt_key", "text", "cost", "model")
    if rewriter is None:
        if missing.limit(1).count():
            raise CacheMiss("answers are missing from the cache")
    else:
        ask = patiently(rewriter)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                done = ask(list(pdf["prompt"]))
                yield pd.DataFrame({"prompt_key": pdf["prompt_key"], "text": [t for t, _ in done], "cost": [c for _, c in done], "model": model})

        n = missing.count() if budget is not None else 0
        blocks, spent = max(1, -(-n // batch)), 0.0
        for k in range(blocks):
            if budget is not None and spent + cost_each * min(batch, n) > budget:
                raise BudgetExceeded(f"{spent:.4f} of {budget:.4f} spent, the next {min(batch, n)} prompts would go beyond it")
            own = missing if blocks == 1 else missing.filter(F.pmod(F.xxhash64("prompt_key"), F.lit(blocks)) == k)
            got = cut(own.repartition(workers).mapInPandas(run, CACHE))
            if cache_path is not None:
                write_cache(got, cache_path)
            new = got if blocks == 1 else new.unionByName(got)
            if budget is not None:
                spent += got.agg(F.sum("cost")).first()[0] or 0.0
                if spent > budget:
                    raise BudgetExceeded(f"spent {spent:.4f} of {budget:.4f}")
    known = cache.select("prompt_key", "text", "cost", "model").unionByName(new)
    return keyed.join(known, "prompt_key").select("id", "prompt_key", "text", "cost"), new


def cost_report(answers: DataFrame, new: DataFrame) -> DataFrame:
    """One row: answers, distinct prompts, how many were asked now, what they cost, and what all of the distinct ones cost when asked."""
    once = answers.groupBy("prompt_key").agg(F.count("*").alias("n"), F.max("cost").alias("cost")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_answers"), F.count("*").alias("n_prompts"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("whole_cost"))
    return once.join(F.broadcast(new.agg(F.count("*").alias("n_asked"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("new_cost"))))  # one row each


def problems(source: Column, derived: Column, terms: Column, signer: Column, names: Column | None = None, quoted: tuple[Column, Column] | None = None) -> Column:
    """Names of the checks that a derived text fails, in a fixed order. ``names`` must stay; ``quoted`` are the source's and the derived history."""
    words, got = tx.word_count(F.coalesce(source, F.lit(""))), tx.word_count(F.coalesce(derived, F.lit("")))
    ratio = F.try_divide(got, words)
    return F.array_compact(
        F.array(
            F.when(F.coalesce(derived, F.lit("")) == "", "format"),
            F.when(F.coalesce(derived, F.lit("")).rlike(redact.PLACEHOLDER), "placeholder"),
            F.when(F.size(redact.leaks(derived, terms)) > 0, "leak"),
            F.when((words >= 25) & ~ratio.between(0.5, 1.8), "length"),
            F.when(style.signer_missing(source, derived, signer), "signer"),
            *([F.when(F.exists(names, lambda n: ~F.contains(F.lower(_whole(derived, quoted)), F.lower(n))), "names")] if names is not None else []),
            *([F.when(quoted[0].rlike(r"\S") & ~F.coalesce(quoted[1], F.lit("")).rlike(r"\S"), "quoted")] if quoted is not None else []),
        )
    )


def _whole(derived: Column, quoted: tuple[Column, Column] | None) -> Column:
    return F.coalesce(derived, F.lit("")) if quoted is None else F.concat_ws("\n", derived, quoted[1])


def best(attempts: DataFrame) -> DataFrame:
    """Of ``attempts(id, attempt, text, problems)`` the one with fewest problems, the earliest on ties."""
    return attempts.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(F.size("problems"), "attempt"))).filter("_rank = 1").drop("_rank")


def rewrite(docs: DataFrame, cache: DataFrame, rewriter: Rewriter | None, model: str = "stub", rounds: int = 3, budget: float | None = None) -> DataFrame:
    """(id, attempt, text, problems, forced) of ``docs(id, text, terms, signer)``: up to ``rounds`` attempts, of which the best is kept.

    A document is asked again, with its problems named, while it has some; what still leaks at the end is redacted by force. Each round asks
    only for the documents left over, and its rows are cut into the checkpoint folder.
    """
    docs = cut(docs.select("id", "text", "terms", "signer"))
    todo = docs.withColumn("hint", F.lit(""))
    done = None
    for k in range(1, rounds + 1):
        prompts = todo.select("id", F.concat_ws("\n", F.col("hint"), F.col("text")).alias("prompt"))
        answers, new = answer(prompts, cache, rewriter, model, budget)
        cache = cache.select("prompt_key", "text", "cost", "model").unionByName(new.select("prompt_key", "text", "cost", "model"))
        checked = cut(todo.drop("hint").join(answers.select("id", F.col("text").alias("out")), "id").withColumn("problems", problems(F.col("text"), F.col("out"), F.col("terms"), F.col("signer"))))
        own = checked.select("id", F.lit(k).alias("attempt"), F.col("out").alias("text"), "problems")
        done = own if done is None else done.unionByName(own)
        left = checked.filter(F.size("problems") > 0).withColumn("hint", F.concat(F.lit(f"{k}: "), F.array_join("problems", ", ")))
        if k == rounds or not left.limit(1).count():
            break
        todo = left.select(*docs.columns, "hint")
    chosen = best(done).join(docs.select("id", "terms"), "id")
    leaky = F.array_contains("problems", "leak")
    return chosen.select("id", "attempt", F.when(leaky, redact.force_redact(F.col("text"), F.col("terms"))).otherwise(F.col("text")).alias("text"), "problems", leaky.alias("forced"))
