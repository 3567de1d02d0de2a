"""Judging rewritten messages: prompts, replies as records, and their summary."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from postloom.operators.evaluate import agreement
from postloom.operators.parse import json_object
from postloom.operators.rewrite import Rewriter, answer

LABELS = "category string, intent string, sentiment string, privileged_likely boolean, action_required boolean, sensitive boolean"
_REPLY = f"realism int, artifacts array<string>, real string, {LABELS}"
KINDS = ("realism_source", "realism_derived", "labels_source", "labels_derived", "pair")


def prompts(pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """(id, kind, prompt) for ``pairs(idx, source, derived)``: realism and labels of either text, and which of both is real. The real one stands first for even idx. Texts go in whole; for a model with a limit, ``longest`` gives the characters taken of each."""
    source, derived = (t if longest is None else F.left(t, F.lit(longest)) for t in (F.coalesce(c, F.lit("")) for c in ("source", "derived")))
    first = F.col("idx") % 2 == 0
    both = F.concat(F.lit("A:\n"), F.when(first, source).otherwise(derived), F.lit("\n\nB:\n"), F.when(first, derived).otherwise(source))
    asked = (("realism_source", "Rate from 1 to 5 how real this message seems, and list artifacts, as JSON.\n", source), ("realism_derived", "Rate from 1 to 5 how real this message seems, and list artifacts, as JSON.\n", derived), ("labels_source", "Label this message as JSON.\n", source), ("labels_derived", "Label this message as JSON.\n", derived), ("pair", "Which of the two is real, A or B? Answer as JSON.\n", both))
    return pairs.select("idx", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(F.lit(q), t).alias("prompt")) for k, q, t in asked))).alias("x")).select(F.concat_ws("/", "idx", "x.kind").alias("id"), "idx", "x.kind", "x.prompt")


def judge(pairs: DataFrame, cache: DataFrame, judge_model: Rewriter | None, model: str = "judge", budget: float | None = None, longest: int | None = None, cache_path: str | None = None) -> DataFrame:
    """(idx, kind, reply): replies as records; what can't be read is null. Answers come from the cache first, as in rewriting, and new ones are added at ``cache_path``. ``longest`` as in ``prompts``."""
    asked = prompts(pairs, longest)
    answers, _ = answer(asked.select("id", "prompt"), cache, judge_model, model, budget, cache_path=cache_path)
    return asked.select("id", "idx", "kind").join(answers, "id").select("idx", "kind", json_object(F.col("text"), _REPLY).alias("reply"))


def realism(replies: DataFrame) -> DataFrame:
    """Mean realism of sources and derived texts, share of pairs in which the real one was picked (picks other than A and B don't count), and the number of those pairs."""
    mean = lambda kind: F.round(F.avg(F.when(F.col("kind") == kind, F.col("reply.realism"))), 6)
    picked = F.when((F.col("kind") == "pair") & F.col("reply.real").isin("A", "B"), (F.col("reply.real") == F.when(F.col("idx") % 2 == 0, "A").otherwise("B")).cast("int"))
    return replies.agg(mean("realism_source").alias("realism_source"), mean("realism_derived").alias("realism_derived"), F.round(F.avg(picked), 6).alias("detected"), F.count(picked).alias("n_pairs"))


def top_artifacts(replies: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent artifacts, in lower case and cut at 90 characters; ties by text. A report table."""
    found = replies.filter("kind = 'realism_derived'").select(F.explode("reply.artifacts").alias("a")).select(F.left(F.lower("a"), F.lit(90)).alias("artifact"))
    return found.groupBy("artifact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artifact").limit(k)


def label_agreement(replies: DataFrame, label: str) -> DataFrame:
    """Agreement and kappa of a label between sources and derived texts."""
    side = lambda kind, name: replies.filter(F.col("kind") == kind).select("idx", F.col(f"reply.{label}").cast("string").alias(name))
    return agreement(side("labels_source", "a").join(side("labels_derived", "b"), "idx"), "a", "b").withColumn("label", F.lit(label))


def offline_judge(asked: list[str]) -> list[tuple[str, float]]:
    """Deterministic stand-in for a service: replies that only depend on the prompt."""
    out = []
    for p in asked:
        h = hashlib.sha256(p.encode()).digest()
        reply = {"realism": 1 + h[0] % 5, "artifacts": [f"artifact {h[1] % 7}"], "real": "AB"[h[2] % 2], "category": f"c{len(p) % 3}", "intent": f"i{len(p) % 4}", "sentiment": "neutral", "privileged_likely": False, "action_required": "?" in p, "sensitive": bool(h[3] % 2)}
        out.append((f"Here it is: {json.dumps(reply)}", 0.0001))
    return out
