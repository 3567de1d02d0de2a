"""Mixing sources to target shares by balanced sampling (problem 8)."""

from __future__ import annotations

import base64
import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postloom.plans.lineage import cut

#: Folder of the public tokenizers' vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).name, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens) of ``docs(doc_id, source, text)``; a null text has 0 tokens. The vocabulary file must be at the same path on every node."""
    path = str(Path(tokenizers) / vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(encode(t)) if t else 0 for t in b.column(2).to_pylist()], pa.int64())], names=["id", "source", "tokens"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "source", "text").mapInArrow(count, "id long, source string, tokens long")


def _flight(units: list[list], rng: random.Random, constraints: int) -> list[list]:
    """Moves the fractions of ``units`` [id, tokens, fraction] through the null space of the balancing constraints until too few are left.

    With two constraints (tokens, documents) three open units span one free direction, with one (documents) two units do, with none each is
    decided alone. Each move settles at least one unit, keeps both totals, and keeps every expectation.
    """
    open_: list[list] = []
    for unit in units:
        open_.append(unit)
        while len(open_) > constraints:
            if constraints == 2:
                a, b, c = open_[-3:]
                u = (b[1] - c[1], c[1] - a[1], a[1] - b[1])
                moved = (a, b, c)
                if not any(u):
                    u, moved = (1, -1), (b, c)
            elif constraints == 1:
                moved, u = (open_[-2], open_[-1]), (1, -1)
            else:
                moved, u = (open_[-1],), (1,)
            up = min((1 - x[2]) / d if d > 0 else x[2] / -d for x, d in zip(moved, u) if d)
            down = min(x[2] / d if d > 0 else (1 - x[2]) / -d for x, d in zip(moved, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for x, d in zip(moved, u):
                x[2] += step * d
                if x[2] < 1e-9 or x[2] > 1 - 1e-9:
                    x[2] = round(x[2])
            open_ = [x for x in open_ if x[2] not in (0, 1)]
    return open_


def _flights(seed: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One flight for each (mix, source, bucket) over rows sorted by these; open units wait from batch to batch. Draws depend on the seed, the key and the sorted rows only."""
        key: tuple | None = None
        waiting: list[list] = []
        rng = random.Random()

        def settle() -> list[tuple]:
            if last and waiting:  # landing: the token constraint is dropped, then that on the number of documents
                for constraints in (1, 0):
                    _flight([u for u in waiting if 0 < u[2] < 1], rng, constraints)
            return [(*key, *u) for u in waiting]

        for df in batches:
            done: list[tuple] = []
            for own_key, own in df.groupby(["mix", "source", "bucket"], dropna=False, sort=False):
                own_key = tuple(None if v is None or v != v else v for v in own_key)
                if own_key != key:
                    if key is not None:
                        done += settle()
                    key, waiting = own_key, []
                    rng = random.Random(hashlib.blake2b(f"{seed}|{key}".encode(), digest_size=8).digest())
                units = [*waiting, *([i, t, p, c] for i, t, p, c in zip(own["id"].tolist(), own["tokens"].tolist(), own["fraction"].tolist(), own["base"].tolist()))]
                waiting = _flight([u for u in units if 0 < u[2] < 1], rng, 2)
                still = {id(u) for u in waiting}
                done += [(*key, *u) for u in units if id(u) not in still]
            yield pd.DataFrame(done, columns=_COLUMNS).astype({"fraction": "float64"})
        if key is not None:
            yield pd.DataFrame(settle(), columns=_COLUMNS).astype({"fraction": "float64"})

    return run


_COLUMNS = ["mix", "source", "bucket", "id", "tokens", "fraction", "base"]
_SCHEMA = "mix string, source string, bucket long, id long, tokens long, fraction double, base int"


def plan_mixes(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, max_repeats, docs, available, wanted, base, fraction, short) for each row of ``targets``.

    ``wanted`` is the target share of the tokens of all documents. A source is short if even ``max_repeats`` uses of all its records give
    fewer; it is then used as often as allowed. Else each record is used ``base`` times, and once more with probability ``fraction``.
    A source without documents has size 0. A null share counts as 0, a null limit as 0.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    total = by_source.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    joined = targets.select(F.col("mix_name").alias("mix"), "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).join(by_source, "source", "left")
    sized = joined.join(F.broadcast(total)).withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("available", F.coalesce("available", F.lit(0)))  # one row
    wanted = sized.withColumn("wanted", F.col("target_share") * F.col("total"))
    short = (F.col("available") * F.col("max_repeats")) < F.col("wanted")
    uses = F.when(short, F.col("max_repeats").cast("double")).when(F.col("available") == 0, F.lit(0.0)).otherwise(F.least(F.try_divide(F.col("wanted"), F.col("available")), F.col("max_repeats").cast("double")))
    return wanted.withColumn("short", short).withColumn("uses", uses).withColumn("base", F.floor("uses").cast("int")).withColumn("fraction", F.col("uses") - F.floor("uses")).drop("uses", "total")


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 7, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, bucket_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of the mixes in ``targets(mix_name, source, target_share, max_repeats)`` over ``docs(doc_id, source, text)``.

    ``selection(mix, source, id, tokens, copies)`` has the records used. ``report`` has one row for each target with its sizes, the tokens and
    records used, and the actual share of the mix's tokens.

    The extra use of a record is drawn by the cube method, balanced on the tokens and the number of records of each source. Records of a
    source that may be drawn are spread by a hash of the seed and their id over buckets of about ``bucket_rows``; the flight runs in each bucket and leaves at most two
    open records there, which are gathered for a second flight and the landing, so a source of any size is never gathered. Draws depend
    on the seed, the ids and sizes only, not on how rows lie. Repeated rows are records of their own.
    """
    sizes = cut(count_tokens(docs, tokenizers, vocabulary))
    plan = cut(plan_mixes(sizes, targets))
    used = sizes.join(plan.filter("base > 0 or fraction > 0").select("mix", "source", "base", "fraction"), "source")
    largest = plan.agg(F.coalesce(F.max("docs"), F.lit(0))).first()[0]
    order = F.xxhash64(F.lit(seed), F.col("id"))
    drawn = used.filter("fraction > 0").withColumn("bucket", F.pmod(order, F.lit(max(1, -(-largest // bucket_rows))))).select(*_COLUMNS)
    sorted_ = lambda df, *by: df.repartition("mix", "source", *by).sortWithinPartitions("mix", "source", *by, F.xxhash64(F.lit(seed), F.col("id")), "id", "tokens")
    flown = cut(sorted_(drawn, "bucket").mapInPandas(_flights(seed, last=False), _SCHEMA))
    is_open = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    landed = cut(sorted_(flown.filter(is_open).withColumn("bucket", F.lit(0).cast("long"))).mapInPandas(_flights(seed + 1, last=True), _SCHEMA))
    picked = flown.filter(~is_open).unionByName(landed).unionByName(used.filter("fraction = 0").withColumn("bucket", F.lit(0).cast("long")).select(*_COLUMNS))
    selection = picked.select("mix", "source", "id", "tokens", (F.col("base") + F.col("fraction").cast("int")).alias("copies")).filter("copies > 0")
    taken = selection.groupBy("mix", "source").agg(F.sum("copies").alias("records_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_repeats"))
    whole = taken.groupBy("mix").agg(F.sum("tokens_used").alias("mix_tokens"))
    report = plan.join(taken, ["mix", "source"], "left").join(whole, "mix", "left").select(
        "mix", "source", "target_share", "max_repeats", "docs", "available", "wanted", "short",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records_used", "tokens_used", "most_repeats")),
        F.coalesce(F.try_divide(F.col("tokens_used"), F.col("mix_tokens")), F.lit(0.0)).alias("actual_share"),
    )
    return selection, report
