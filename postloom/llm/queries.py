"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postloom.llm.authored import find_authored
from postloom.llm.checks import SQL
from postloom.llm.conversations import rebuild_conversations
from postloom.llm.dedup import collapse_copies
from postloom.llm.leakage import find_leaks, item_body
from postloom.llm.mixing import mix_sources
from postloom.llm.pii import find_pii, header_names
from postloom.llm.residue import exclude_residue, find_residue
from postloom.llm.sharing import find_shared
from postloom.llm.truncation import find_truncated, truncation_rates
from postloom.sources import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies, _ = collapse_copies(read_table(spark, sf_dir, "parsed_emails"))
    return copies.select(F.col("rep").alias("email_id"), F.col("id").alias("copy_email_id"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = collapse_copies(read_table(spark, sf_dir, "parsed_emails"))
    return groups.select(F.col("rep").alias("email_id"), F.col("n").alias("n_copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_copies": p2_copies}


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(read_table(spark, sf_dir, "documents")).filter("truncated").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(find_truncated(read_table(spark, sf_dir, "documents")))


QUERIES |= {"p9_found": p9_found, "p9_rates": p9_rates}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_conversations(read_table(spark, sf_dir, "parsed_emails")).select(F.col("conv").alias("conv_email_id"), "turn_no", F.col("id").alias("email_id"))


def p5_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = rebuild_conversations(read_table(spark, sf_dir, "parsed_emails"))
    return turns.groupBy(F.col("conv").alias("conv_email_id")).agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "opener").alias("n_opener_turns"), F.count_distinct("sender").alias("n_people"))


QUERIES |= {"p5_found": p5_found, "p5_roles": p5_roles}


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "eval_set").select("item_id", item_body(F.col("message")).alias("text"))
    return find_leaks(read_table(spark, sf_dir, "documents"), items)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


QUERIES |= {"p7_found": p7_found, "p7_removals": p7_removals}


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose source is used as often as it may be, in all its records, and gives less than was wanted."""
    _, report = mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))
    return report.filter("records_used = docs * max_repeats and tokens_used < wanted").select(F.col("mix").alias("mix_name"), "source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


QUERIES |= {"p8_found": p8_found, "p8_report": p8_report}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(read_table(spark, sf_dir, "synthetic_emails"), "syn_id", ("body", "quoted")).select(F.col("id").alias("syn_id"), "field")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclude_residue(read_table(spark, sf_dir, "synthetic_emails"), "syn_id", ("body", "quoted")).select("syn_id", "run_name", "idx")


QUERIES |= {"p6_found": p6_found, "p6_clean": p6_clean}


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' bodies; even records are parsed e-mails, odd ones synthetic."""
    parsed = read_table(spark, sf_dir, "parsed_emails").select((F.col("email_id") * 2).alias("rec"), F.col("body").alias("text"))
    return parsed.unionByName(read_table(spark, sf_dir, "synthetic_emails").select((F.col("syn_id") * 2 + 1).alias("rec"), F.col("body").alias("text")))


def _named(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.when(F.col("rec") % 2 == 0, "parsed").otherwise("synthetic").alias("record_type"), F.shiftright("rec", 1).alias("record_id"), *more)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(find_shared(_bodies(spark, sf_dir), measure=False))


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(find_shared(_bodies(spark, sf_dir)), F.col("shared").alias("shared_chars"), F.col("spans").alias("n_spans"))


QUERIES |= {"p3_found": p3_found, "p3_shared": p3_shared}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_authored(read_table(spark, sf_dir, "parsed_emails")).select(F.col("id").alias("email_id"), "line_no")


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = find_authored(read_table(spark, sf_dir, "parsed_emails"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(F.col("id").alias("email_id")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("authored"))


QUERIES |= {"p1_found": p1_found, "p1_text": p1_text}


def _free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and trailer of parsed e-mails, body of synthetic ones."""
    parsed = read_table(spark, sf_dir, "parsed_emails").select(F.lit("parsed").alias("record_type"), F.col("email_id").alias("record_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("body", "trailer")))).alias("f"))
    synthetic = read_table(spark, sf_dir, "synthetic_emails").select(F.lit("synthetic").alias("record_type"), F.col("syn_id").alias("record_id"), F.lit("body").alias("field"), F.col("body").alias("text"))
    return parsed.select("record_type", "record_id", "f.field", "f.text").unionByName(synthetic)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_free_text(spark, sf_dir), header_names(read_table(spark, sf_dir, "parsed_emails")))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_free_text(spark, sf_dir), header_names(read_table(spark, sf_dir, "parsed_emails")), redact=True)


QUERIES |= {"p4_found": p4_found, "p4_redacted": p4_redacted}
