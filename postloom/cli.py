"""Command line.

python -m postloom.cli query QUERY... FOLDER [--out DIR] [--format parquet|json|csv|markdown]
python -m postloom.cli one PROFILES [FILE|-] [--mode rule] [--internal-domain D] [--company TERM...]
python -m postloom.cli dataset FOLDER OUT [--n N] [--mode rule]
python -m postloom.cli experiment select|run|evaluate FOLDER OUT [--n N] [--mode rule] [--arm NAME]

``query`` runs queries of the catalogue over a folder of tables; ``one`` derives a message from RFC-822 text in a file or on the standard input;
``dataset`` samples eligible messages without repeats and derives one from each; ``experiment`` selects a stratified set, derives a message from
each of it as an arm, and compares arms with their sources. Rewriting modes need a service, which is given in code; here ``rule`` is the only mode.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from postloom.operators import dedup, evaluate, generate, parse, profile, sample, scrub
from postloom.plans.catalog import QUERIES
from postloom.sources import read_table, tables


def _spark() -> SparkSession:
    return SparkSession.builder.appName("postloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _query(a: argparse.Namespace) -> None:
    spark = _spark()
    write = {"parquet": tables.write_parquet, "json": tables.write_json_lines, "csv": tables.write_csv}
    for name in a.queries:
        df = QUERIES[name](spark, a.folder)
        if a.format == "markdown":
            print(f"## {name}\n\n{tables.markdown_table(df)}\n")
        else:
            write[a.format](df, f"{a.out}/{name}")


def _terms(a: argparse.Namespace) -> scrub.Terms:
    return scrub.Terms(tuple(a.company), a.internal_domain)


def _derive(emails: DataFrame, profiles: DataFrame, a: argparse.Namespace) -> DataFrame:
    terms = _terms(a)
    return generate.generate(scrub.scrub(emails, profiles, terms), a.mode, company_terms=terms.company)


def _one(a: argparse.Namespace) -> None:
    spark = _spark()
    raw = tables.read_document(spark, sys.stdin.read() if a.file == "-" else None, None if a.file == "-" else a.file)
    emails = parse.parse_messages(raw).withColumn("email_id", F.lit(1).cast("long"))
    print(_derive(emails, spark.read.parquet(a.profiles), a).first()["raw"])


def _picked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Eligible messages, one for each body, of which ``n`` by hash (all without n)."""
    emails = read_table(spark, a.folder, "parsed_emails")
    kept = sample.eligible(profile.featurize(emails, a.internal_domain, (a.company or [""])[0])).select("email_id")
    once = dedup.first_wins(emails.join(kept, "email_id"), dedup.body_key(F.col("body")), ["email_id"])
    return once if a.n is None else sample.first_n(once, F.col("email_id"), a.n, 1)


def _dataset(a: argparse.Namespace) -> None:
    spark = _spark()
    tables.write_json_lines(_derive(_picked(spark, a), read_table(spark, a.folder, "profiles"), a), a.out)


def _experiment(a: argparse.Namespace) -> None:
    spark = _spark()
    if a.step == "select":
        eligible = sample.eligible(profile.featurize(read_table(spark, a.folder, "parsed_emails"), a.internal_domain, (a.company or [""])[0]))
        strata = sample.stratified(eligible.select("email_id", "folder_type", "has_trailer"), ["folder_type", "has_trailer"], F.col("email_id"), a.n or 100, 1)
        tables.write_parquet(read_table(spark, a.folder, "parsed_emails").join(strata, "email_id"), f"{a.out}/selected")
        return
    selected = spark.read.parquet(f"{a.out}/selected")
    if a.step == "run":
        tables.write_parquet(_derive(selected, read_table(spark, a.folder, "profiles"), a), f"{a.out}/runs/arm={a.arm}")
        return
    runs = spark.read.parquet(f"{a.out}/runs")
    count = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("@"))
    side = lambda df, p, *more: profile.structure(df, "email_id", *more).select("email_id", *(F.col(c).alias(f"{p}_{c}") for c in ("body_words", *evaluate.FLAGS)))
    both = None
    for (arm,) in runs.select("arm").distinct().orderBy("arm").collect():  # arms are a handful
        own = side(runs.filter(F.col("arm") == arm), "s", "body", "quoted", count(F.col("headers")["To"]), count(F.col("headers")["Cc"])).withColumn("arm", F.lit(arm))
        both = own if both is None else both.unionByName(own)
    pairs = both.join(side(selected, "o"), "email_id")
    leaks = runs.groupBy("arm").agg(F.round(F.avg((F.size("meta.leaks_after") > 0).cast("int")), 6).alias("leak_rate"), F.round(F.avg(F.col("meta.forced_redaction").cast("int")), 6).alias("forced_rate"))
    report = evaluate.fidelity(pairs, "arm").join(leaks, "arm")
    tables.write_json_lines(report, f"{a.out}/report")
    print(tables.markdown_table(report))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    q = commands.add_parser("query")
    q.add_argument("queries", nargs="+", choices=sorted(QUERIES), metavar="QUERY")
    q.add_argument("folder")
    q.add_argument("--out")
    q.add_argument("--format", default="markdown", choices=("parquet", "json", "csv", "markdown"))
    q.set_defaults(run=_query)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--mode", default="rule", choices=("rule",))
    common.add_argument("--internal-domain", default="internal.example")
    common.add_argument("--company", nargs="*", default=[])
    common.add_argument("--n", type=int)
    one = commands.add_parser("one", parents=[common])
    one.add_argument("profiles")
    one.add_argument("file", nargs="?", default="-")
    one.set_defaults(run=_one)
    dataset = commands.add_parser("dataset", parents=[common])
    dataset.add_argument("folder")
    dataset.add_argument("out")
    dataset.set_defaults(run=_dataset)
    experiment = commands.add_parser("experiment", parents=[common])
    experiment.add_argument("step", choices=("select", "run", "evaluate"))
    experiment.add_argument("folder")
    experiment.add_argument("out")
    experiment.add_argument("--arm", default="rule")
    experiment.set_defaults(run=_experiment)
    a = parser.parse_args(arguments)
    if a.run is _query and a.format != "markdown" and not a.out:
        parser.error("--out is needed for files")
    a.run(a)


if __name__ == "__main__":
    main()
