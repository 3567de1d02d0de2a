from postloom import cli
from postloom.sources import tables


def test_round_trips(spark, tmp_path):
    rows = [("a", 'two\nlines, "quoted"'), ("b", None), ("c", "")]
    df = spark.createDataFrame(rows, "file string, message string")
    tables.write_csv(df.filter("message is not null and message <> ''"), f"{tmp_path}/csv")
    assert [tuple(r) for r in tables.read_corpus_csv(spark, f"{tmp_path}/csv").collect()] == rows[:1]
    tables.write_json_lines(df.withColumn("error", df.message), f"{tmp_path}/json")
    assert tables.read_json_lines(spark, f"{tmp_path}/json", "file string, message string, error string").count() == 1
    assert tables.read_json_lines(spark, f"{tmp_path}/json", "file string, message string, error string", keep_errors=True).count() == 3
    tables.write_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.123456, None)], "x string, y double, z int")
    assert tables.markdown_table(df).split("\n")[2] == "| a\\|b | 0.1235 |  |"
    assert tables.summary_json(df).first()[0] == '{"x":"a|b","y":0.123456}'
    try:
        tables.markdown_table(spark.range(10), max_rows=5)
        raise AssertionError
    except ValueError:
        pass


def test_command_line(spark, capsys):
    try:
        cli.main(["no_such_query", "/tmp"])
    except SystemExit as e:
        assert e.code == 2
