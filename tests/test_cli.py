import io
import sys

from postloom import cli

MESSAGE = "Message-ID: <1>\nDate: Mon, 4 Sep 2000 09:00:00 -0700\nFrom: ida.moor@norvik.example\nTo: otto.birk@norvik.example\nSubject: RE: plan\nX-From: Ida Moor\n\nHi Otto,\n\nwrite to otto.birk@norvik.example.\n\nIda Moor\n"


def test_one_message_from_file_and_input(spark, tmp_path, capsys, monkeypatch):
    profiles = str(tmp_path / "profiles")
    spark.createDataFrame([("p1", "Pine Works", "PIN", "pine.example", "gas", "en_GB", "Land", "Pineton", "UTC", ["audit"], "current")], "profile_id string, name string, short string, domain string, industry string, locale string, country string, city string, tz string, sub_units array<string>, profile_set string").write.parquet(profiles)
    (tmp_path / "m.txt").write_text(MESSAGE)
    cli.main(["one", profiles, str(tmp_path / "m.txt"), "--internal-domain", "norvik.example", "--company", "norvik"])
    first = capsys.readouterr().out
    monkeypatch.setattr(sys, "stdin", io.StringIO(MESSAGE))
    cli.main(["one", profiles, "--internal-domain", "norvik.example", "--company", "norvik"])
    second = capsys.readouterr().out
    for out in (first, second):
        assert "@pine.example>" in out and "Subject: Re: plan" in out and not any(x in out.lower() for x in ("norvik", "ida", "moor", "otto", "birk"))


def test_dataset_and_experiment(spark, tmp_path, capsys):
    from pathlib import Path

    import pytest

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test data here")
    more = ["--internal-domain", "kestra-grid.example", "--company", "kestra"]
    cli.main(["dataset", data, str(tmp_path / "set"), "--n", "5", *more])
    assert spark.read.json(str(tmp_path / "set")).count() == 5
    out = str(tmp_path / "exp")
    cli.main(["experiment", "select", data, out, "--n", "2", *more])
    cli.main(["experiment", "run", data, out, "--arm", "rule", *more])
    cli.main(["experiment", "evaluate", data, out, *more])
    assert "| rule |" in capsys.readouterr().out
    cli.main(["query", "folder_counts", data])
    assert "## folder_counts" in capsys.readouterr().out
