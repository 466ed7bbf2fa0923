import json

import pytest

from tabscope.plans import job


def snapshot(path, hull, leith):
    path.write_text("depot,parcels\n" + "".join(f"Hull,{hull + i % 4}\nLeith,{leith + i % 4}\n" for i in range(12)))
    return str(path)


@pytest.fixture()
def snapshots(tmp_path):
    return snapshot(tmp_path / "before.csv", 700, 400), snapshot(tmp_path / "after.csv", 90, 450)


def run(spark, *argv):
    return job.run_check(spark, job._parser().parse_args(["check", *argv]))


def test_text_report(spark, snapshots, capsys):
    assert run(spark, *snapshots) == 0
    out = capsys.readouterr().out
    assert "driver: Hull" in out and "parcels" in out


def test_json_report_and_tables(spark, snapshots, tmp_path, capsys):
    out = str(tmp_path / "report")
    assert run(spark, *snapshots, "--metric", "parcels", "--segment", "depot", "--agg", "mean", "--format", "json", "--out", out) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["driver"][0]["segment"] == "Hull" and report["segment"] == "depot"
    assert spark.read.json(f"{out}/driver").count() == 2


def test_exit_codes(spark, snapshots, tmp_path):
    before, after = snapshots
    assert run(spark, before, after, "--fail-on-significant") == 2
    assert run(spark, before, before, "--fail-on-significant") == 0
    assert run(spark, before, str(tmp_path / "missing.csv")) == 1
    assert run(spark, before, after, "--metric", "nothing", "--segment", "depot") == 1


def test_json_has_every_segment(spark, tmp_path, capsys):
    for name, shift in (("before", 0), ("after", 3)):
        (tmp_path / f"{name}.csv").write_text("depot,parcels\n" + "".join(f"d{i},{10 + i * shift}\n" for i in range(57)))
    files = [str(tmp_path / f"{name}.csv") for name in ("before", "after")]
    assert run(spark, *files, "--format", "json", "--schema", "depot string, parcels bigint") == 0
    assert len(json.loads(capsys.readouterr().out)["driver"]) == 57
