"""From synthetic series to scores, through files."""

import json

import pytest
from pyspark.sql import functions as F

from tidegrid import cli
from tidegrid.plans.models import build_model, load_model, save_model
from tidegrid.streaming import serve


def test_plan_end_to_end(spark, tmp_path, capsys):
    conf = {"lookback": 24, "decoder": 36, "horizons": {"nowcast": 8, "3h": 36}, "threshold": 2.0, "model": {"name": "refm", "inputs": ["last", "vsw"]}}
    (tmp_path / "c.json").write_text(json.dumps(conf))
    c = ["--config", f"{tmp_path}/c.json"]
    for step, source in (("synth", None), ("clean", "synth"), ("features", "clean"), ("evaluate", "features")):
        more = ["--source", f"{tmp_path}/{source}"] if source else ["--days", "6"]
        cli.main([step, *more, "--out", f"{tmp_path}/{step}", *c])
    out = capsys.readouterr().out
    assert "| nowcast | refm |" in out and "| 3h | refm |" in out
    assert spark.read.json(f"{tmp_path}/evaluate/json").where("metric = 'rmse' AND value > 0").count() == 2


def test_train_serve_and_demo(spark, tmp_path, capsys):
    (tmp_path / "model").mkdir()
    (tmp_path / "c.yaml").write_text("lookback: 24\ndecoder: 36\nhorizons: {nowcast: 8, 3h: 36}\nthreshold: 2.0\nmodel: {name: refm}\n")
    (tmp_path / "model" / "refm.yaml").write_text("inputs: [last, vsw]\n")
    assert cli.load_settings(f"{tmp_path}/c.yaml").params == {"inputs": ["last", "vsw"]}
    cli.main(["demo", "--days", "5", "--out", f"{tmp_path}/d", "--config", f"{tmp_path}/c.yaml"])
    assert "| nowcast | refm |" in capsys.readouterr().out and "| 3h | refm |" in (tmp_path / "d/evaluate/report.md").read_text()
    cli.main(["baseline", "--source", f"{tmp_path}/d/features", "--out", f"{tmp_path}/b", "--config", f"{tmp_path}/c.yaml", "--models", "persistence,refm"])
    assert spark.read.json(f"{tmp_path}/b/json").where("metric = 'rmse'").count() == 4
    cli.main(["export", "--source", f"{tmp_path}/d/synth", "--out", f"{tmp_path}/cdf", "--kind", "goes"])
    files = [r[0] for r in spark.read.text(f"{tmp_path}/cdf.files").collect()]
    cli.main(["ingest", "--files", *files, "--variables", "flux_e2,longitude", "--out", f"{tmp_path}/back"])
    assert spark.read.parquet(f"{tmp_path}/back").where("flux_e2 IS NOT NULL").count() == spark.read.parquet(f"{tmp_path}/d/synth").where("flux_e2 IS NOT NULL").count()
    spark.read.parquet(f"{tmp_path}/d/clean").drop("year", "month").orderBy("time").limit(40).write.parquet(f"{tmp_path}/samples")
    cli.main(["serve", "--source", f"{tmp_path}/samples", "--trained", f"{tmp_path}/d/train", "--out", f"{tmp_path}/live", "--once", "--config", f"{tmp_path}/c.yaml"])
    code, body = serve.answer(spark, f"{tmp_path}/live", "sat-1", "nowcast")
    assert code == 200 and body["model"] == "refm" and body["q10"] < body["q50"] < body["q90"]


@pytest.mark.parametrize("name", ["persistence", "climatology", "refm", "lightgbm"])
def test_models_are_the_same_after_saving(spark, tmp_path, name):
    i = F.col("id")
    d = spark.range(300).select(F.timestamp_seconds(i * 300).alias("time"), F.sin(i / 9).alias("last"), F.cos(i / 9).alias("v"), (F.sin(i / 9) + i % 3).alias("y_a"), (i % 4).cast("int").alias("bin_a"))
    m = build_model(name, horizons={"a": 1}, threshold=1.0, inputs=["last", "v"], trees=3).fit(d)
    save_model(m, spark, f"{tmp_path}/m")
    cols = ["time", "a_q10", "a_q50", "a_q90", "a_pred", "a_p"]
    assert load_model(spark, f"{tmp_path}/m").predict(d).select(cols).orderBy("time").collect() == m.predict(d).select(cols).orderBy("time").collect()
