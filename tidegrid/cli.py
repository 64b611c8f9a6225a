"""Command line: each subcommand is one plan from files to files."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from .operators import metrics as M
from .operators import windows as W
from .operators.clean import preprocess
from .operators.grid import feature_rules, merged_rules, resample
from .plans.models import build_model, load_model, save_model
from .schema import Grid, Settings, settings_from
from .session import session
from .sources import cdf, fetch, sinks, synthetic
from .streaming import feed, online, serve

CHANNELS = ("flux_e2", "flux_seed", "vsw", "density", "bz_gsm", "bt", "ae", "al", "kp", "sym_h", "f107")


def read_tree(path: Path) -> dict:
    """A JSON file, or a YAML one where a YAML library is installed."""
    if path.suffix not in (".yaml", ".yml"):
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} needs a YAML library; JSON works without") from e
    return yaml.safe_load(path.read_text()) or {}


def load_settings(path: str | None, model: str | None = None) -> Settings:
    """Settings of a file; hyperparameters of its model come from model/<name> beside it, if there is such a file."""
    s = settings_from(read_tree(Path(path))) if path else Settings()
    s = replace(s, model=model) if model else s
    for suffix in (".yaml", ".yml", ".json"):
        if path and (own := Path(path).parent / "model" / (s.model + suffix)).exists():
            return replace(s, params={**read_tree(own), **s.params})
    return s


def _settings(a) -> Settings:
    return load_settings(a.config, getattr(a, "model", None))


def synth(spark, a) -> None:
    sinks.write_grid(synthetic.demo_dataset(spark, a.days, a.seed), a.out)


def ingest(spark, a) -> None:
    names = a.variables.split(",")
    sinks.write_grid(resample(cdf.wide(cdf.read_cdf(spark, a.files, names), names), Grid(), names), a.out)


def clean(spark, a) -> None:
    raw = sinks.read_grid(spark, a.source)
    done = preprocess(raw, Grid(), [c for c in CHANNELS if c in raw.columns], _settings(a))
    wrong, rules = merged_rules(done)
    for p in wrong:
        print("note:", p)
    _written(done, rules, lambda d: sinks.write_grid(d, a.out))


def _written(df, rules, write) -> None:
    """Write, and say afterwards which rules the rows that were written break."""
    def note(found: dict[str, int]) -> None:
        for name, n in found.items():
            print(f"note: {name} ({n} rows)")

    seen, verdict = sinks.gate(rules, note)(df)
    write(seen)
    verdict()


def features(spark, a) -> None:
    s = _settings(a)
    f = W.feature_matrix(sinks.read_grid(spark, a.source), Grid())
    inputs = [c for c in f.columns if c in CHANNELS or "_lag" in c or "_roll" in c]
    d = W.anchors(f.withColumn("last", F.col(a.target)), Grid(), inputs, a.target, s.lookback, decoder=s.decoder, horizons=s.horizons, threshold=s.threshold, keep=("last", *inputs))
    d = W.every_nth(d, Grid(), s.stride, s.max_windows) if s.stride > 1 or s.max_windows else d
    d = W.chronological_split(d, Grid(), s.train, s.val, -(-(s.lookback + s.decoder) // s.stride))
    _written(d, feature_rules(d, inputs, "last")[1], lambda x: x.write.mode("overwrite").parquet(a.out))


def fetched(spark, a) -> None:
    names = a.variables.split(",")
    get = fetch.fetch_hapi(spark, a.server, a.dataset, names, a.start, a.stop, url=a.url) if a.server or a.url else fetch.fetch_cdaweb(spark, a.dataset, names, a.start, a.stop)
    sinks.write_grid(resample(get, Grid(), names), a.out)


def export(spark, a) -> None:
    """CDF files of a grid, one for each month."""
    cdf.write_cdf_files(sinks.read_grid(spark, a.source), a.out, kind=a.kind).select("path").write.mode("overwrite").text(f"{a.out}.files")


def train(spark, a) -> None:
    s = _settings(a)
    m = build_model(s.model, horizons=s.horizons, threshold=s.threshold, **s.params)
    save_model(m.fit(W.select_split(spark.read.parquet(a.source), "train")), spark, a.out)


def _report(spark, s: Settings, models, anchors, split: str, out: str) -> None:
    cols = {"y": "y_{h}", "pred": "{h}_pred", "ref": "last", "p": "{h}_p", "q10": "{h}_q10", "q50": "{h}_q50", "q90": "{h}_q90"}
    long = None
    for m in models:
        one = M.by_horizon(m.predict(W.select_split(anchors, split)), ["time"], s.horizons, cols).withColumn("model", F.lit(m.name))
        long = one if long is None else long.unionByName(one)
    table = M.evaluate(long, s.threshold)
    sinks.write_report(M.tidy(table), out)
    (Path(out) / "report.md").write_text(M.markdown(table, list(s.horizons), SCORES)) if "://" not in out else None
    print(M.markdown(table, list(s.horizons), SCORES))


SCORES = ["rmse", "mae", "pe", "skill", "corr", "hss", "brier", "crps", "picp"]


def baseline(spark, a) -> None:
    """Fit and score the models that need no more than the anchors themselves."""
    s, d = _settings(a), spark.read.parquet(a.source)
    _report(spark, s, [build_model(n, horizons=s.horizons, threshold=s.threshold, **(s.params if n == s.model else {})).fit(W.select_split(d, "train")) for n in a.models.split(",")], d, a.split, a.out)


def evaluate(spark, a) -> None:
    s, d = _settings(a), spark.read.parquet(a.source)
    m = load_model(spark, a.trained) if a.trained else build_model(s.model, horizons=s.horizons, threshold=s.threshold, **s.params).fit(W.select_split(d, "train"))
    _report(spark, s, [m], d, a.split, a.out)


def served(spark, a) -> None:
    """Forecast each new sample of a folder of Parquet samples into a table of latest forecasts; once drains the folder and ends.

    Samples up to `late` behind the newest are waited for and put in order; those that come later still are left out.
    """
    s = _settings(a)
    predictors = [load_model(spark, a.trained)] if a.trained else []
    samples = spark.readStream.schema(spark.read.parquet(a.source).schema).parquet(a.source)
    rows = online.stream_vector(samples, late=a.late).withColumn("last", F.col("log_flux_e2"))
    q = rows.writeStream.foreachBatch(serve.refresh(a.out, predictors, [(2.0, 0.3)] * 24, s.horizons, s.threshold)).option("checkpointLocation", f"{a.out}.checkpoint")
    with feed.settings(spark, online.ROCKSDB):
        q = (q.trigger(availableNow=True) if a.once else q.trigger(processingTime="60 seconds")).start()
    q.awaitTermination()


def demo(spark, a) -> None:
    """All steps in a row, on a synthetic series."""
    out = a.out
    step = lambda f, **more: f(spark, argparse.Namespace(config=a.config, out=f"{out}/{f.__name__}", **more))
    step(synth, days=a.days, seed=a.seed)
    step(clean, source=f"{out}/synth")
    step(features, source=f"{out}/clean", target="log_flux_e2")
    step(train, source=f"{out}/features", model=None)
    step(evaluate, source=f"{out}/features", split="test", trained=f"{out}/train", model=None)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidegrid")
    sub = p.add_subparsers(required=True)
    need, source = {"required": True}, ("--source", {"required": True})
    series = [("--days", {"type": float, "default": 10}), ("--seed", {"type": int, "default": 0})]
    model, trained, split = ("--model", {"default": None}), ("--trained", {"default": None}), ("--split", {"default": "test"})
    for name, f, args in (
        ("synth", synth, series), ("fetch", fetched, [("--server", {"default": None}), ("--url", {"default": None}), ("--dataset", need), ("--variables", need), ("--start", need), ("--stop", need)]),
        ("ingest", ingest, [("--files", {"nargs": "+", "required": True}), ("--variables", need)]), ("export", export, [source, ("--kind", {"default": None})]),
        ("clean", clean, [source]), ("features", features, [source, ("--target", {"default": "log_flux_e2"})]), ("baseline", baseline, [source, split, ("--models", {"default": "persistence"})]),
        ("train", train, [source, model]), ("evaluate", evaluate, [source, split, trained, model]), ("serve", served, [source, trained, model, ("--once", {"action": "store_true"}), ("--late", {"default": "0 seconds"})]), ("demo", demo, series),
    ):
        s = sub.add_parser(name)
        for option, kw in [*args, ("--out", {"required": True}), ("--config", {"default": None})]:
            s.add_argument(option, **kw)
        s.set_defaults(run=f)
    a = p.parse_args(argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
