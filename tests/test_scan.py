"""Scanning files, and exact percentiles of one long series."""

import statistics

from tallystone.operators import metrics
from tallystone.sources import ingest


def test_scan_finds_known_files_outside_skipped_folders(spark, tmp_path):
    files = {"a.md": "# a", "deep/er/b.TXT": "b é", "c.py": "x = 1", "d.jsonl": "{}", "e.parquet": "no", "noext": "no", ".git/f.md": "no", "deep/node_modules/g.md": "no", "deep/.hidden.md": "h"}
    for name, text in files.items():
        at = tmp_path / "root" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")
    # Spark leaves out files whose names begin with a dot
    for root in (str(tmp_path / "root"), f"file://{tmp_path}/root/"):
        got = {r["path"]: bytes(r["content"]).decode() for r in ingest.scan_sources(spark, root).collect()}
        assert got == {k: files[k] for k in ("a.md", "deep/er/b.TXT", "c.py", "d.jsonl")}
        assert {r["path"] for r in ingest.scan_sources(spark, root, include_code=False).collect()} == {"a.md", "deep/er/b.TXT", "d.jsonl"}
    told = ingest.classify_sources(ingest.scan_sources(spark, str(tmp_path / "root")))
    assert {r["path"]: r["kind"] for r in told.collect()}["d.jsonl"] == "conversation"


def test_latency_of_series_of_any_size(spark):
    series = {"one": [7.0], "two": [1.0, 4.0], "many": [float(x * 7919 % 1009) for x in range(5_000)], "ties": [2.0] * 400 + [9.0]}
    rows = [(k, v) for k, vs in series.items() for v in vs] + [("none", None)]
    got = {r["series"]: tuple(r)[1:] for r in metrics.latency_summary(spark.createDataFrame(rows, "series string, value double").repartition(5)).collect()}
    nearest = lambda vs: sorted(vs)[-(-95 * len(vs) // 100) - 1]
    want = {k: (len(vs), min(vs), statistics.median(vs), max(vs), nearest(vs)) for k, vs in series.items()}
    assert {k: v for k, v in got.items() if k in want} == want
