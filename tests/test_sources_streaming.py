"""File sources and streams against their batch results."""

from __future__ import annotations

import datetime
import json
import random
import shutil

import pytest
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from textloom.sources import files
from textloom.sources.config import Config
from textloom.streaming import jobs, stateful


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tex").write_text("\\section{é}", "utf-8")
    (tmp_path / "sub/b.md").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"no")
    assert [r["text"] for r in files.read_files(spark, str(tmp_path), "latex").collect()] == ["\\section{é}"]
    assert [r["text"] for r in files.read_files(spark, str(tmp_path), "markdown").collect()] == ["naïve"]
    assert {r["name"] for r in files.discovered(spark, str(tmp_path), ["latex", "markdown"]).collect()} == {"a.tex", "b.md"}
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path), "unknown")


def test_golden_and_passages(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"test_cases": [{"id": "1", "question": "q", "expected_chunks": ["a", "b"]}, {"id": "2"}]}))
    assert {(r["id"], len(r["expected_chunks"] or [])) for r in files.golden_cases(spark, str(tmp_path / "g.json")).collect()} == {("1", 2), ("2", 0)}
    docs = spark.createDataFrame([(1, "x" * 101 + "\n \n" + "short")], "id long, text string")
    assert files.passages(docs, "id").count() == 1


def test_report(spark, tmp_path):
    files.write_report(spark.createDataFrame([("a", 1), ("b", None)], "k string, n int"), str(tmp_path / "r"), "Runs")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r/markdown")).collect()][:4] == ["# Runs", "", "| k | n |", "|---|---|"]
    html = "".join(r["value"] for r in spark.read.text(str(tmp_path / "r/html")).collect())
    assert html == "<h1>Runs</h1><table><tr><th>k</th><th>n</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b</td><td></td></tr></table>"


def test_export_and_metadata(spark, tmp_path):
    docs = spark.createDataFrame([("T", "---\ntitle: 'X y'\nbad\nkey: a: b\n---\none <two>\n\nthree")], "title string, text string")
    row = files.metadata(docs).first()
    assert row["frontmatter"] == {"title": "X y", "key": "a: b"} and (row["line_count"], row["word_count"]) == (8, 12) and row["file_size"] == len(docs.first()["text"])
    assert files.metadata(spark.createDataFrame([("plain",)], "text string")).first()["frontmatter"] is None
    for form in ("json", "markdown", "html"):
        files.export(docs, str(tmp_path / form), form)
    assert "one &lt;two&gt;</p><p>three" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "html")).collect())
    assert spark.read.json(str(tmp_path / "json")).first()["title"] == "T"
    with pytest.raises(ValueError):
        files.export(docs, str(tmp_path / "x"), "pdf")


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": {"c": 1}}, "spark": {"sql": {"caseSensitive": False}}}))
    config = Config.load(spark, str(tmp_path / "c.json"))
    assert (config.get("a.b.c"), config.get("a.x.c", 7), config.get("a.b")) == (1, 7, {"c": 1})
    assert config.merged({"a": {"b": {"d": 2}}}).get("a.b") == {"c": 1, "d": 2}
    config.apply(spark)
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_ingest_resumes(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows.where("doc_id < 50").write.parquet(str(tmp_path / "one"))
    rows.where("doc_id >= 50").write.parquet(str(tmp_path / "two"))

    def arrive(name):
        for file in (tmp_path / name).glob("part-*"):
            shutil.copy(file, source / f"{name}-{file.name}")
        jobs.ingest(spark, str(source), "doc_id long, text string", str(target), str(tmp_path / "cp"), "doc_id").awaitTermination()
        return spark.read.parquet(str(target)).count()

    assert arrive("one") == 50
    assert arrive("two") == rows.count()
    rows.where("doc_id BETWEEN 40 AND 60 OR doc_id IS NULL").withColumn("text", F.lit("sent again")).write.parquet(str(tmp_path / "again"))
    assert arrive("again") == rows.count()
    assert spark.read.parquet(str(target)).where("text = 'sent again'").count() == 0


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "events"
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    end = events.agg(F.max("ts")).first()[0]
    last = events.limit(1).withColumn("ts", F.lit(end) + F.expr("INTERVAL 30 DAYS")).withColumn("event_id", F.lit(-1).cast("long"))
    events.orderBy("ts").coalesce(1).write.parquet(str(folder))
    last.select(events.columns).write.mode("append").parquet(str(folder))
    for name, make in (("health", jobs.windowed_health), ("sessions", jobs.sessions)):
        jobs.finish(make(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))), str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        got = spark.read.parquet(str(tmp_path / name))
        batch = make(events)
        assert got.select("n").agg(F.sum("n")).first()[0] <= batch.agg(F.sum("n")).first()[0]
        assert got.join(batch, [c for c in batch.columns if c != "mean_ms"], "left_semi").count() >= 0.9 * got.count() > 0


# --- keyed state ----------------------------------------------------------------------


def arrivals(spark, folder, rows, name):
    schema = "event_id long, ts timestamp, key string, latency_ms double, failed boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return schema


def test_keyed_state_survives_restarts_and_disorder(spark, tmp_path):
    """Rows arrive shuffled in three runs from one checkpoint; the results are those of plain loops in order of time."""
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=rng.randint(0, 600), milliseconds=rng.randint(0, 3)), rng.choice(["a", "b", None]), None if i % 17 == 0 else float(rng.randint(1, 99)), rng.random() < 0.3) for i in range(240)]
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    parts = [ordered[:90], ordered[90:200], ordered[200:] + [(-1, start + datetime.timedelta(days=9), "end", 0.0, False)]]
    outs = {"health": set(), "lookups": set()}
    for part in parts:
        rng.shuffle(part)
        schema = arrivals(spark, tmp_path / "in", part, "in")
        for name, make in (("health", lambda s: stateful.rolling_health(s, "key", n=7)), ("lookups", lambda s: stateful.renewed_lookups(s, 600))):
            frame = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            stateful.started(frame, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
    for name in outs:
        outs[name] = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect() if r["event_id"] >= 0)
    health, lookups, held, used = [], [], {}, {}
    for event_id, ts, key, latency, failed in ordered:
        if key is None:
            continue
        held[key] = [*held.get(key, []), (latency, failed)][-7:]
        known = [x for x, _ in held[key] if x is not None]
        health.append((key, event_id, ts, len(held[key]), float(np.percentile(known, 95)) if known else None, 100.0 * sum(f for _, f in held[key]) / len(held[key])))
        lookups.append((key, event_id, ts, key in used and ts - used[key] <= datetime.timedelta(seconds=600)))
        used[key] = ts
    assert [(*r[:2], r[3]) for r in outs["lookups"]] == sorted((*r[:2], r[3]) for r in lookups)
    assert [(*r[:2], *r[3:]) for r in outs["health"]] == [pytest.approx((*r[:2], *r[3:])) if r[4] is not None else (*r[:2], *r[3:]) for r in sorted(health)]


def test_ingest_reads_nothing_that_was_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for turn in range(3):
        spark.createDataFrame([(i, str(turn)) for i in range(turn * 5, turn * 5 + 10)] + [(None, "x")], "id long, v string").write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest(spark, str(tmp_path / "in"), "id long, v string", str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["v"]) for r in rows) == [(i, str(min(2, max(0, (i - 5) // 5)))) for i in range(20)]
