import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from radveil.operators.ranking import numbered
from radveil.plans import pipeline
from radveil.session import shared_folder
from radveil.sources import files as src
from radveil.sources.sinks import write_csv_parts, write_reviewer_csv
from radveil.sources.vault import Vault
from radveil.schemas import OVERRIDES
from radveil.streaming import incremental

REPORT = "CT SCAN REPORT\n|ID NO: |A{n} |Date: 12 October 2024\n|Patient Name: |{name} |Age: 47 Yrs |Sex: F\n|Examined: |CT of chest\nFindings: Lungs are clear.\nImpression: Normal study.\nDr. Someone\n"


def test_run_release_and_stream(spark, tmp_path):
    raw, secure = tmp_path / "raw" / "12-10-2024", tmp_path / "secure"
    raw.mkdir(parents=True)
    for n, name in enumerate(["Rahima Begum", "Begum Rahima", "Salma Khatun", "Salma Khatun"]):
        (raw / f"r{n}.doc").write_text(REPORT.format(n=n if n < 3 else 2, name=name))
    (raw / "~$r0.doc").write_text("lock")
    (raw / "notes.txt").write_text("x")
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nfor f; do :; done\ncat "$f"\n')
    tool.chmod(0o755)
    cfg = pipeline.Config(tmp_path / "raw", secure, tmp_path / "out", tmp_path / "key" / "k", str(tool))
    s = pipeline.run(spark, cfg)
    assert (s["reports"], s["duplicate_files"], s["lock_files"], s["patients"], s["qa_failed"]) == (3, 1, 1, 2, 0)
    first = {r.uid: r.research_patient_id for r in pipeline._load(pipeline.Vault(secure, cfg.key_file), spark, "research_ids").collect()}
    assert pipeline.run(spark, cfg)["patients"] == 2
    assert first == {r.uid: r.research_patient_id for r in pipeline._load(pipeline.Vault(secure, cfg.key_file), spark, "research_ids").collect()}
    sample = secure / "qa_human_sample.csv"
    lines = sample.read_text(encoding="utf-8-sig").splitlines()
    assert len(lines) == 4
    sample.write_text("\n".join([lines[0], *(x[: -len(",,")] + "yes,," for x in lines[1:])]), encoding="utf-8-sig")
    m = pipeline.release_dataset(spark, cfg)
    assert (m["n_reports"], m["n_patients"], m["n_small_cells"]) == (3, 2, 1)
    assert json.loads((cfg.research_dir / "release_manifest.json").read_text())["n_reports"] == 3
    listed, _ = src.list_source_files(spark, str(cfg.raw_dir))
    files = src.extract(listed, str(cfg.raw_dir), str(tool))
    folder = str(tmp_path / "stream")
    files.write.parquet(folder)
    out = str(tmp_path / "parsed")
    for _ in range(2):
        incremental.append_to(incremental.parsed_stream(incremental.source_stream(spark, folder)), out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_reviewer_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", 'a "b", c', "zoë", None)], OVERRIDES)
    p = tmp_path / "x.csv"
    assert write_reviewer_csv(df, p, OVERRIDES.names) == 1
    assert p.read_bytes().startswith(b"\xef\xbb\xbf") and b"\r\n" in p.read_bytes()
    got = src.read_reviewer_csv(spark, str(p), OVERRIDES).first()
    assert (got.report_id, got.decision, got.reviewer) == ("r", 'a "b", c', "zoë")
    assert src.read_reviewer_csv(spark, str(tmp_path / "none.csv"), OVERRIDES).count() == 0


def test_csv_parts_are_one_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', True, None), (2, "two\nlines", False, "zoë"), (3, "", None, "x")], "n int, t string, b boolean, z string").repartition(3).orderBy("n")
    write_csv_parts(df, str(tmp_path / "c"), ["n", "t", "b", "z"])
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part-*")))
    assert whole.decode() == '﻿n,t,b,z\r\n1,"a ""b"", c",True,\r\n2,"two\nlines",False,zoë\r\n3,,,x\r\n'


def test_positions(spark):
    df = spark.createDataFrame([("a/b/x.doc",), ("a/b.c/x.DOC",), ("a/~$x.doc",), ("a/x.txt",), ("b.doc",), ("a/.doc",), (None,)], "path string")
    assert [(r.path, r.file_index) for r in src.listed(df.union(df)).orderBy("file_index").collect()] == [("a/b/x.doc", 0), ("a/b.c/x.DOC", 1), ("b.doc", 2)]
    assert src.listed(df, 1).count() == 1 and src.listed(df.limit(0)).count() == 0
    rows = spark.range(1000).repartition(7)
    assert [r.at for r in numbered(rows, "at", "id").orderBy("id").collect()] == [*range(1000)]


def test_a_run_needs_nothing_of_the_working_directory(tmp_path):
    """Executors' workers get the package whatever the folder, also where data doesn't come through session.table()."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from radveil.plans import pipeline
from pathlib import Path
raw = Path("raw/1-1-2024"); raw.mkdir(parents=True); (raw / "r.doc").write_text("Name: A B\\nFindings: x\\nImpression: y")
tool = Path("tool"); tool.write_text('#!/bin/sh\\nfor f; do :; done\\ncat "$f"\\n'); tool.chmod(0o755)
here = Path(".").resolve()
print("reports", pipeline.run(spark, pipeline.Config(here / "raw", here / "s", here / "o", here / "k" / "k", str(here / "tool")))["reports"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "reports 1" in done.stdout, done.stderr[-3000:]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_key_file_and_log(tmp_path):
    v = Vault(tmp_path / "s", tmp_path / "k" / "key")
    assert v.created_key and (tmp_path / "k" / "key").stat().st_mode & 0o777 == 0o600
    again = Vault(tmp_path / "s", tmp_path / "k" / "key")
    assert not again.created_key and again.link_key.bytes() == v.link_key.bytes()
    v.log_access("run", reports=3)
    v.log_access("release", ok=True)
    lines = [json.loads(x) for x in (tmp_path / "s" / "access_log.jsonl").read_text().splitlines()]
    assert [x["command"] for x in lines] == ["run", "release"] and lines[0]["reports"] == 3 and {"at", "host", "account"} <= set(lines[0])
    (tmp_path / "short").write_text("YWJj")
    with pytest.raises(ValueError):
        Vault(tmp_path / "s", tmp_path / "short")


def test_figures_make_the_review_queue_once(spark, data, monkeypatch):
    from radveil.operators import linkage
    from radveil.plans import queries as Q

    made = []
    queue = linkage.review_queue
    monkeypatch.setattr(linkage, "review_queue", lambda recs: made.append(1) or queue(recs))
    Q.QUERIES["run_figures"](spark, data)
    assert len(made) == 1
