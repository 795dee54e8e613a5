import json

import pytest

from conftest import rows
from ticketloom.operators import evaluate as ev
from ticketloom.sources import readers, writers


def test_eval_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text('text,urgency\n"Late, and\nbroken", High \nfine,\nodd,unknown\n')
    df = ev.label_rows(readers.eval_csv(spark, str(tmp_path / "e.csv")), "urgency", ["low", "medium", "high"])
    assert rows(df, "text", "urgency", "known") == [("Late, and\nbroken", "high", True), ("odd", "unknown", False)]


def test_kb_seed(spark, tmp_path):
    entries = [{"title": "Short", "categories": ["a", "b"], "content": "one two"}, {"title": "Long", "categories": [], "content": "w " * 50}]
    (tmp_path / "kb.json").write_text(json.dumps(entries, indent=1))
    good, refused = readers.kb_seed(spark, str(tmp_path / "kb.json"), limit=10)
    assert rows(good, "title", "categories") == [("Short", ["a", "b"])] and rows(refused) == [("Long", 51)]


def test_help_files(spark, tmp_path):
    (tmp_path / "returns_policy.md").write_bytes("﻿# Returns\r\n\r\n\r\n\r\nSend it back.  \r\n".encode())
    (tmp_path / "old.txt").write_bytes("caf\xe9 rules".encode("cp1252"))
    (tmp_path / "page.HTML").write_text("<title>Ship</title><p>Fast</p>")
    (tmp_path / "empty.md").write_text(" \n ")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG")
    out = {r["path"].rsplit("/", 1)[1]: r for r in readers.help_files(spark, str(tmp_path)).collect()}
    assert (out["returns_policy.md"]["title"], out["returns_policy.md"]["text"]) == ("Returns", "# Returns\n\nSend it back.")
    assert (out["old.txt"]["title"], out["old.txt"]["text"]) == ("old", "café rules")
    assert (out["page.HTML"]["title"], out["page.HTML"]["text"]) == ("Ship", "Fast")
    assert out["empty.md"]["error"].startswith("No text") and out["pic.png"]["error"].startswith("Upload")


def test_guard_and_dynamic_reset(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "tenant_id int, v string")
    writers.guarded(df, path, partition_by=("tenant_id",))
    with pytest.raises(writers.AlreadyExists):
        writers.guarded(df, path, partition_by=("tenant_id",))
    writers.guarded(spark.createDataFrame([(1, "c")], "tenant_id int, v string"), path, reset=True, partition_by=("tenant_id",))
    assert rows(spark.read.parquet(path), "tenant_id", "v") == [(1, "c"), (2, "b")]


def test_missing_corrections_are_an_empty_frame(spark, tmp_path):
    df = readers.corrections(spark, str(tmp_path / "none"))
    assert df.count() == 0 and "corrected_at" in df.columns
