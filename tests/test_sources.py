"""Files: race documents, tables, quarantine, pages and the stream."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from oarframe.sources import documents, scans
from oarframe.streaming import ingest

DOC = {"name": "BANDERA X", "date": "03/07/2022", "day": 1, "race_ids": ["7"], "datasource": "act", "normalized_names": [["BANDERA X", "12"], ["TROFEO Y", None]], "participants": [{"club_name": "C", "laps": ["05:31.190000"], "penalty": None}]}


def land(folder, file, /, **changes):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{file}.json", "w") as f:
        json.dump(DOC | changes, f, indent=1)


def test_documents_round_trip(spark, tmp_path):
    land(f"{tmp_path}/in", "a")
    docs = documents.read_race_documents(spark, f"{tmp_path}/in")
    row = docs.first()
    assert [(n["name"], n["edition"]) for n in row["names"]] == [("BANDERA X", 12), ("TROFEO Y", None)]
    documents.write_race_documents(docs, f"{tmp_path}/out")
    again = spark.read.schema(docs.drop("names").schema).json(f"{tmp_path}/out")
    assert again.first().asDict(True) == docs.drop("names").first().asDict(True)


def test_quarantine(spark, tmp_path):
    for i, day in enumerate((1, 2, None)):
        land(f"{tmp_path}/in", str(i), day=day)
    good = documents.quarantine(documents.read_race_documents(spark, f"{tmp_path}/in"), F.col("day") == 1, f"{tmp_path}/bad")
    assert good.count() == 1 and spark.read.json(f"{tmp_path}/bad").count() == 2


def test_read_table_parses_json_text(spark, tmp_path):
    spark.createDataFrame([(1, 2, '["00:05:49", "00:21:30.21"]', '["A"]')], "id long, race_id long, laps string, club_names string").write.parquet(f"{tmp_path}/p")
    row = documents.read_table(spark, "participant", f"{tmp_path}/p").first()
    assert (row["laps_ms"], row["club_names"], row["branch"]) == ([349000, 1290210], ["A"], None)


def test_three_tables_on_a_page(spark):
    html = "".join(f"<h2>Donostia - 0{i}-07-2023 (12:00) - 5556 metros{tag}</h2><table></table>" for i, tag in ((1, ""), (2, " - Final"), (3, "")))
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    rows = documents.explode_multi_table_pages(pages).orderBy("table").collect()
    assert [(r["table"], str(r["date"]), r["distance"], r["tag"]) for r in rows] == [(1, "2023-07-01", 5556, None), (2, "2023-07-02", 5556, "Final"), (3, "2023-07-03", 5556, None)]


def test_year_range(spark):
    docs = spark.sql("select date'2020-01-01' as date")
    assert scans.scan_by_year(docs, "all", 2022).count() == 1
    for bad in ([1950], [2100]):
        try:
            scans.scan_by_year(docs, bad)
        except ValueError:
            continue
        raise AssertionError("years out of range must raise")


def run_stream(spark, folder, known=(), crash=None, unidentified=True):
    """One run of the stream over folder/landing; what each batch hands on is in folder/out."""
    out = lambda kind: lambda batch, n: batch.select("ref_id", "name").write.mode("overwrite").parquet(f"{folder}/out/{kind}={n}")

    def merge(batch, n):
        out("merged")(batch, n)
        if crash:
            raise RuntimeError(crash)

    refs = spark.createDataFrame(list(known), "datasource_name string, ref_id string")
    query = ingest.ingest_stream(spark, f"{folder}/landing", f"{folder}/cp", lambda: refs, merge, out("aside") if unidentified else None)
    query.awaitTermination(120)


def handed_on(spark, folder, kind):
    parts = glob.glob(f"{folder}/out/{kind}=*")
    return sorted(((r["ref_id"] or ""), r["name"]) for p in parts for r in spark.read.schema("ref_id string, name string").parquet(p).collect())


def test_stream_merges_unknown_documents_once(spark, tmp_path):
    landing = f"{tmp_path}/landing"
    for name, ref in (("a", "7"), ("b", "7"), ("c", "8"), ("d", "9")):
        land(landing, name, race_ids=[ref])
    run_stream(spark, tmp_path, [("act", "9")])
    assert [r for r, _ in handed_on(spark, tmp_path, "merged")] == ["7", "8"]
    land(landing, "e", race_ids=["8"])  # comes again in a later batch, though no race was stored
    land(landing, "f", race_ids=["10"])
    run_stream(spark, tmp_path, [("act", "9")])
    assert [r for r, _ in handed_on(spark, tmp_path, "merged")] == ["10", "7", "8"]


def test_stream_keeps_documents_without_id(spark, tmp_path):
    land(f"{tmp_path}/landing", "x", race_ids=[], name="X")
    land(f"{tmp_path}/landing", "y", race_ids=None, name="Y")
    land(f"{tmp_path}/landing", "z", datasource=None, name="Z")
    land(f"{tmp_path}/landing", "w", name="W")
    run_stream(spark, tmp_path)
    assert handed_on(spark, tmp_path, "aside") == [("", "X"), ("", "Y"), ("7", "Z")]
    assert handed_on(spark, tmp_path, "merged") == [("7", "W")]


def test_stream_without_a_side_output_merges_documents_without_id(spark, tmp_path):
    land(f"{tmp_path}/landing", "x", race_ids=[], name="X")
    land(f"{tmp_path}/landing", "w", name="W")
    run_stream(spark, tmp_path, unidentified=False)
    assert handed_on(spark, tmp_path, "merged") == [("", "X"), ("7", "W")]


def test_stream_takes_late_files(spark, tmp_path):
    land(f"{tmp_path}/landing", "new", race_ids=["1"])
    run_stream(spark, tmp_path)
    land(f"{tmp_path}/landing", "old", race_ids=["2"])
    os.utime(f"{tmp_path}/landing/old.json", (1_000_000_000, 1_000_000_000))  # years before the newest file
    run_stream(spark, tmp_path)
    assert [r for r, _ in handed_on(spark, tmp_path, "merged")] == ["1", "2"]


def test_stream_takes_the_first_landed_of_a_key(spark, tmp_path):
    for name, when in (("late", 1_700_000_000), ("first", 1_600_000_000)):
        land(f"{tmp_path}/landing", name, name=name)
        os.utime(f"{tmp_path}/landing/{name}.json", (when, when))
    run_stream(spark, tmp_path)
    assert handed_on(spark, tmp_path, "merged") == [("7", "first")]


def test_stream_batch_that_failed_runs_again_whole(spark, tmp_path):
    land(f"{tmp_path}/landing", "a", race_ids=["1"])
    land(f"{tmp_path}/landing", "b", race_ids=[], name="B")
    with pytest.raises(Exception, match="power cut"):
        run_stream(spark, tmp_path, crash="power cut")  # after the merge, before the ledger
    run_stream(spark, tmp_path)
    assert [r for r, _ in handed_on(spark, tmp_path, "merged")] == ["1"]
    assert handed_on(spark, tmp_path, "aside") == [("", "B")]
    land(f"{tmp_path}/landing", "c", race_ids=["1"])
    run_stream(spark, tmp_path)
    assert [r for r, _ in handed_on(spark, tmp_path, "merged")] == ["1"]
