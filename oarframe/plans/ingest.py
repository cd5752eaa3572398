"""Queries of documents, tables and scans (SRC) and of the stream (STR-1).

Those that read and write files put the whole table into the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import new_path
from ..sources import documents, scans
from ..streaming.ingest import ingest_stream
from .registry import query


_CLOCK = "format_string('%02d:%02d:%02d.%03d', x div 3600000, x div 60000 % 60, x div 1000 % 60, x % 1000)"


def _race_documents(t):
    """The race documents in the form in which they are exchanged, each with the boats of its race."""
    boat = F.struct(F.get("club_names", F.lit(0)).alias("club_name"), F.col("lane").cast("int").alias("lane"), "laps_ms")
    grouped = t.participant.groupBy("race_id").agg(F.collect_list(boat).alias("boats"))
    clocks = F.expr(f"transform(boats, b -> struct(b.club_name, b.lane, transform(b.laps_ms, x -> {_CLOCK}) as laps))")
    boats = grouped.select("race_id", clocks.alias("participants"))
    edition = F.when(F.col("pos") % 10 != 0, F.coalesce("trophy_edition", "flag_edition")).cast("string")
    return t.doc.join(boats, F.col("pos") == F.col("race_id"), "left").select(
        "name", F.date_format("date", "dd/MM/yyyy").alias("date"), F.col("day").cast("int").alias("day"), "league",
        F.array(F.array("name", edition), F.array(F.col("sponsor"), F.lit(None).cast("string"))).alias("normalized_names"),
        F.array("ref_id").alias("race_ids"), F.concat(F.lit("race/"), F.col("pos").cast("string")).alias("url"), "datasource", "participants",
    )


def _written(t):
    path = new_path(t.spark)
    documents.write_race_documents(_race_documents(t), path)
    return path


@query(
    "src_1_read_race_documents",
    """SELECT 'race/' || pos AS url, datasource, name, CASE WHEN pos % 10 <> 0 THEN coalesce(trophy_edition, flag_edition) END AS edition, sponsor AS second_name, ref_id, coalesce(b.boats, 0) AS boats, b.laps AS laps
    FROM doc AS d LEFT JOIN (SELECT race_id, count(*) AS boats, CAST(sum(len(laps_ms)) AS BIGINT) AS laps FROM participant GROUP BY race_id) AS b ON b.race_id = d.pos""",
)
def _(t):
    docs = documents.read_race_documents(t.spark, _written(t), lines=True)
    laps = F.aggregate("participants", F.lit(0), lambda n, p: n + F.size(p["laps"])).cast("long")
    return docs.select("url", "datasource", F.col("names")[0]["name"].alias("name"), F.col("names")[0]["edition"].alias("edition"), F.col("names")[1]["name"].alias("second_name"), F.col("race_ids")[0].alias("ref_id"), F.coalesce(F.size("participants"), F.lit(0)).cast("long").alias("boats"), laps.alias("laps"))


@query("src_2_write_race_documents", "SELECT datasource, strftime(date, '%d/%m/%Y') AS date, count(*) AS docs, count(league) AS leagues, CAST(sum(day) AS BIGINT) AS days FROM doc GROUP BY ALL")
def _(t):
    # Read by Spark's own reader, with the source from the folders' names.
    back = t.spark.read.schema("datasource string, date string, league string, day int").json(_written(t))
    return back.groupBy("datasource", "date").agg(F.count("*").alias("docs"), F.count("league").alias("leagues"), F.sum("day").alias("days"))


@query("src_3_quarantine", "SELECT 'race/' || pos AS url, CASE WHEN day = 1 AND league <> 'LIGA 1' THEN 'kept' ELSE 'aside' END AS state FROM doc")
def _(t):
    path = new_path(t.spark)
    kept = documents.quarantine(_race_documents(t), (F.col("day") == 1) & (F.col("league") != "LIGA 1"), path)
    aside = t.spark.read.schema("url string").json(path)
    return kept.select("url", F.lit("kept").alias("state")).unionByName(aside.select("url", F.lit("aside").alias("state")))


@query(
    "src_4_read_table",
    """SELECT id, race_id, club_names[1] AS club_name, branch, CAST(lane AS INT) AS lane, len(laps_ms) AS n_laps, coalesce(CAST(list_sum(laps_ms) AS BIGINT), 0) AS total_ms, guest, CAST(NULL AS BOOLEAN) AS has_series FROM participant""",
)
def _(t):
    path = new_path(t.spark)
    texts = F.to_json(F.expr(f"transform(laps_ms, x -> {_CLOCK})"))
    t.participant.withColumn("laps", texts).withColumn("club_names", F.to_json("club_names")).drop("laps_ms").write.parquet(path)
    total = F.aggregate("laps_ms", F.lit(0).cast("long"), lambda n, x: n + x)
    return documents.read_table(t.spark, "participant", path).select("id", "race_id", F.get("club_names", F.lit(0)).alias("club_name"), "branch", F.col("lane").cast("int").alias("lane"), F.size("laps_ms").cast("long").alias("n_laps"), total.alias("total_ms"), "guest", (F.col("series") > 0).alias("has_series"))


@query(
    "str_1_ingest_stream",
    """WITH d AS (SELECT 'race/' || pos AS url, datasource, CASE WHEN pos % 11 <> 0 THEN ref_id END AS ref_id, pos % 5 = 0 OR day = 2 AS again FROM doc)
    SELECT url, datasource, ref_id, 'merged' AS state FROM d WHERE ref_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM race_ref AS f WHERE f.datasource_name = d.datasource AND f.ref_id = d.ref_id)
    UNION ALL SELECT url, datasource, ref_id, 'aside' FROM d WHERE ref_id IS NULL
    UNION ALL SELECT url, datasource, ref_id, 'aside' FROM d WHERE ref_id IS NULL AND again""",
)
def _(t):
    # Two landings and two runs: some documents land again in the second, some have no race id.
    landing, stored, checkpoint = new_path(t.spark), new_path(t.spark), new_path(t.spark)
    docs = _race_documents(t).withColumn("race_ids", F.when(F.regexp_extract("url", r"(\d+)", 1).cast("long") % 11 != 0, F.col("race_ids")))
    again = (F.regexp_extract("url", r"(\d+)", 1).cast("long") % 5 == 0) | (F.col("day") == 2)
    known = t.race_ref.select("datasource_name", "ref_id")

    def put(state):
        shown = lambda batch: batch.select("url", "datasource", "ref_id", F.lit(state).alias("state"))
        return lambda batch, batch_id: shown(batch).write.mode("overwrite").parquet(f"{stored}/part={state}-{batch_id}")

    for part in (docs, docs.filter(again)):
        part.drop("names").write.mode("append").option("compression", "gzip").json(landing)
        ingest_stream(t.spark, landing, checkpoint, lambda: known, put("merged"), put("aside"), lines=True).awaitTermination()
    return t.spark.read.schema("url string, datasource string, ref_id string, state string").parquet(stored).select("url", "datasource", "ref_id", "state")


@query("src_5_scan_by_year", "SELECT pos, ref_id FROM doc WHERE year(date) IN (1993, 1995)")
def _(t):
    return scans.scan_by_year(t.doc, [1993, 1995]).select("pos", "ref_id")


@query("src_6_scan_last_weekend", "SELECT pos, date FROM doc WHERE date BETWEEN DATE '1996-07-06' AND DATE '1996-07-07'")
def _(t):
    return scans.scan_last_weekend(t.doc, "1996-07-10").select("pos", "date")


@query("src_7_scan_by_ids", "SELECT pos FROM doc WHERE (datasource, ref_id) IN (SELECT datasource_name, ref_id FROM race_ref WHERE race_id % 28 = 0)")
def _(t):
    return scans.scan_by_ids(t.doc, t.race_ref.filter("race_id % 28 = 0").withColumnRenamed("datasource_name", "datasource")).select("pos")


@query("src_8_scan_by_entity", "SELECT pos FROM doc WHERE year(date) = 1997 AND pos % 40 = 9")
def _(t):
    docs = t.doc.withColumn("club_refs", F.array((F.col("pos") % 40).cast("string")))
    refs = t.club.select(F.col("id").alias("entity_id"), F.explode(F.array(F.struct(F.lit(1).alias("pos"), (F.col("id") + 20).cast("string").alias("ref_id")), F.struct(F.lit(0).alias("pos"), (F.col("id") + 4).cast("string").alias("ref_id")))).alias("r"), F.lit("act").alias("datasource_name"))
    return scans.scan_by_entity(docs, refs.select("entity_id", "r.*", "datasource_name"), 5, 1997, "act").select("pos")


def _flag_pages(t):
    return t.doc.filter("flag_id is not null").select("pos", F.col("flag_id").cast("string").alias("flag"), (F.col("pos") % 52 == 0).alias("known"))


@query("src_9_scan_by_flag", "SELECT pos FROM doc WHERE flag_id = 8 AND pos > coalesce((SELECT max(pos) FROM doc WHERE flag_id = 8 AND pos % 52 = 0), -1)")
def _(t):
    return scans.scan_by_flag(_flag_pages(t), "8", "pos", only_new=True).select("pos")


@query("src_9_scan_by_flag_unknown", "SELECT pos FROM doc WHERE flag_id = 8 AND pos % 52 <> 0")
def _(t):
    return scans.scan_by_flag(_flag_pages(t), "8", "pos").select("pos")


@query("src_10_drop_future", "SELECT pos FROM doc WHERE date <= DATE '1996-05-01'")
def _(t):
    return scans.drop_future(t.doc, "1996-05-01").select("pos")


@query("src_11_drop_known", "SELECT pos FROM doc AS d WHERE pos % 15 <> 0 AND NOT EXISTS (SELECT 1 FROM race_ref AS f WHERE f.datasource_name = d.datasource AND f.ref_id = d.ref_id)")
def _(t):
    return scans.drop_known(t.doc, t.race_ref, t.doc.filter("pos % 15 = 0")).select("pos")


_PAGES = "(SELECT page_id, '<h2>Place ' || page_id || ' - 01-07-2023 (12:30) - 5556 metros</h2>' || html || '<h2>Place ' || page_id || ' - 02-07-2023 (11:00) - 3000 metros - <b>Final</b></h2><h2>plain</h2>' AS html FROM pages)"


@query(
    "src_12_multi_table_pages",
    f"""SELECT page_id, CAST(i AS INT) AS "table", trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS heading,
      CASE i WHEN 1 THEN 'Place ' || page_id WHEN n - 1 THEN 'Place ' || page_id END AS place, CASE i WHEN 1 THEN DATE '2023-07-01' WHEN n - 1 THEN DATE '2023-07-02' END AS date,
      CASE i WHEN 1 THEN '12:30' WHEN n - 1 THEN '11:00' END AS time, CASE i WHEN 1 THEN 5556 WHEN n - 1 THEN 3000 END AS distance, CASE WHEN i = n - 1 THEN 'Final' END AS tag
    FROM (SELECT page_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i, len(hs) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h2[^>]*>(.*?)</h2>', 1) AS hs FROM {_PAGES}))""",
)
def _(t):
    n = F.col("page_id").cast("string")
    before = F.concat(F.lit("<h2>Place "), n, F.lit(" - 01-07-2023 (12:30) - 5556 metros</h2>"))
    after = F.concat(F.lit("<h2>Place "), n, F.lit(" - 02-07-2023 (11:00) - 3000 metros - <b>Final</b></h2><h2>plain</h2>"))
    return documents.explode_multi_table_pages(t.pages.select("page_id", F.concat(before, "html", after).alias("html")))
