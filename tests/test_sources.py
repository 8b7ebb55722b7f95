"""Sources, sinks, page parsing and streams."""

import pytest
from pyspark.sql import functions as F

from incidentry.plans import jobs
from incidentry.sources import documents, pages, tables
from incidentry.streaming import ingest


def page(*incidents):
    rows = "".join(
        f'<tr><td style="width: 15%;">{d}</td><td><div class="more">{t}</div></td></tr>' for d, t in incidents)
    return f"<html><table>{rows}</table></html>"


PAGES = [
    ("maoist", "2023", "Aug", page(("Aug-1", "One  man &amp; boy.\n Read less..."), ("Aug-12", "<b>Two</b>"), ("Aug-1", "Three"))),
    ("maoist", "2023", "Sep", page(("Sep-1", "Four"))),
    ("north", "2023", "Aug", page(("Aug-1", "Five"))),
    ("north", "2023", "Aug", '<div class="more">unpaired</div>'),
    ("north", "2023", "Odd", page(("1", "no such month"))),
]
SCHEMA = "series string, year string, month string, html string"


def test_incident_numbers(spark):
    got = sorted((r.Incident_ID, r.Date, r.Incident_Summary) for r in jobs.ingest_pages(spark.createDataFrame(PAGES, SCHEMA)).collect())
    assert got == [
        ("maoist_I08012301", "2023-08-01", "One man & boy. "), ("maoist_I08012302", "2023-08-01", "Three"),
        ("maoist_I08122301", "2023-08-12", "Two"), ("maoist_I09012301", "2023-09-01", "Four"),
        ("north_I08012301", "2023-08-01", "Five")]


def test_page_plan_has_no_shuffle(spark):
    plan = pages.incidents(spark.createDataFrame(PAGES, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", float("inf")), ("b", 1.0), ("b", 1.0)], "k string, v double")
    assert tables.append_new(first, path, "k").count() == 3  # every row of a new key
    assert tables.append_new(first, path, "k").count() == 0
    more = spark.createDataFrame([("b", 2.0), ("c", 3.0), (None, 4.0)], "k string, v double")
    assert tables.append_new(more, path, "k").count() == 2
    assert tables.append_new(more, path, "k").count() == 0
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("", 4.0), ("a", None), ("b", 1.0), ("b", 1.0), ("c", 3.0)]


def test_broken_table_is_no_empty_table(spark, tmp_path):
    (tmp_path / "t").mkdir()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        tables.append_new(spark.createDataFrame([("a",)], "k string"), str(tmp_path / "t"), "k")


def test_missing_key_appends_nothing(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(2,)], "other int")
    assert tables.unseen(a, b, "k").count() == 0
    assert tables.unseen(a, b.limit(0), "k").count() == 1
    assert tables.unseen(a, None, "k").count() == 1


def test_move_processed(spark, tmp_path):
    raw = spark.createDataFrame([(" I1 ", "x"), ("I2", "y")], "Incident_Number string, t string")
    done = spark.createDataFrame([("I1", "x")], "Incident_Number string, t string")
    left = tables.move_processed(done, raw, str(tmp_path / "done"), str(tmp_path / "raw2"))
    assert [r.Incident_Number for r in left.collect()] == ["I2"]
    assert spark.read.parquet(str(tmp_path / "raw2")).count() == 1


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("I1", 'said "no",\nthen left'), ("I2", "plain")], "id string, s string")
    path = str(tmp_path / "csv")
    tables.write_csv(df, path)
    assert sorted(map(tuple, tables.read_csv(spark, path, as_text=True).collect())) == sorted(map(tuple, df.collect()))
    assert tables.read_csv(spark, path, "id string, s string").count() == 2


def test_sheet_dates(spark, tmp_path):
    path = str(tmp_path / "sheet")
    tables.write_csv(spark.createDataFrame([("2020-02-03", "a"), ("soon", "b")], "Date string, s string"), path)
    got = {r.s: (str(r.Date), r.year, r.month) for r in tables.read_sheet(spark, path).collect()}
    assert got == {"a": ("2020-02-03", 2020, 2), "b": ("None", None, None)}


def test_metrics_documents(spark, tmp_path):
    (tmp_path / "gpt_metrics.json").write_text(
        '{"overall": {"mae": 0.5},\n "bins": {"0": {"mae": 0.1, "n": 3}},\n "timing": {"total": 9.0}}')
    (tmp_path / "mini_metrics.json").write_text('{"micro_f1": 0.8, "per_label": {"Maoist": {"f1": 0.9}}}')
    got = sorted((r.model, r.section, r.part or "", r.metric, r.value)
                 for r in documents.metric_rows(documents.read_metrics(spark, str(tmp_path))).collect())
    assert got == [("gpt", "bins", "0", "mae", 0.1), ("gpt", "bins", "0", "n", 3.0), ("gpt", "overall", "", "mae", 0.5),
                   ("gpt", "timing", "", "total", 9.0), ("mini", "overall", "", "micro_f1", 0.8),
                   ("mini", "per_label", "Maoist", "f1", 0.9)]


@pytest.fixture
def page_folder(spark, tmp_path):
    folder = str(tmp_path / "pages")
    for p in PAGES:
        spark.createDataFrame([p], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch_and_replays(spark, tmp_path, page_folder):
    target, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(checkpoint):
        ingest.ingest_pages(ingest.page_stream(spark, page_folder, 1), target, checkpoint).awaitTermination()
        return sorted(r.Incident_ID for r in spark.read.parquet(target).collect())

    batch = sorted(r.Incident_ID for r in jobs.ingest_pages(spark.createDataFrame(PAGES, SCHEMA)).collect())
    assert run(state) == batch
    assert run(state) == batch  # nothing new
    spark.createDataFrame([PAGES[0], ("maoist", "2023", "Oct", page(("Oct-2", "Six")))], SCHEMA).coalesce(1).write.mode(
        "append").parquet(page_folder)
    assert run(state) == sorted([*batch, "maoist_I10022301"])


def test_replayed_batch_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    write = ingest.append_unseen("k", path)
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    write(rows, 0)
    write(rows, 0)
    write(rows.unionByName(spark.createDataFrame([("c", 3)], "k string, v int")), 1)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "a", "b", "c"]


def test_scorer_gets_batches(spark):
    import pandas as pd

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, t string")
    out = jobs.apply_scorer(df, lambda p: pd.DataFrame({"n": p["t"].str.len(), "rows": len(p)}), "n int, rows int", batch_rows=3)
    got = out.collect()
    assert all(r.n == r.id for r in got) and max(r.rows for r in got) <= 3


def test_label_sets_keep_every_row(spark):
    df = spark.createDataFrame([(1, "Arrest, bombings"), (2, "None"), (3, None), (4, "zzzz")], "id int, raw_output string")
    got = jobs.type_label_sets(df, "id", {"arrest": "arrest", "bombing": "bombing"}).orderBy("id").collect()
    assert [(r.arrest, r.bombing) for r in got] == [(1, 1), (0, 0), (0, 0), (0, 0)]


def test_fuse_states_keeps_given_ones(spark):
    preds = spark.createDataFrame(
        [(1, ("Bihar", "Gaya", None, None), [0.0, 9.0]), (2, (None, "Gaya", None, None), [1.0, 0.0]),
         (3, (None, "Else", None, None), [0.1, 0.0]), (4, ("", None, None, None), [5.0, 0.0])],
        "id int, parsed struct<state:string,district:string,village:string,other_locations:string>, logits array<double>")
    cond = spark.createDataFrame([("Gaya", "A", 0.05), ("Gaya", "B", 0.95)], "district string, state string, p double")
    got = {r.id: r.parsed.state for r in jobs.fuse_states(preds, ["A", "B"], cond, floor=0.6).collect()}
    assert got == {1: "Bihar", 2: "B", 3: None, 4: "A"}


def test_clean_locations(spark):
    rows = [("1", "2010-05-06", "S", "D", "V", "Blk", "Blk area, Hills", "seen at blk"),
            ("2", "2004-01-01", "S", "D", None, None, None, "old"), ("3", "2011-01-01", "S", "99", None, None, None, "x"),
            ("4", "bad", "S", "D", None, None, None, "x"), ("5", "2012-01-01", "S", "D", "Hills", "Gone", "Hills", "text")]
    df = spark.createDataFrame(rows, "incident_number string, date string, state string, district string, village_name string, "
                                     "block string, other_areas string, incident_summary string")
    df = df.withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    got = {r.incident_number: r.other_locations for r in jobs.clean_locations(df).collect()}
    assert got == {"1": "Blk, Hills", "5": None}


def test_pages_of_a_batch_are_parsed_few_at_a_time():
    """Python objects of a batch do not grow with it; all its texts are there."""
    import tracemalloc

    import pyarrow as pa

    from incidentry.sources import pages as page_source

    selectors = [page_source.ITEM, page_source.DATE]
    kind = pa.struct([("t0", pa.list_(pa.string())), ("t1", pa.list_(pa.string()))])
    html = "".join(f'<div class="more">{k} {"x" * 200}</div>' for k in range(10))
    batch = pa.array([f"{k}{html}" if k % 7 else None for k in range(1000)])
    tracemalloc.start()
    try:
        got = page_source.element_arrays(batch, selectors, kind)
        assert tracemalloc.get_traced_memory()[1] < 1_500_000
    finally:
        tracemalloc.stop()
    assert len(got) == 1000 and got.field(0).value_lengths().to_pylist() == [10 if k % 7 else 0 for k in range(1000)]
    assert page_source.element_arrays(batch[:0], selectors, kind).type == kind
