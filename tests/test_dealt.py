"""Parts that follow a table's size."""

from pyspark.sql import functions as F

from glyphlake.plans import catalog, invoices
from glyphlake.session import dealt, parts_of


def test_parts_follow_the_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(300_000).select("id", F.rand(1).alias("r")).write.parquet(path)
    table = spark.read.parquet(path)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_of(table, 1000) == few
    assert parts_of(table, 0.1) > few
    assert dealt(table, table, "id", part_mb=0.1).rdd.getNumPartitions() == parts_of(table, 0.1)


def test_boxes_are_dealt_once(spark):
    # windows of a page stay in the parts of its boxes; before, Spark alone chose as few parts as there are cores
    plan = invoices.w16_reading_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_both_orders_in_one_group(spark):
    # two groups were joined before, and both moved again
    plan = catalog.QUERIES["a06_ordered_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_crop_windows_keep_boxes_of_any_confidence(spark):
    # those under 0.2 were left out before
    rows = invoices.p13_crop_windows(spark, "/root/testdata/sf0.001")
    low = catalog.boxes(spark, "/root/testdata/sf0.001").where("confidence < 0.2").select("doc_id", "box_id")
    assert rows.join(low, ["doc_id", "box_id"], "left_semi").count() > 0


def test_drawn_pages_are_dealt_by_number(spark):
    # Spark joined the parts by their few bytes, and one task drew and read all pages
    plan = invoices.i12_ink_boxes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_pages_are_assembled_where_they_lie(spark, monkeypatch):
    # F16: boxes and fragments of the pages were moved 15 times for twelve joins
    plans = []
    monkeypatch.setattr(catalog, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    catalog.j03_assemble(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in plans[0] and "ENSURE_REQUIREMENTS" not in plans[0] and "BroadcastExchange" not in plans[0]


def test_a_part_holds_some_25000_lines(spark):
    # with parts of 2 MB what a task held grew up to 100,000 lines
    assert parts_of(spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")) >= 20
