"""Steps on pages stay where their rows lie: no join that Spark could send whole through the driver, no exchange but that of the table."""

from glyphlake.plans import flows, invoices, pages

DATA = "/root/testdata/sf0.001"


def plan_of(query, spark):
    return query(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def exchanged(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_writing_is_found_without_a_join(spark):
    # fifteen joins, each of which dealt the blobs out again
    plan = plan_of(invoices.i13_stacked_writing, spark)
    assert "Join" not in plan and not exchanged(plan)


def test_ruled_pages_stay_in_their_parts(spark):
    # boxes made by an explode were broadcast, as Spark takes them for as few as the orders' files
    plan = plan_of(flows.i18_grid_cells, spark)
    assert "Broadcast" not in plan and not exchanged(plan)


def test_spans_stay_in_their_parts(spark):
    # ink and places were dealt out or broadcast for each join
    plan = plan_of(invoices.i17_span_cells, spark)
    assert "Broadcast" not in plan and not exchanged(plan)


def test_form_labels_stay_in_their_parts(spark):
    # F8: forms were dealt out for their windows into as few parts as the session has, whatever the table's size
    plan = plan_of(invoices.r20_form_labels, spark)
    assert "Broadcast" not in plan and not exchanged(plan)


def test_column_labels_stay_in_their_parts(spark):
    # cells were dealt out by page after lines had become cells
    plan = plan_of(pages.r20_label_columns, spark)
    assert all("l_partkey" in line or "p_partkey" in line for line in exchanged(plan))


def test_json_is_made_where_pages_lie(spark):
    # pages and what is on them were dealt out again to meet
    for query in (pages.s14_overlay_json, pages.s13_invoice_json):
        plan = plan_of(query, spark)
        assert "Broadcast" not in plan and not exchanged(plan)


def test_boxes_are_cut_by_compiled_columns(spark):
    # arrays of cuts were transformed, filtered and sorted by functions that Spark interprets for each box
    assert "lambda" not in plan_of(invoices.i19_split_boxes, spark)
