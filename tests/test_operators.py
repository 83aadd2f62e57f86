"""Operators on small hand-made pages."""

import random

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import numbers, text
from glyphlake.operators import cells, cluster, forms, headers, lines, matching, parse, reconcile, spatial


def solve(spark, quantity, price, total):
    """Each cell: null, or (raw, value)."""
    cells = [("quantity", quantity), ("unit_price", price), ("total_price", total)]
    schema = ", ".join(f"{c} double, {c}_raw string" for c, _ in cells)
    row = [v for _, cell in cells for v in ((None, None) if cell is None else (cell[1], cell[0]))]
    return reconcile.reconcile(spark.createDataFrame([tuple(row)], schema)).first()


@pytest.mark.parametrize(
    "quantity, price, total, want, outcome, fine",
    [
        (("3", 3.0), ("517.65", 517.65), ("155295", 155295.0), (3.0, 517.65, 1552.95), "scaled", True),
        (("3", 3.0), ("٥-١-٧,٦,٥", None), ("1552.95", 1552.95), (3.0, 517.65, 1552.95), "scaled", True),
        (("2", 2.0), ("150.00", 150.0), ("300.00", 300.0), (2.0, 150.0, 300.0), "ok", True),
        (("4", 4.0), ("25.50", 25.5), None, (4.0, 25.5, 102.0), "derived", True),
        (("4", 4.0), None, ("102.00", 102.0), (4.0, 25.5, 102.0), "derived", True),
        (("4", 4.0), None, None, (4.0, None, None), "open", True),
        (("2", 2.0), ("7", 7.0), ("9999999", 9999999.0), (2.0, 7.0, 9999999.0), "open", False),
        (None, None, None, (None, None, None), "open", True),
        (("2", 2.0), ("10.00", 10.0), ("2100", 2100.0), (2.0, 10.0, 2100.0), "open", False),
    ],
)
def test_reconcile(spark, quantity, price, total, want, outcome, fine):
    got = solve(spark, quantity, price, total)
    assert (got["quantity"], got["unit_price"], got["total_price"]) == want
    assert (got["outcome"], got["arithmetic_ok"]) == (outcome, fine)


def test_candidates(spark):
    row = spark.range(1)
    assert row.select(reconcile.decimal_candidates(F.lit("51765"))).first()[0] == [51765.0, 5176.5, 517.65]
    assert row.select(reconcile.dot_runs(F.lit("212..."), F.lit("212"))).first()[0] == ["212", "2120", "21200", "212000", "2120000"]


def test_assign_columns(spark):
    rows = [([],), ([5.0],), ([1.25, 3.0],), ([2.0, 1.25, 2.5],), ([2.5, 1.25, 2.0],), ([1.0, 2.0, 1.25, 2.5],), ([2.0, 3.0, 99.0],)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "v array<double>").select(parse.assign_columns(F.col("v"))).collect()]
    none = None
    assert got == [(none, none, none, none), (none, 0, none, none), (1, 0, none, 3.75), (0, 1, 2, none), (2, 1, 0, none), (1, 2, 3, none), (0, 1, 2, none)]


def regions(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, region_id string, ord int, x int, y int, w int, h int")


def fragments(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, frag_id long, text string, x int, y int, w int, h int, source_id string")


def test_assembly(spark):
    r = regions(spark, ("whole", 0, 0, 0, 400, 200), ("cell", 1, 10, 10, 80, 40), ("empty", 2, 500, 500, 10, 10))
    f = fragments(spark, (0, "جاكيت", 50, 20, 30, 20, None), (1, "أزرق", 20, 20, 30, 20, None), (2, "x", 20, 20, 30, 20, "ghost"), (3, "far", 10, 900, 30, 20, None), (4, "named", 20, 20, 30, 20, "whole"))
    got = {e["element_id"]: (e["text"], e["n_fragments"], e["ord"]) for e in spatial.assemble(f, r).collect()}
    assert got == {"whole": ("named", 1, 0), "cell": ("جاكيت أزرق", 2, 1), "empty": ("", 0, 2), "free:0": ("x", 1, 3), "free:1": ("far", 1, 4)}


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, box_id long, x int, y int, w int, h int")


def test_boxes(spark):
    b = boxes(spark, (0, 0, 100, 100), (10, 10, 20, 20), (200, 0, 10, 10), (200, 0, 10, 10), (205, 5, 10, 10))
    assert sorted(r["box_id"] for r in spatial.innermost(b).collect()) == [1, 4]
    assert {(r["box_id"], r["component"]) for r in spatial.page_components(b).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)}
    assert tuple(spatial.largest_component(spatial.page_components(b)).first()) == (1, 2, 3)
    assert tuple(spatial.padded_envelope(b, "doc_id").first()) == (1, -4, -4, 223, 108)
    assert sorted(r["box_id"] for r in spatial.quantised_distinct(b).collect()) == [0, 1, 2, 4]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate([0, 5, 11, 30, 32, 60])], "doc_id long, id long, p double")
    gap = cluster.gap_clusters(rows, ["doc_id"], "p", "id", F.lit(10)).orderBy("id").collect()
    assert [r["cluster"] for r in gap] == [0, 0, 0, 1, 1, 2]
    mean = cluster.mean_clusters(rows, ["doc_id"], "p", "id", F.lit(8.0)).orderBy("id").collect()
    assert [r["cluster"] for r in mean] == [0, 0, 1, 2, 2, 3]
    fit = cluster.first_fit_clusters(rows, ["doc_id"], "p", "id", F.lit(8.0)).orderBy("id").collect()
    assert [r["cluster"] for r in fit] == [0, 0, 1, 2, 2, 3]


def test_catalog(spark):
    catalog = spark.createDataFrame([(0, 12, "مؤسسة النور التجارية", ["متجر النور"]), (1, 13, "شركة الأمل", None)], "entry_ord int, entry_id long, name string, aliases array<string>")
    names = matching.catalog_names(catalog)
    probes = spark.createDataFrame([("متجر النور",), ("zzz",), ("",)], "probe string")
    best = {r["probe"]: (r["matched_id"], r["requires_manual_review"]) for r in matching.best_match(probes, names, "levenshtein").collect()}
    assert best == {"متجر النور": (12, False), "zzz": (None, True), "": (None, True)}
    assert matching.top_matches(probes, names, "levenshtein").where("probe = ''").count() == 0
    with pytest.raises(KeyError):
        matching.top_matches(probes, names, "nothing")


def test_header_lines(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 1, 50), (2, 0, 90), (3, 0, 5)], "doc_id long, line_no int, top int")
    tables = spark.createDataFrame([(1, 40), (2, 40)], "doc_id long, table_top int")
    assert sorted((r["doc_id"], r["line_no"]) for r in lines.header_lines(rows, tables).collect()) == [(1, 0), (2, 0), (3, 0)]


def test_warnings(spark):
    pages = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, None)], "doc_id long, total_amount double")
    fields = spark.createDataFrame(
        [(1, "city", "x", 0.5, True, 2), (1, "date", "y", 0.9, True, 0), (1, "merchant", None, 0.1, False, 0)], "doc_id long, name string, value string, confidence double, review boolean, candidates int"
    )
    items = spark.createDataFrame([(1, 0, 2.5, False, True, 3), (3, 0, None, True, True, 0)], "doc_id long, row_index int, total_price double, arithmetic_ok boolean, review boolean, candidates int")
    found = headers.warnings(pages, fields, items)
    want = [
        (1, "ARITHMETIC_MISMATCH", "line_items[0]"), (1, "LOW_CONFIDENCE_FIELD", "city"), (1, "MANUAL_REVIEW_REQUIRED", "city"), (1, "MANUAL_REVIEW_REQUIRED", "line_items[0].product_name"),
        (1, "TOTAL_MISMATCH", "total_amount"), (2, "NO_LINE_ITEMS", ""),
    ]
    assert sorted(tuple(r) for r in found.na.fill("").collect()) == want
    fixed = items.withColumn("arithmetic_ok", F.lit(True))
    assert sorted(tuple(r) for r in headers.renewed(found, fixed).na.fill("").collect()) == want[1:]


def merged(parts):
    """The text of a cell by plain Python; parts: text, x, y, w, h."""
    parts = [p for p in parts if p[0].strip()]
    if len(parts) <= 1:
        return "".join(p[0].strip() for p in parts)
    heights = [p[4] for p in parts if p[4] > 0]
    reach = max(0.6 * (sum(heights) / len(heights) if heights else 1.0), 1.0)
    rows = []
    for p in sorted(parts, key=lambda p: p[2] + p[4] / 2):
        row = next((r for r in rows if abs(p[2] + p[4] / 2 - sum(q[2] + q[4] / 2 for q in r) / len(r)) <= reach), None)
        if row is None:
            rows.append(row := [])
        row.append(p)
    out = []
    for row in sorted(rows, key=lambda r: sum(q[2] + q[4] / 2 for q in r) / len(r)):
        arabic = sum("\u0600" <= c <= "\u06ff" for p in row for c in p[0])
        latin = sum(c.isascii() and c.isalpha() for p in row for c in p[0])
        out.append(" ".join(p[0].strip() for p in sorted(row, key=lambda p: p[1] + p[3] / 2, reverse=arabic + latin > 0 and arabic >= latin)))
    return "\n".join(out)


def test_merged_texts(spark):
    pick = random.Random(3)
    rows, want = [], {}
    for d in range(60):
        parts = [(pick.choice(["سكر", "abc", "أزرق", " ", "12", " x "]), pick.randint(0, 300), pick.randint(0, 60), pick.randint(10, 30), pick.choice([0, 20, 24])) for _ in range(pick.randint(1, 9))]
        rows += [(d, i, *p) for i, p in enumerate(parts)]
        if any(p[0].strip() for p in parts):
            want[d] = (sum(bool(p[0].strip()) for p in parts), merged(parts))
    got = cells.merged_texts(spark.createDataFrame(rows, "doc_id long, frag_id long, text string, x int, y int, w int, h int"), "doc_id")
    assert {r["doc_id"]: (r["n"], r["text"]) for r in got.collect()} == want


def test_zipped(spark):
    row = spark.range(1)
    read = lambda crops, texts: row.select(cells.zipped(crops, texts).alias("z")).select("z.*").first()
    two = F.array(F.lit("a"), F.lit("b"))
    assert read(F.array(F.lit(1), F.lit(2)), two) == ([(1, "a"), (2, "b")], None)
    assert read(F.array(F.lit(1)), two) == (None, "2 texts for 1 crops")
    assert read(F.lit(None).cast("array<int>"), two) == (None, "2 texts for 0 crops")


def test_crop_window(spark):
    boxes = spark.createDataFrame([(1, 5, 50, 40, 20, 500, 400, 0.5), (2, 495, 50, 40, 20, 500, 400, 0.1), (3, 496, 396, 40, 20, 500, 400, 0.5), (4, 515, 50, 40, 20, 500, 400, 0.5)], "box_id int, x int, y int, w int, h int, page_w int, page_h int, ratio double")
    assert [tuple(r) for r in cells.crop_window(boxes).select("box_id", "x", "y", "w", "h").orderBy("box_id").collect()] == [(1, 0, 40, 55, 40), (2, 485, 40, 15, 40), (3, 486, 386, 14, 14)]
    assert [r["box_id"] for r in cells.crop_window(boxes, least_ink=0.2).orderBy("box_id").collect()] == [1, 3]


def test_refined(spark):
    kinds = [(0.0, 0.3, "number"), (0.3, 0.55, "date"), (0.55, 1.0, "arabic_text")]
    rows = [(1, 0, 20, 300, 480, 30, 0.9), (1, 1, 20, 20, 800, 30, 0.8), (1, 2, 700, 302, 90, 30, None), (1, 3, 10, 500, 60, 20, 0.7), (1, 4, 560, 505, 90, 20, 0.6)]
    frame = spark.createDataFrame([(*r, 1000, 1000) for r in rows], "doc_id long, box_id long, x int, y int, w int, h int, confidence double, page_w int, page_h int")
    got = [tuple(r)[1:] for r in forms.refined(frame, kinds).orderBy("place").collect()]
    assert got == [
        (0, 20, 20, 800, 30, 0.8, "date"), (1, 700, 302, 90, 30, None, "arabic_text"), (2, 310, 300, 190, 30, 0.9, "date"), (3, 20, 300, 270, 30, 0.9, "number"),
        (4, 560, 505, 90, 20, 0.6, "arabic_text"), (5, 310, 500, 230, 25, None, "date"), (6, 10, 500, 60, 20, 0.7, "number"),
    ]


def test_components_by_brute_force(spark):
    pick = random.Random(8)
    rows = [(d, 1000 - i, pick.randint(0, 400), pick.randint(0, 400), pick.randint(1, 60), pick.randint(1, 60)) for d in range(12) for i in range(60)]
    want = {}
    for d in range(12):
        page = [r for r in rows if r[0] == d]
        root = {r[1]: r[1] for r in page}
        for _ in page:
            for a in page:
                for b in page:
                    if a[2] - 1 < b[2] + b[4] + 1 and b[2] - 1 < a[2] + a[4] + 1 and a[3] - 1 < b[3] + b[5] + 1 and b[3] - 1 < a[3] + a[5] + 1 and root[a[1]] != root[b[1]]:
                        root[a[1]] = root[b[1]] = min(root[a[1]], root[b[1]])
        want |= {(d, i): c for i, c in root.items()}
    frame = spark.createDataFrame(rows, "doc_id long, box_id long, x int, y int, w int, h int")
    assert {(r["doc_id"], r["box_id"]): r["component"] for r in spatial.page_components(frame).collect()} == want


def test_header_fields_in_one_pass(spark):
    pick = random.Random(6)
    parts = ["Invoice No: INV-2291", "رقم الفاتورة 00451", "Date 14/03/2026", "التاريخ ٢٠٢٦/٠٣/١٤", "01.02.2024", "Item Qty Price", "الصنف الكمية السعر", "Total 12.50", "subtotal 7", "الاجمالي ٣٥", "net", "vat 5", "tea 2 3", "plain", "grand total 3 9.75 x"]
    rows = [(d, n, " ".join(pick.choice(parts) for _ in range(pick.randint(1, 2))), pick.choice([0.5, 0.9])) for d in range(80) for n in range(pick.randint(1, 18))]
    page = spark.createDataFrame(rows, "doc_id long, line_no int, text string, confidence double")
    page = page.withColumn("norm", text.normalize_text(F.col("text")))
    found = F.filter(F.transform(F.split("text", " "), lambda w: numbers.strict(w, False)), lambda v: v.isNotNull())
    want = {d: [None] * 6 for d in range(80)}
    for r in lines.invoice_numbers(page).collect():
        want[r["doc_id"]][0] = r["invoice_number"]
    for r in lines.invoice_dates(page).collect():
        want[r["doc_id"]][1:3] = [r["invoice_date"], r["confidence"]]
    for r in lines.table_span(page).collect():
        want[r["doc_id"]][3:5] = [r["start"], r["end"]]
    for r in lines.grand_total(page.withColumn("numbers", found), F.col("numbers")).collect():
        want[r["doc_id"]][5] = r["total"]
    got = {r["doc_id"]: list(r)[1:] for r in lines.header_fields(page).collect()}
    assert got == want and all(any(v[k] is not None for v in want.values()) for k in range(6))


def test_missing_columns_without_a_join(spark):
    pick = random.Random(16)
    rows = [(pick.choice([1, 2, 3, None]), pick.choice([0, 1, 2, None]), pick.choice([-1, 0, 1, 2, 3, 4, None])) for _ in range(60)] + [(9, 0, c) for c in range(4)] + [(9, 1, 0), (9, 2, 3), (9, 2, 3)]
    want = set()
    for d, r in {x[:2] for x in rows}:
        held = [c for *key, c in rows if key == [d, r]]
        want |= {(d, r, c) for c in range(4) if len(held) >= 2 and (d is None or r is None or c not in held)}
    found = spatial.missing_columns(spark.createDataFrame(rows, "doc_id long, row int, col int"), 4)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and found.columns == ["doc_id", "row", "col"]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # a join broadcast all cells
