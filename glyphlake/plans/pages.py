"""Queries over whole pages: header fields, zones, columns, catalogs from JSON, records, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, roles, text
from ..operators import aggregates, cluster, items, layout, lines, matching, spatial
from ..session import dealt, load
from ..sources import records, wire
from .catalog import _BOXES, _NESTED, _nested, boxes, query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order's page: number, date, column headers, one line for each item, total."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pages = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.array(F.concat(F.lit("Invoice No: INV-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")), F.concat(F.lit("Date "), F.date_format("o_orderdate", "dd.MM.yyyy")), F.lit("Item Qty Price Amount"))
    middle = F.transform(F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: i > 0), lambda i: F.concat(F.lit("thing "), i.cast("string")))
    whole = F.concat(first, middle, F.array(F.concat(F.lit("Total "), F.format_string("%.2f", "o_totalprice"))))
    rows = pages.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(whole).alias("line_no", "text"))
    return rows.withColumn("norm", text.normalize_text(F.col("text"), unicode=False)).withColumn("confidence", F.lit(0.9))


@query(
    """WITH i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS doc_id, 'INV-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS invoice_number, CAST(o_orderdate AS DATE) AS invoice_date, 0.9 AS confidence,
      3 AS "start", CAST(3 + coalesce(n, 0) AS INT) AS "end", round(o_totalprice, 2) AS total FROM orders LEFT JOIN i ON o_orderkey = l_orderkey"""
)
def r18_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and table span of order pages."""
    return lines.header_fields(_lines(spark, sf_dir), False).withColumn("end", F.col("end").cast("int"))


@query(f"WITH {_BOXES}, t AS (SELECT doc_id, min(y) AS top, max(y + h) AS bottom FROM boxes WHERE row BETWEEN 2 AND 3 GROUP BY doc_id) SELECT b.doc_id, box_id, CASE WHEN top IS NULL THEN 'unknown' WHEN y + h / 2 < top - 10 THEN 'header' WHEN y + h / 2 > bottom + 10 THEN 'footer' ELSE 'table' END AS zone FROM boxes b LEFT JOIN t ON b.doc_id = t.doc_id")
def p09_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes above, in and below the second and third rows."""
    b = boxes(spark, sf_dir)
    bounds = b.where("row between 2 and 3").groupBy("doc_id").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    zone = layout.zone_of(F.col("y") + F.col("h") / 2, F.col("top"), F.col("bottom"))
    return b.join(bounds, "doc_id", "left").select("doc_id", "box_id", zone.alias("zone"))


@query(f"WITH {_BOXES} SELECT role, CASE role WHEN 'product_name' THEN 'arabic_text' ELSE 'number' END AS kind, 'table' AS zone, count(*) AS n FROM boxes GROUP BY role")
def p14_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and zone by role, and how many boxes have them."""
    rows = boxes(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("role", roles.content_kind(F.col("role")).alias("kind"), roles.zone(F.col("role")).alias("zone"), "n")


@query(f"WITH {_BOXES}, c AS (SELECT doc_id, row, CAST((x - 100) / 200 AS INT) AS col FROM boxes WHERE (l_partkey + box_id) % 5 <> 0), r AS (SELECT doc_id, row FROM c GROUP BY doc_id, row HAVING count(*) >= 2) SELECT doc_id, row, CAST(k AS INT) AS col FROM r, range(4) t(k) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = r.doc_id AND c.row = r.row AND c.col = k)")
def j16_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns without a cell in rows of two cells or more."""
    cells = boxes(spark, sf_dir).where((F.col("l_partkey") + F.col("box_id")) % 5 != 0).select("doc_id", "row", ((F.col("x") - 100) / 200).cast("int").alias("col"))
    return spatial.missing_columns(cells, 4)


@query(f"WITH {_BOXES}, f AS (SELECT doc_id, box_id, (x + l_partkey % 150) / 1000 AS f FROM boxes) SELECT doc_id, box_id, CASE WHEN f >= 0.1 AND f < 0.25 THEN 'number' WHEN f >= 0.2 AND f < 0.45 THEN 'date' WHEN f >= 0.7 AND f < 0.85 THEN 'arabic_text' ELSE 'any' END AS kind FROM f")
def j15_column_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content kinds by overlapping ranges of the page width."""
    fraction = (F.col("x") + F.pmod("l_partkey", F.lit(150))) / 1000
    kind = spatial.column_kind(fraction, [(0.1, 0.25, "number"), (0.2, 0.45, "date"), (0.7, 0.85, "arabic_text")], "any")
    return boxes(spark, sf_dir).select("doc_id", "box_id", kind.alias("kind"))


@query(f"WITH {_BOXES}, s(slot, center) AS (VALUES (0, 140.0), (1, 340.0), (2, 540.0), (3, 740.0)), p AS (SELECT doc_id, box_id AS item_id, slot, abs(x + 40 + (l_partkey % 220) - center) AS far FROM boxes, s), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY far, slot) AS n FROM p) SELECT doc_id, item_id, CASE WHEN far <= 80 THEN slot END AS slot FROM b WHERE n = 1")
def j14_nearest_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of four column slots, none beyond 80."""
    items = boxes(spark, sf_dir).select("doc_id", F.col("box_id").alias("item_id"), (F.col("x") + 40 + F.pmod("l_partkey", F.lit(220))).cast("double").alias("center"))
    return spatial.nearest_slot(items, [(0, 140.0), (1, 340.0), (2, 540.0), (3, 740.0)], F.lit(80.0))


@query(f"WITH {_BOXES}, o AS (SELECT doc_id, box_id, y, h, greatest(h, lag(h) OVER (PARTITION BY doc_id ORDER BY y, box_id)) AS reach, y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, box_id) AS gap FROM boxes) SELECT doc_id, box_id, CAST(sum(CASE WHEN gap > 0.35 * reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y, box_id ROWS UNBOUNDED PRECEDING) AS INT) AS cluster FROM o")
def w05_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes next to each other by a share of their height."""
    return cluster.pair_clusters(boxes(spark, sf_dir), ["doc_id"], "y", "h", "box_id").select("doc_id", "box_id", "cluster")


@query(
    f"""WITH RECURSIVE {_BOXES}, p AS (SELECT doc_id, box_id, CAST(y + (l_partkey * box_id) % 180 AS DOUBLE) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY box_id) AS k FROM boxes),
    fold AS (SELECT doc_id, box_id, k, 0 AS cluster, [1.0::DOUBLE] AS n, [p] AS s FROM p WHERE k = 1
      UNION ALL SELECT doc_id, box_id, k, spot - 1, CASE WHEN spot <= len(n) THEN list_transform(n, lambda v, i: CASE WHEN i = spot THEN v + 1 ELSE v END) ELSE list_append(n, 1.0::DOUBLE) END,
        CASE WHEN spot <= len(n) THEN list_transform(s, lambda v, i: CASE WHEN i = spot THEN v + p ELSE v END) ELSE list_append(s, p) END
      FROM (SELECT p.doc_id, p.box_id, p.k, p.p, f.n, f.s, coalesce(list_min(list_filter(range(1, len(f.n) + 1), lambda i: abs(p.p - f.s[i] / f.n[i]) <= 12)), len(f.n) + 1) AS spot FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1))
    SELECT doc_id, box_id, CAST(cluster AS INT) AS cluster FROM fold"""
)
def w03_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, in any order of height, to the first of all lines whose mean is near."""
    shaken = boxes(spark, sf_dir).withColumn("y", F.col("y") + (F.col("l_partkey") * F.col("box_id")) % 180)
    found = cluster.first_fit_clusters(shaken, ["doc_id"], "y", "box_id", F.greatest(0.6 * F.avg("h"), F.lit(1.0)))
    return found.select("doc_id", F.col("id").alias("box_id"), "cluster")


@query(
    """WITH e AS (SELECT n_regionkey AS request_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS o, * FROM nation)
    SELECT request_id, 25 AS max_candidates, 'merchant' AS kind, CAST(o AS INT) AS entry_ord, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS BIGINT) END AS entry_id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) ELSE '' END AS alias FROM e"""
)
def s07_catalog_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as catalogs of requests in JSON, every third as a bare string, and one without a name."""
    record = F.to_json(F.struct(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.array(F.lower("n_name")).alias("aliases")))
    entry = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))).otherwise(record)
    rows = load(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", entry.alias("entry")).groupBy("n_regionkey")
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "entry"))).alias("e"))
    text_of = F.concat(F.lit('{"max_candidates": 40, "merchants": ['), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit(', {"id": 7, "name": " "}]}'))
    entries = records.catalogs(listed.select(F.col("n_regionkey").alias("request_id"), text_of.alias("options")))
    return entries.select("request_id", "max_candidates", "kind", "entry_ord", "entry_id", "name", F.array_join("aliases", ",").alias("alias"))


@query(f"WITH {_BOXES} SELECT doc_id, printf('%03d.png', box_id) AS file, role AS text, 'any' AS kind, x, y, w, h, CASE WHEN confidence > 0 THEN confidence END AS detect_confidence, confidence = 0 AS synthesised, CAST(box_id AS VARCHAR) AS source_id FROM boxes")
def s11_crop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop records of boxes."""
    b = boxes(spark, sf_dir).withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")))
    crops = b.select("doc_id", F.col("box_id").alias("ord"), F.col("role").alias("text"), F.lit("any").alias("kind"), "x", "y", "w", "h", "confidence", F.col("box_id").cast("string").alias("source_id"))
    return records.crop_records(crops)


@query(
    f"""WITH {_NESTED}, n AS (SELECT * FROM nested), bands AS (SELECT *, unnest(range(CAST((y - 1) // 60 AS INT), CAST((y + h + 1) // 60 AS INT) + 1)) AS band FROM n)
    SELECT DISTINCT a.doc_id, a.box_id AS a, b.box_id AS b FROM bands a JOIN bands b ON a.doc_id = b.doc_id AND a.band = b.band
    WHERE a.box_id < b.box_id AND a.x - 1 < b.x + b.w + 1 AND b.x - 1 < a.x + a.w + 1 AND a.y - 1 < b.y + b.h + 1 AND b.y - 1 < a.y + a.h + 1"""
)
def j12_overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes that overlap when both are grown by a pixel."""
    return spatial.overlap_edges(_nested(spark, sf_dir))


@query("SELECT o_orderkey AS doc_id, round(s, 2) AS items, abs(o_totalprice - s) <= 0.05 AS agrees FROM orders LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice ELSE 0 END) AS s FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def a11_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's lines, some of them unread, add up to its total."""
    unread = F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), unread.alias("total_price"))
    found = aggregates.totals_agree(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("total")), rows)
    return found.withColumn("items", F.round("items", 2))


@query("SELECT user_id, count(*) AS n, median(value) AS middle, avg(CASE WHEN value > 0 THEN value ELSE 0.5 END) AS confidence FROM events GROUP BY user_id")
def a05_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, and means where an unknown value counts 0.5, by user."""
    rows = load(spark, sf_dir, "events")
    known = F.when(F.col("value") > 0, F.col("value"))
    return aggregates.middle(rows, "value", "user_id").join(rows.groupBy("user_id").agg(aggregates.line_confidence(known).alias("confidence")), "user_id")


@query("SELECT user_id, event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS cluster FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 86400 THEN 1 ELSE 0 END AS s FROM events)")
def w04_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W04 on time: a user's events with gaps of more than a day between islands."""
    rows = load(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return cluster.gap_clusters(rows, ["user_id"], "at", "event_id", F.lit(86400.0)).select("user_id", "event_id", "cluster")


def _field(value, confidence, *, candidates: bool = False, box=None):
    """A field of an invoice."""
    from ..operators.headers import CANDIDATES

    place = F.struct(*[v.cast("int").alias(c) for c, v in zip("xywh", box, strict=True)]) if box else F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")
    parts = [value.alias("value"), confidence.alias("confidence"), place.alias("bbox")]
    found = F.array(F.struct(F.lit(1).alias("rank"), F.col("id").cast("bigint").alias("entry_id"), value.alias("entry_name"), value.alias("matched_name"), F.lit(87.5).alias("score"))).cast(CANDIDATES)
    return F.struct(*parts, F.when(F.col("id") % 2 == 0, found).alias("candidates")) if candidates else F.struct(*parts)


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Invoices of orders: headers and items of fields. Every third date is unreadable, even ids have a candidate."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    table = load(spark, sf_dir, "lineitem")
    rows = dealt(table.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), table, "l_orderkey").withColumn("id", F.col("l_partkey"))
    price = F.col("l_extendedprice")
    fields = rows.select(
        F.col("l_orderkey").alias("doc_id"), rank.alias("row_index"),
        _field(F.concat(F.lit(" part "), F.col("l_partkey").cast("string")), F.lit(0.91236), candidates=True, box=[F.col("l_partkey") % 500, rank * 40, F.lit(80), F.lit(20)]).alias("product_name"),
        _field(F.col("l_quantity"), F.lit(0.5)).alias("quantity"), _field(F.round(price / F.col("l_quantity"), 2), F.lit(0.5)).alias("unit_price"), _field(price, F.lit(None).cast("double")).alias("total_price"),
    )
    day = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    # as many parts as the lines have, so that both meet where they lie
    orders = dealt(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), table, "o_orderkey").withColumn("id", F.col("o_orderkey"))
    heads = orders.select(
        F.col("o_orderkey").alias("doc_id"), _field(F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(0.8)).alias("invoice_number"),
        _field(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), F.lit(0.8), candidates=True).alias("merchant_name"), _field(day, F.lit(0.8)).alias("invoice_date"),
        _field(F.lit(" "), F.lit(0.8), candidates=True).alias("city"), _field(F.col("o_totalprice"), F.lit(0.8)).alias("total_amount"),
    )
    return heads, fields


@query(
    """WITH l AS (SELECT l_orderkey, list({'name': 'part ' || l_partkey, 'x': CAST(l_partkey % 500 AS BIGINT), 'q': CAST(l_quantity AS BIGINT), 't': round(l_extendedprice, 2), 'm': CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS doc_id, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS invoice_id, 'customer ' || o_custkey AS customer, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS customer_id, CASE WHEN o_orderkey % 2 = 0 THEN '0.875' END AS score,
      CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, round(o_totalprice, 2) AS total, coalesce(len(p), 0) AS n, p[1].name AS first_name, p[1].m AS first_id, p[1].x AS first_x, p[1].q AS first_quantity, round(p[len(p)].t, 2) AS last_total,
      'bounding_box,ocr_confidence,original_value,results' AS matched_keys FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""
)
def s13_invoice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices of orders as JSON, read back: values, matches, boxes, and which keys a matched field has."""
    made = wire.FORMATTERS.get("invoice_json")(*_runs(spark, sf_dir), False)
    at = lambda path, of="json": F.get_json_object(of, path)
    # parts are cut out once, so that the whole text isn't read again for each of their values
    cut = made.withColumns({"products": at("$.products"), "customer_name": at("$.customer_name")}).withColumns({"first": at("$[0]", "products"), "best": at("$.results[0]", "customer_name")})
    n = F.coalesce(F.json_array_length("products"), F.lit(0))
    last = F.get(F.from_json("products", "array<struct<total_price:struct<value:double>>>"), n - 1)["total_price"]["value"]
    return cut.select(
        "doc_id", at("$.invoice_id.value").alias("invoice_id"), at("$.original_value", "customer_name").alias("customer"), at("$.id", "best").alias("customer_id"),
        at("$.string_matching_score", "best").alias("score"), at("$.date.value").alias("day"), at("$.total_invoice_price.value").cast("double").alias("total"), n.cast("bigint").alias("n"),
        at("$.product_name.original_value", "first").alias("first_name"), at("$.product_name.results[0].id", "first").alias("first_id"), at("$.product_name.bounding_box.x", "first").cast("bigint").alias("first_x"),
        at("$.quantity.value", "first").cast("bigint").alias("first_quantity"), last.alias("last_total"), F.array_join(F.json_object_keys(at("$.city")), ",").alias("matched_keys"),
    )



@query(
    f"""WITH {_BOXES}, p AS (SELECT doc_id, list({{'id': box_id, 'role': role, 'box': '[' || x || ',' || y || ',' || (x + w) || ',' || (y + h) || ']', 'c': round(confidence, 4)}} ORDER BY box_id) AS e FROM boxes GROUP BY doc_id)
    SELECT o_orderkey AS doc_id, CAST(o_custkey AS BIGINT) AS customer, coalesce(len(e), 0) AS n, CAST(e[1].id AS VARCHAR) AS first_id, e[1].role AS role, e[1].box AS bbox, e[1].c AS confidence, CASE WHEN e IS NOT NULL THEN 'true' END AS editable, CASE WHEN e[2].id % 2 = 0 THEN 't1' END AS table_id FROM orders LEFT JOIN p ON doc_id = o_orderkey"""
)
def s14_overlay_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all of their boxes as JSON, read back."""
    even = F.col("box_id") % 2 == 0
    elements = boxes(spark, sf_dir).select(
        "doc_id", F.col("box_id").alias("ord"), F.col("box_id").cast("string").alias("id"), F.when(even, "table_cell").otherwise("field").alias("kind"), "role", F.lit("table").alias("zone"), "x", "y", "w", "h",
        F.col("role").alias("raw_text"), F.col("role").alias("corrected_text"), "confidence", F.array().cast("array<string>").alias("candidates"), F.when(even, "t1").alias("table_id"), "row", F.lit(1).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"),
    )
    # as many parts as the boxes have, so that both meet where they lie
    pages = dealt(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), load(spark, sf_dir, "lineitem"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("customer"))
    made = wire.FORMATTERS.get("ui_overlay_json")(pages, elements)
    at = lambda path: F.get_json_object("json", path)
    return made.select(
        "doc_id", at("$.customer").cast("bigint").alias("customer"), F.json_array_length(at("$.elements")).cast("bigint").alias("n"), at("$.elements[0].id").alias("first_id"), at("$.elements[0].role").alias("role"), at("$.elements[0].bbox").alias("bbox"),
        at("$.elements[0].confidence").cast("double").alias("confidence"), at("$.elements[0].editable").alias("editable"), at("$.elements[1].cell.table_id").alias("table_id"),
    )


@query(
    """SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS row_index, ' part ' || l_partkey AS product_name, l_quantity AS quantity, l_extendedprice AS total_price, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS invoice_number FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def s15_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as flat rows."""
    return wire.FORMATTERS.get("csv")(*_runs(spark, sf_dir)).select("doc_id", "row_index", "product_name", "quantity", "total_price", "invoice_number")


@query(
    """WITH s AS (SELECT p_partkey, p_partkey % 4 AS k, CAST('0x' || substr(sha256(p_name || p_partkey), 1, 8) AS BIGINT) AS s FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN CAST(s % 1000 AS VARCHAR) WHEN 1 THEN '2026/' || (s % 12 + 1) || '/' || (s % 28 + 1) WHEN 2 THEN ['سكر', 'أرز', 'زيت', 'شاي', 'حليب', 'ورق', 'قلم'][CAST(s % 7 AS INT) + 1] || ' ' || (s % 100) ELSE 'txt' || (s % 10000) END AS text FROM s"""
)
def s18_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The echo reader's answers for made-up crops of four kinds."""
    kind = F.element_at(F.array(*map(F.lit, ("number", "date", "arabic_text", "any"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    crop = F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary")
    return load(spark, sf_dir, "part").select("p_partkey", wire.echo(wire.echo_seed(crop), kind).alias("text"))


_H = "((({a}) * 7919 + ({b}) * 104729 + {c} * 1299709 + 15485863) * 48271 % 2147483647)"


def _h(a: str, b: str, c: int) -> str:
    return _H.format(a=a, b=b, c=c)


@query(
    f"""WITH p AS (SELECT i AS doc_id, 2 + {_h("i", "0", 1)} % 4 AS n FROM range((SELECT count(*) FROM supplier)) t(i)),
    r AS (SELECT doc_id, n, r, 1 + {_h("doc_id", "r", 2)} % 9 AS q, 100 + {_h("doc_id", "r", 3)} % 9900 AS c FROM (SELECT *, unnest(range(n)) AS r FROM p)),
    t AS (SELECT doc_id, max(n) AS n, sum(q * c) AS c FROM r GROUP BY doc_id),
    f AS (SELECT doc_id, 'item ' || r AS text, 400 AS x, 240 + 40 * r AS y FROM r UNION ALL SELECT doc_id, CAST(q AS VARCHAR), 250, 240 + 40 * r FROM r
      UNION ALL SELECT doc_id, printf('%.2f', c / 100), 150, 240 + 40 * r FROM r UNION ALL SELECT doc_id, printf('%.2f', q * c / 100), 60, 240 + 40 * r FROM r
      UNION ALL SELECT doc_id, 'merchant ' || ({_h("doc_id", "0", 4)} % 500) || ' trading', 300, 20 FROM t UNION ALL SELECT doc_id, 'invoice no INV-' || lpad(CAST({_h("doc_id", "0", 5)} % 100000 AS VARCHAR), 5, '0'), 250, 60 FROM t
      UNION ALL SELECT doc_id, 'date ' || strftime(DATE '2024-01-01' + CAST({_h("doc_id", "0", 6)} % 700 AS INT), '%d/%m/%Y'), 300, 100 FROM t UNION ALL SELECT doc_id, 'city: town ' || ({_h("doc_id", "0", 7)} % 50), 300, 140 FROM t
      UNION ALL SELECT doc_id, 'item qty price amount', 300, 200 FROM t UNION ALL SELECT doc_id, 'total ' || printf('%.2f', c / 100), 250, 280 + 40 * n FROM t)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, text, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 60 AS w, 20 AS h, 0.9 AS confidence FROM f"""
)
def s17_synthetic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up pages, as many as there are suppliers."""
    return records.synthetic_pages(spark, load(spark, sf_dir, "supplier").count())


_CELLS = """cells AS (SELECT l_orderkey AS doc_id, rk AS row, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, printf('%.2f', p_retailprice) AS p,
    printf('%.2f', round(l_quantity * p_retailprice, 2)) AS t, p_name AS n, l_orderkey % 2 = 0 AS labelled
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem) JOIN part ON l_partkey = p_partkey)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of order pages from right to left: name, quantity, price, total; pages of even orders have roles."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    table = load(spark, sf_dir, "lineitem")
    ranked = dealt(table.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), table, "l_orderkey").withColumn("row", rank)
    priced = ranked.join(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    # dealt again by page before lines become cells
    rows = dealt(priced.select("l_orderkey", "row", "l_quantity", "p_name", "p_retailprice"), table, "l_orderkey")
    shown = (
        ("product_name", 700, F.col("p_name")),
        ("quantity", 500, F.col("l_quantity").cast("bigint").cast("string")),
        ("unit_price", 300, F.format_string("%.2f", "p_retailprice")),
        ("line_total", 100, F.format_string("%.2f", F.round(F.col("l_quantity") * F.col("p_retailprice"), 2))),
    )
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("role"), F.lit(x).alias("x"), t.alias("text")) for i, (r, x, t) in enumerate(shown)])).alias("c")
    made = rows.select(F.col("l_orderkey").alias("doc_id"), "row", cells)
    role = F.when(F.col("doc_id") % 2 == 0, F.col("c.role")).otherwise("unknown")
    return made.select("doc_id", F.lit("t1").alias("table_id"), "row", "c.ord", role.alias("role"), "c.x", "c.text")


@query(f"WITH {_CELLS} SELECT doc_id, CAST(row - 1 AS INT) AS row_index, n AS product_name, CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) AS unit_price, CAST(t AS DOUBLE) AS total_price, true AS arithmetic_ok FROM cells")
def r05_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from roles on half of the pages, from the grid on the others."""
    found = items.items(_cells(spark, sf_dir), unicode=False)
    return found.select("doc_id", "row_index", "product_name", "quantity", "unit_price", "total_price", "arithmetic_ok")


@query(f"WITH {_CELLS} SELECT doc_id, min_by(n, row) AS text FROM cells WHERE labelled GROUP BY doc_id")
def p18_pick_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first product name of each labelled page."""
    return items.pick_role(_cells(spark, sf_dir).withColumn("ord", F.col("row") * 4 + F.col("ord")), "product_name")


@query(f"WITH {_CELLS}, e AS (SELECT doc_id, row, c, x FROM cells, (VALUES (0, 700), (1, 500), (2, 300), (3, 100)) v(c, x)) SELECT doc_id, row, c AS cell_id, CASE c WHEN 0 THEN 'product_name' WHEN 1 THEN 'quantity' WHEN 2 THEN 'unit_price' ELSE 'line_total' END AS role FROM e")
def r20_label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest column of R20, W14: roles of cells by the page's own column template."""
    cells = _cells(spark, sf_dir).select("doc_id", "row", F.col("ord").alias("cell_id"), (F.col("x") + F.pmod("row", F.lit(9))).alias("x"), F.lit(80).alias("w"))
    roles_of = ["line_total", "unit_price", "quantity", "product_name"]
    return layout.label_columns(cells, cluster.column_template(cells, 4), roles_of)


def _merchants(orders: DataFrame, customers: DataFrame) -> DataFrame:
    first = F.split(F.concat(F.lit("bill to customer "), F.col("o_custkey").cast("string"), F.lit(" trading today")), " ")
    second = F.array(F.lit("invoice"), F.col("o_orderkey").cast("string"))
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(first, second)).alias("line_no", "words"))
    rows = rows.withColumn("text", F.array_join("words", " ")).withColumn("confidence", F.lit(0.9))
    catalog = customers.select(F.col("c_custkey").alias("entry_ord"), F.col("c_custkey").alias("entry_id"), F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" Trading")).alias("name"), F.array().cast("array<string>").alias("aliases"))
    return items.merchants(rows, matching.catalog_names(catalog, False), False).select("doc_id", "merchant_name", "matched_id")


@query("SELECT o_orderkey AS doc_id, 'customer ' || o_custkey || ' trading' AS merchant_name, c_custkey AS matched_id FROM orders JOIN customer ON o_custkey = c_custkey")
def r17_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants of all order pages, found among word runs of their lines, against all customers."""
    return _merchants(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"))
