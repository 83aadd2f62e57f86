"""Queries over made-up invoice pages: cell texts, labels, header fields, matches, warnings, forms and boxes, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import cells, forms, grids, headers, layout, lines, matching, spatial
from ..session import dealt, load
from .catalog import _BOXES, _NAMES, _names, boxes, query

#: Arabic words that made-up texts are put together from: item, blue, large, sugar, company, city, Damascus.
_WORDS = ("صنف", "أزرق", "كبير", "سكر", "شركة", "المدينة", "دمشق")
_PLACES = ("دمشق", "حلب", "حمص")
_SQL_WORDS = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"


def _word(index: Column, words: tuple[str, ...] = _WORDS) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(index, F.lit(len(words))).cast("int"))


def _union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first


@query(
    f"""WITH f AS (
      SELECT p_partkey AS doc_id, 1 AS line, 100 * k AS cx, w AS text FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w, unnest(range(1, len(string_split(p_name || ' ' || p_type, ' ')) + 1)) AS k FROM part)
      UNION ALL SELECT p_partkey, 2, 100 * k, {_SQL_WORDS}[CAST((p_partkey + k) % 7 AS INT) + 1] FROM part, range(3) t(k)
      UNION ALL SELECT p_partkey, 2, 350, string_split(p_name, ' ')[1] FROM part WHERE p_partkey % 2 = 0),
    n AS (SELECT doc_id, line, sum(len(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g'))) AS a, sum(len(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS l FROM f GROUP BY doc_id, line),
    t AS (SELECT f.doc_id, f.line, string_agg(text, ' ' ORDER BY CASE WHEN a >= l AND a + l > 0 THEN -cx ELSE cx END) AS text, count(*) AS n FROM f JOIN n ON f.doc_id = n.doc_id AND f.line = n.line GROUP BY f.doc_id, f.line)
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, string_agg(text, chr(10) ORDER BY line) AS text FROM t GROUP BY doc_id"""
)
def a07_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two lines, one from left to right and one mostly from right to left, with blank fragments between."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type")
    jitter = lambda k: F.pmod(F.col("doc_id") * 7 + k * 5, F.lit(9)).cast("int")
    box = lambda k, y, x: [(F.lit(100) * k - 20 + x).cast("int").alias("x"), (F.lit(y) + jitter(k)).cast("int").alias("y"), F.lit(40).alias("w"), F.lit(20).alias("h")]
    k = F.col("k")
    first = part.select("doc_id", F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("k", "text")).withColumn("k", k + 1)
    first = first.select("doc_id", (100 + k).cast("long").alias("frag_id"), "text", *box(k, 50, 0))
    second = part.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    second = second.select("doc_id", (10 + k).cast("long").alias("frag_id"), _word(F.col("doc_id") + k).alias("text"), *box(k, 90, 0))
    latin = part.where("doc_id % 2 = 0").select("doc_id", F.lit(50).cast("long").alias("frag_id"), F.get(F.split("p_name", " "), F.lit(0)).alias("text"), *box(F.lit(3), 90, 50))
    empty = part.select("doc_id", F.lit(7).cast("long").alias("frag_id"), F.lit("  ").alias("text"), *box(F.lit(1), 70, 0))
    return cells.merged_texts(_union(first, second, latin, empty), "doc_id")


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN p_name WHEN 4 THEN p_name WHEN 5 THEN p_type || '؛' || p_name END AS value FROM part"""
)
def f06_strip_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values without the label that is printed before them; the kind of mark decides, not its place."""
    name, k = F.col("p_name"), F.pmod("p_partkey", F.lit(6))
    shown = (
        F.when(k == 0, F.concat(F.lit("الاسم : "), name)).when(k == 1, F.concat(F.lit("a："), name, F.lit(" : x"))).when(k == 2, F.concat(name, F.lit(" :  ")))
        .when(k == 3, F.concat(F.lit("Qty："), name)).when(k == 4, name).otherwise(F.concat(F.lit("t: "), F.col("p_type"), F.lit("؛"), name))
    )
    return load(spark, sf_dir, "part").select("p_partkey", text.strip_label(shown).alias("value"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header words of order pages: a line with digits, a line of a city and a date on either side, a line of a business or a plain one."""
    key = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders").select(key.alias("doc_id"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.col("o_custkey").cast("string").alias("customer"))
    doc, k = F.col("doc_id"), F.pmod("doc_id", F.lit(4))
    city = F.when(k == 0, F.array(F.lit("المدينة"), F.lit(":"), _word(doc, _PLACES), F.lit("الشام"), F.lit("التاريخ"), F.col("day")))
    city = city.when(k == 1, F.array(F.col("day"), F.lit("date"), _word(doc, _PLACES), F.lit("north"), F.lit("City"))).when(k == 2, F.array(F.lit("city:"), F.lit("12"), F.lit("x")))
    city = city.otherwise(F.array(F.lit("no"), F.lit("label")))
    third = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit("ACME"), F.lit("Trading"), F.col("customer"))).otherwise(F.array(F.lit("Plain"), F.lit("name")))
    pages = F.array(F.array(F.lit("0912"), F.col("customer")), city, third)
    rows = orders.select("doc_id", F.posexplode(pages).alias("line_no", "words"))
    words = rows.select("doc_id", "line_no", F.posexplode("words").alias("ord", "text"))
    return words.withColumn("x", (F.col("ord") * 50).cast("double")).withColumn("confidence", F.when(F.col("ord") > 0, F.lit(0.9)))


@query(
    """WITH o AS (SELECT o_orderkey AS doc_id, ['دمشق', 'حلب', 'حمص'][CAST(o_orderkey % 3 AS INT) + 1] AS w, o_orderkey % 4 AS k FROM orders)
    SELECT doc_id, CASE k WHEN 0 THEN w || ' الشام' ELSE 'north ' || w END AS text, round(CASE k WHEN 0 THEN (0.5 + 5 * 0.9) / 6 ELSE (0.5 + 4 * 0.9) / 5 END * 0.85, 6) AS confidence FROM o WHERE k IN (0, 1)"""
)
def f10_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City names beside their labels, after or before them, up to the next field; Arabic and Latin."""
    return headers.cities(_heads(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'ACME Trading ' || o_custkey WHEN o_orderkey % 4 = 3 THEN 'no label' ELSE 'Plain name' END AS text,
    CASE WHEN o_orderkey % 3 = 0 THEN 0.72 ELSE 0.48 END AS confidence FROM orders"""
)
def f09_merchants_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the line with a business word, else the first without a digit."""
    grouped = _heads(spark, sf_dir).groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("w"))
    rows = grouped.select("doc_id", "line_no", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), F.lit(0.8).alias("confidence"))
    return headers.merchant_by_shape(rows).withColumn("confidence", F.round("confidence", 6))


_LEV100 = "round(100 * ((greatest(length(probe), length(name)) - levenshtein(probe, name)) / greatest(length(probe), length(name))), 2)"


@query(
    f"""WITH p AS (SELECT n_nationkey AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, 1) || substr(n_name, 3) ELSE 'zz' || n_nationkey END AS value FROM nation),
    c AS (SELECT lower(n_name) AS name, n_name, n_nationkey AS id FROM nation),
    s AS (SELECT doc_id, value, n_name, id, {_LEV100} AS score FROM (SELECT *, lower(value) AS probe FROM p), c),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS r FROM s)
    SELECT doc_id, value, CASE WHEN max(score) >= 75 THEN max(CASE WHEN r = 1 THEN n_name END) END AS matched_to, CASE WHEN max(score) >= 75 THEN CAST(max(CASE WHEN r = 1 THEN id END) AS BIGINT) END AS matched_id,
      round(max(score) / 100, 4) AS match_score, string_agg(n_name, ',' ORDER BY r) AS candidates, max(score) < 75 AS requires_manual_review FROM r WHERE r <= 3 GROUP BY doc_id, value"""
)
def p16_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a letter missing, or of nothing, against a catalog; the reading stays the value."""
    k, name = F.pmod("n_nationkey", F.lit(3)), F.col("n_name")
    nation = load(spark, sf_dir, "nation")
    value = F.when(k == 0, name).when(k == 1, F.concat(F.substring(name, 1, 1), F.substring(name, 3, 99))).otherwise(F.concat(F.lit("zz"), F.col("n_nationkey").cast("string")))
    fields = nation.select(F.col("n_nationkey").alias("doc_id"), value.alias("value"), F.lit(0.9).alias("confidence"))
    catalog = nation.select(F.col("n_nationkey").alias("entry_ord"), F.col("n_nationkey").cast("long").alias("entry_id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))
    found = headers.enveloped(fields, matching.catalog_names(catalog, False), k=3, unicode=False)
    listed = F.array_join(F.transform("candidates", lambda c: c["entry_name"]), ",")
    return found.select("doc_id", "value", "matched_to", "matched_id", "match_score", listed.alias("candidates"), "requires_manual_review")


_ITEMS = """items AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS row_index, round(l_extendedprice, 2) AS total_price,
    l_partkey % 5 <> 0 AS arithmetic_ok, l_partkey % 3 = 0 AS review, CAST(l_partkey % 2 AS INT) AS candidates FROM lineitem)"""
_WARNED = f"""WITH {_ITEMS},
    fields AS (SELECT o_orderkey AS doc_id, 'merchant_name' AS name, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS value, (o_custkey % 10) / 10 AS confidence, o_custkey % 3 = 0 AS review, CAST(o_custkey % 2 AS INT) AS candidates FROM orders),
    sums AS (SELECT doc_id, sum(total_price) AS s FROM items GROUP BY doc_id),
    found AS (SELECT doc_id, 'LOW_CONFIDENCE_FIELD' AS code, name AS field FROM fields WHERE value IS NOT NULL AND confidence < 0.75
      UNION ALL SELECT doc_id, 'MANUAL_REVIEW_REQUIRED', name FROM fields WHERE review AND candidates > 0
      UNION ALL SELECT doc_id, 'MANUAL_REVIEW_REQUIRED', 'line_items[' || row_index || '].product_name' FROM items WHERE review AND candidates > 0
      UNION ALL SELECT o_orderkey, 'NO_LINE_ITEMS', NULL FROM orders WHERE NOT EXISTS (SELECT 1 FROM items WHERE doc_id = o_orderkey)
      UNION ALL SELECT o_orderkey, 'TOTAL_MISMATCH', 'total_amount' FROM orders JOIN sums ON o_orderkey = doc_id WHERE o_orderkey % 5 <> 0 AND abs(s - o_totalprice) > 0.05
      UNION ALL SELECT doc_id, 'ARITHMETIC_MISMATCH', 'line_items[' || row_index || ']' FROM items WHERE NOT arithmetic_ok)"""


def _warned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Warnings of order pages, and their items."""
    orders = load(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    part = F.col("l_partkey")
    items = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), rank.alias("row_index"), F.round("l_extendedprice", 2).alias("total_price"), (part % 5 != 0).alias("arithmetic_ok"), (part % 3 == 0).alias("review"), (part % 2).cast("int").alias("candidates"),
    )
    pages = orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("total_amount"))
    customer = F.col("o_custkey")
    fields = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("merchant_name").alias("name"), F.when(customer % 4 != 0, customer.cast("string")).alias("value"), (customer % 10 / 10).alias("confidence"), (customer % 3 == 0).alias("review"), (customer % 2).cast("int").alias("candidates"))
    return headers.warnings(pages, fields, items), items


@query(_WARNED + " SELECT doc_id, code, field FROM found")
def r16_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All warnings of order pages."""
    return _warned(spark, sf_dir)[0]


@query(
    _WARNED
    + """ SELECT code, count(*) AS n FROM (SELECT code FROM found WHERE code <> 'ARITHMETIC_MISMATCH' UNION ALL SELECT 'ARITHMETIC_MISMATCH' FROM items WHERE NOT arithmetic_ok AND row_index % 2 = 0) GROUP BY code"""
)
def u03_renewed_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings after every second row was put right; how many of each there are."""
    found, items = _warned(spark, sf_dir)
    after = items.withColumn("arithmetic_ok", F.col("arithmetic_ok") | (F.col("row_index") % 2 == 1))
    return headers.renewed(found, after).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey AS doc_id, 'NO_LAYOUT_DETECTED' AS code, CASE WHEN o_orderkey % 2 = 1 THEN 'no text was found' WHEN o_orderkey % 3 = 0 THEN 'no ruled layout was found' ELSE 'no cell of the layout has a role' END AS message
    FROM orders WHERE CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 7 = 0 ELSE o_orderkey % 3 = 0 OR o_custkey % 5 = 0 END"""
)
def r19_flow_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which a flow found nothing to work with."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    pages = load(spark, sf_dir, "orders").select(key.alias("doc_id"), F.when(key % 2 == 1, "detector_driven").otherwise("layout_driven").alias("flow"), (key % 3).alias("regions"), (customer % 5).alias("labelled"), (customer % 7).alias("fragments"))
    return headers.flow_warnings(pages)


@query(
    f"WITH {_BOXES}, f AS (SELECT doc_id, box_id, CASE role WHEN 'product_name' THEN 'a: ' || l_partkey WHEN 'quantity' THEN CASE WHEN l_partkey % 2 = 0 THEN 'x :' ELSE '7' END ELSE role END AS text, role FROM boxes), "
    "q AS (SELECT doc_id, min(box_id) FILTER (role = 'quantity' AND text = '7') AS b, bool_or(role = 'quantity') AS any_q FROM f GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN b IS NOT NULL THEN '7' END AS value, CASE WHEN b IS NOT NULL THEN '7' ELSE 'guess' END AS chosen FROM q"
)
def p17_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled value of each page, where one is left without its label, before what was guessed."""
    from ..operators import items

    shown = F.when(F.col("role") == "product_name", F.concat(F.lit("a: "), F.col("l_partkey").cast("string"))).when(F.col("role") == "quantity", F.when(F.col("l_partkey") % 2 == 0, "x :").otherwise("7")).otherwise(F.col("role"))
    named = headers.labelled(boxes(spark, sf_dir).select("doc_id", F.col("box_id").alias("ord"), "role", shown.alias("text"), "confidence"), "quantity")
    return named.select("doc_id", "value", items.override(F.lit("guess"), F.col("value")).alias("chosen"))


@query(f"WITH {_BOXES}, l AS (SELECT DISTINCT doc_id, row, y FROM boxes WHERE role = 'quantity'), t AS (SELECT doc_id, max(y) AS table_top FROM l WHERE doc_id % 3 <> 0 GROUP BY doc_id), j AS (SELECT l.doc_id, row, coalesce(y < table_top, true) AS above FROM l LEFT JOIN t ON l.doc_id = t.doc_id) SELECT doc_id, row AS line_no FROM (SELECT *, bool_or(above) OVER (PARTITION BY doc_id) AS any_above FROM j) WHERE above OR NOT any_above")
def p02_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines above the table; all lines of a page without a table, or without a line above it."""
    rows = boxes(spark, sf_dir).where("role = 'quantity'").select("doc_id", F.col("row").alias("line_no"), F.col("y").alias("top"))
    tables = rows.where("doc_id % 3 <> 0").groupBy("doc_id").agg(F.max("top").alias("table_top"))
    return lines.header_lines(rows, tables).select("doc_id", "line_no")


@query(f"WITH {_BOXES}, s AS (SELECT doc_id, box_id, 10 + l_partkey % 90 AS w, 10 + l_partkey % 37 AS h FROM boxes) SELECT doc_id, box_id FROM s WHERE w >= 15 AND h >= 20 AND w / h >= 0.3 AND w * h <= 0.2 * 160 * 80 AND w <= 0.6 * 160")
def p11_cell_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that can be cells."""
    sized = boxes(spark, sf_dir).withColumns({"w": 10 + F.col("l_partkey") % 90, "h": 10 + F.col("l_partkey") % 37})
    return sized.where(layout.is_cell(F.col("w"), F.col("h"), F.lit(160), F.lit(80))).select("doc_id", "box_id")


@query(f"WITH {_BOXES}, s AS (SELECT doc_id, box_id, x, l_partkey % 40 AS w, 5 + l_partkey % 20 AS h FROM boxes) SELECT doc_id, box_id FROM s WHERE w >= 12 AND h >= 12 AND x + w / 2 <= 0.52 * 1000")
def p12_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a detector that are large enough and not beyond a share of the width."""
    sized = boxes(spark, sf_dir).withColumns({"w": F.col("l_partkey") % 40, "h": 5 + F.col("l_partkey") % 20, "page_w": F.lit(1000)})
    return cells.detected(sized, 12, 0.52).select("doc_id", "box_id")


@query(f"WITH {_BOXES}, s AS (SELECT doc_id, box_id, x - 120 AS x0, y - 70 AS y0, greatest(x - 120 - 10, 0) AS x, greatest(y - 70 - 10, 0) AS y, least(x - 120 + 90, 620) AS x2, least(y - 70 + 30, 200) AS y2 FROM boxes) SELECT doc_id, box_id, x, y, x2 - x AS w, y2 - y AS h FROM s WHERE x2 - x >= 8 AND y2 - y >= 8")
def p13_crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around boxes, cut to the page."""
    moved = boxes(spark, sf_dir).withColumns({"x": F.col("x") - 120, "y": F.col("y") - 70, "page_w": F.lit(620), "page_h": F.lit(200)})
    return cells.crop_window(moved).select("doc_id", "box_id", "x", "y", "w", "h")


@query(f"WITH {_BOXES}, h AS (SELECT doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY doc_id), p AS (SELECT *, CAST(floor(greatest(w, h) * CAST(0.02 AS DOUBLE)) AS INT) AS p FROM h) SELECT doc_id, x - p AS x, y - p AS y, w + 2 * p AS w, h + 2 * p AS h FROM p")
def a04_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes around pages, grown by a share."""
    return spatial.padded_envelope(boxes(spark, sf_dir), "doc_id")


@query("WITH e AS (SELECT p_partkey AS entry_ord, unnest([p_name, ' ' || upper(p_name), p_type, '', lower(p_type) || ' ', 'x' || p_type]) AS name, unnest(range(6)) AS r FROM part), t AS (SELECT entry_ord, trim(name) AS name, r FROM e WHERE trim(name) <> '') SELECT entry_ord, CAST(r AS INT) AS name_rank, name FROM (SELECT *, row_number() OVER (PARTITION BY entry_ord, lower(name) ORDER BY r) AS n FROM t) WHERE n = 1")
def a16_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and aliases of an entry, each once whatever its case, in order."""
    aliases = F.array(F.concat(F.lit(" "), F.upper("p_name")), F.col("p_type"), F.lit(""), F.concat(F.lower("p_type"), F.lit(" ")), F.concat(F.lit("x"), "p_type"))
    catalog = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_ord"), F.col("p_partkey").cast("long").alias("entry_id"), F.col("p_name").alias("name"), aliases.alias("aliases"))
    return matching.catalog_names(catalog, False).select("entry_ord", "name_rank", "name")


@query("SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS raw_text FROM (SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_partkey AS ord, 'p' || l_partkey AS text FROM lineitem WHERE l_partkey % 4 <> 0) GROUP BY doc_id")
def a08_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a page, one for each line, blank ones left out; those of one ord in the order of the table's rows."""
    shown = F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(" ")
    ord_ = (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord")
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "row_index")]
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ord_, shown.alias("text"), *place)
    return headers.raw_text(rows, "file_path", "row_index")


@query(f"WITH {_BOXES}, r AS (SELECT doc_id, CASE l_partkey % 5 WHEN 0 THEN 'label' WHEN 1 THEN 'column_header' WHEN 2 THEN role ELSE 'unknown' END AS role FROM boxes) SELECT doc_id, bool_or(role <> 'unknown') AS has_roles, count(*) FILTER (role NOT IN ('label', 'column_header')) AS readable FROM r GROUP BY doc_id")
def a19_has_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page has any role, and how many of its cells are read."""
    k = F.col("l_partkey") % 5
    rows = boxes(spark, sf_dir).withColumn("role", F.when(k == 0, "label").when(k == 1, "column_header").when(k == 2, F.col("role")).otherwise("unknown"))
    read = headers.readable(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("readable"))
    return headers.has_roles(rows).join(read, "doc_id", "left").withColumn("readable", F.coalesce("readable", F.lit(0)).cast("long"))


@query(
    f"WITH {_NAMES}, q AS (SELECT name AS text, string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1] || CASE WHEN ord % 2 = 0 THEN ' extra' ELSE '' END AS probe FROM names WHERE contains(name, ' ')), "
    "w AS (SELECT q.probe, n.name, n.ord, unnest(string_split(q.probe, ' ')) AS pw, unnest(range(len(string_split(q.probe, ' ')))) AS i, len(string_split(q.probe, ' ')) AS np, len(string_split(n.name, ' ')) AS nn FROM q, names n), "
    "b AS (SELECT probe, name, ord, np, nn, i, max(CASE WHEN pw = ew THEN 1.0 ELSE (greatest(length(pw), length(ew)) - levenshtein(pw, ew)) / greatest(length(pw), length(ew)) END) AS best FROM w, (SELECT DISTINCT name AS en, unnest(string_split(name, ' ')) AS ew FROM names) WHERE en = name GROUP BY probe, name, ord, np, nn, i), "
    "s AS (SELECT probe, name, ord, round(100 * (sum(best) / max(greatest(np, nn))), 2) AS score FROM b GROUP BY probe, name, ord), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, ord) AS r FROM s) "
    "SELECT probe AS text, CASE WHEN score >= 75 THEN name ELSE probe END AS corrected, score / 100 AS confidence FROM r WHERE r = 1"
)
def j08_keywords_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put right by the keyword that has the same words in any order."""
    names = _names(spark, sf_dir)
    turned = F.concat_ws(" ", F.reverse(F.split("name", " ")))
    probes = names.where(F.contains("name", F.lit(" "))).select(F.concat(turned, F.when(F.col("ord") % 2 == 0, " extra").otherwise("")).alias("text"))
    return matching.correct_keywords(probes, names.select("ord", F.col("name").alias("keyword")), "order_independent", unicode=False)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN string_split(p_name, ' ')[1] || ' new' WHEN 1 THEN p_name ELSE NULL END AS value FROM part")
def w10_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words after a label up to the next stop word, else those before it."""
    name, k = F.split("p_name", " "), F.pmod("p_partkey", F.lit(3))
    words = F.when(k == 0, F.concat(F.array(F.lit("city"), F.get(name, F.lit(0)), F.lit("new"), F.lit("date")), name)).when(k == 1, F.concat(F.array(F.lit("date")), name, F.array(F.lit("city"), F.lit("no")))).otherwise(name)
    return load(spark, sf_dir, "part").select("p_partkey", text.take_while(words, F.lit("city"), ["date", "no"]).alias("value"))


@query(f"WITH {_BOXES} SELECT doc_id, box_id, least(3, CAST(floor((x + l_partkey % 150 - 100) / 700 * 4) AS INT)) AS bucket FROM boxes")
def w13_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by their place among four equal parts."""
    fraction = (F.col("x") + F.pmod("l_partkey", F.lit(150)) - 100) / 700
    return boxes(spark, sf_dir).select("doc_id", "box_id", layout.bucket(fraction, 4).alias("bucket"))


@query(f"WITH {_BOXES} SELECT doc_id, box_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y / 20, 0), x DESC, box_id) - 1 AS INT) AS place FROM boxes")
def w16_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page in reading order."""
    return forms.reading_order(boxes(spark, sf_dir).withColumn("ord", F.col("box_id"))).select("doc_id", "box_id", "place")


@query("SELECT l_partkey, round(2 * l_partkey + 1 + 3, 6) AS x, round(0.5 * (l_partkey % 9) - 2, 6) AS y, round(l_partkey, 6) AS back_x, round(l_partkey % 9, 6) AS back_y FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def f52_homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points through the product of two matrices, and back through its inverse."""
    nine = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    both = geometry.matrix_product(nine(1, 0, 3, 0, 1, -2, 0, 0, 1), nine(2, 0, 1, 0, 0.5, 0, 0, 0, 1))
    points = load(spark, sf_dir, "lineitem").select("l_partkey").distinct().withColumn("m", both)
    there = points.withColumn("p", geometry.apply_matrix(F.col("m"), F.col("l_partkey").cast("double"), (F.col("l_partkey") % 9).cast("double")))
    back = there.withColumn("b", geometry.apply_matrix(geometry.matrix_inverse(F.col("m")), F.col("p.x"), F.col("p.y")))
    return back.select("l_partkey", *[F.round(c, 6).alias(n) for c, n in (("p.x", "x"), ("p.y", "y"), ("b.x", "back_x"), ("b.y", "back_y"))])


@query("SELECT DISTINCT l_partkey % 1000 AS side, CAST(ceil(least(l_partkey % 1000, 768) / 64) * 64 AS INT) AS fitted, 't' || (l_partkey % 3) || ':r' || (l_partkey % 1000) || 'c' || (l_partkey % 7) AS region_id FROM lineitem")
def f57_fitted_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sides cut to a cap and rounded up; names of regions."""
    part = F.col("l_partkey")
    rows = load(spark, sf_dir, "lineitem").select((part % 1000).alias("side"), geometry.fit_size(part % 1000).alias("fitted"), cells.region_id(F.concat(F.lit("t"), (part % 3).cast("string")), part % 1000, part % 7).alias("region_id"))
    return rows.distinct()


# A form holds up to eight lines of an order; what is left goes on the next one.
_FORM = """lines AS (SELECT l_orderkey * 10 + (rk - 1) // 8 AS doc_id, (rk - 1) % 8 + 1 AS rk FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem)),
  runs AS (SELECT doc_id, max(rk) AS n FROM lines GROUP BY doc_id)"""


@query(
    f"""WITH {_FORM}, r AS (SELECT doc_id, n, unnest(range(0, n + 1)) AS row FROM runs),
    t AS (SELECT doc_id, n, row, c, CASE WHEN row = 0 THEN 'column_header' ELSE ['notes', 'line_total', 'unit_price', 'quantity', 'product_name', 'line_number'][c + 1] END AS role FROM r, range(6) u(c)),
    f AS (SELECT doc_id, n, c, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN c >= 5 THEN NULL ELSE ['label', 'total_in_words', 'label', 'total_in_figures', 'total_amount'][c + 1] END ELSE CASE WHEN c >= 3 THEN NULL ELSE ['label', 'label', 'total_amount'][c + 1] END END AS role FROM runs, range(5) u(c))
    SELECT doc_id, CAST(100 + row * 6 + c AS BIGINT) AS cell_id, 'table' AS zone, role FROM t
    UNION ALL SELECT doc_id, CAST(90000 + c AS BIGINT), CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'footer' END, role FROM f WHERE role IS NOT NULL
    UNION ALL SELECT doc_id, CAST(c AS BIGINT), 'header', ['invoice_number', 'unknown', 'city', 'invoice_date', 'merchant_name'][c + 1] FROM runs, range(5) u(c)"""
)
def r20_form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the cells of forms: two header rows, a table with as many rows as an order has lines, totals inside or below it."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines_of = load(spark, sf_dir, "lineitem")
    rows = dealt(lines_of.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lines_of, "l_orderkey").select("l_orderkey", (rank - 1).alias("at"))
    rows = dealt(rows.select((F.col("l_orderkey") * 10 + F.floor(F.col("at") / 8)).alias("doc_id"), (F.col("at") % 8 + 1).alias("rk")), lines_of, "doc_id")
    runs = rows.groupBy("doc_id").agg(F.max("rk").alias("n"))
    doc = F.col("doc_id")
    shake = lambda *v: F.pmod(sum(v, doc), F.lit(7)).cast("int") - 3
    many = F.when(doc % 3 == 0, 5).otherwise(3)
    gap = F.when(doc % 2 == 0, 0).otherwise(60)
    # cells of a form by number: those of the table, of the totals, and of the header rows
    n, k = F.col("n"), F.col("k")
    grid = (6 * (n + 1)).cast("int")
    numbered = runs.select("doc_id", "n", grid.alias("grid"), many.alias("many"), F.explode(F.sequence(F.lit(0), grid + many + 4)).alias("k"))
    inside, foot = k < F.col("grid"), k < F.col("grid") + F.col("many")
    row = F.floor(k / 6)
    c = F.when(inside, k % 6).when(foot, k - F.col("grid")).otherwise(k - F.col("grid") - F.col("many"))
    placed = numbered.select("doc_id", "n", inside.alias("inside"), foot.alias("foot"), row.alias("row"), c.alias("c"))
    inside, foot, row, c = (F.col(name) for name in ("inside", "foot", "row", "c"))
    # three cells: their places 0, 1/6 and 1 of the width fall into the buckets 0, 0 and 4 of five
    at = F.when(doc % 3 == 0, c * 150).otherwise(F.when(c == 2, 600).otherwise(c * 100))
    x = F.when(inside, 50 + c * 150 + shake(row, c)).when(foot, 50 + at).when(c == 0, 60).when(c == 1, 700).otherwise(100 + (c - 2) * 250)
    y = F.when(inside, 300 + row * 40 + shake(c)).when(foot, 300 + (n + 1) * 40 + gap).when(c < 2, 100).otherwise(180)
    cell_id = F.when(inside, 100 + row * 6 + c).when(foot, 90000 + c).otherwise(c).cast("long")
    cells_of = placed.select("doc_id", cell_id.alias("cell_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(100).alias("w"), F.lit(30).alias("h"))
    tables = runs.select("doc_id", F.lit(295).alias("top"), (300 + F.col("n") * 40 + F.when(doc % 2 == 0, 80).otherwise(40)).cast("int").alias("bottom"))
    return forms.label_form(cells_of, tables)


_KINDS = [(0.0, 0.3, "number"), (0.3, 0.55, "date"), (0.55, 1.0, "arabic_text")]


@query(
    f"""WITH {_BOXES}, b AS (SELECT doc_id, box_id, x + l_partkey % 90 - 60 AS x, y + 200 AS y, 80 + l_partkey % 400 AS w, h FROM boxes),
    c AS (SELECT *, CASE WHEN y + h / 2 >= 0.2 * 1200 AND y + h / 2 <= 0.8 * 1200 THEN list_filter([300, 550], lambda e: e > x + 45 AND e < x + w - 45) ELSE CAST([] AS INT[]) END AS cuts FROM b),
    p AS (SELECT *, unnest(range(len(cuts) + 1)) AS i FROM c WHERE len(cuts) > 0),
    s AS (SELECT *, CASE WHEN i > 0 THEN cuts[i] ELSE x END AS a, CASE WHEN i < len(cuts) THEN cuts[i + 1] ELSE x + w END AS e FROM p),
    t AS (SELECT *, CASE WHEN i > 0 THEN a + 10 ELSE a END AS l, CASE WHEN i < len(cuts) THEN e - 10 ELSE e END AS r FROM s),
    k AS (SELECT doc_id, box_id, i, l, r FROM t WHERE e - a >= 45 AND r - l >= 45)
    SELECT doc_id, box_id, CAST(row_number() OVER (PARTITION BY doc_id, box_id ORDER BY i) - 1 AS INT) AS part, CAST(l AS INT) AS x, CAST(r - l AS INT) AS w FROM k
    UNION ALL SELECT c.doc_id, c.box_id, 0, CAST(x AS INT), CAST(w AS INT) FROM c LEFT JOIN (SELECT doc_id, box_id, count(*) AS n FROM k GROUP BY ALL) g ON g.doc_id = c.doc_id AND g.box_id = c.box_id WHERE n IS NULL"""
)
def i19_split_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide boxes cut at the boundaries of columns."""
    wide = boxes(spark, sf_dir).select("doc_id", "box_id", (F.col("x") + F.pmod("l_partkey", F.lit(90)) - 60).cast("int").alias("x"), (F.col("y") + 200).alias("y"), (80 + F.pmod("l_partkey", F.lit(400))).cast("int").alias("w"), "h", F.lit(1000).alias("page_w"), F.lit(1200).alias("page_h"))
    return forms.split_at_columns(wide, _KINDS).select("doc_id", "box_id", "part", "x", "w")


@query(
    f"""WITH {_BOXES}, b AS (SELECT doc_id, row, y, x + w / 2 AS m FROM boxes WHERE (l_partkey + box_id) % 3 <> 0),
    r AS (SELECT doc_id, row, min(y) AS y, max(y) + 20 - min(y) AS h, list(m) AS ms FROM b GROUP BY doc_id, row HAVING count(*) >= 2),
    k AS (SELECT r.*, a, e, kind FROM r, (VALUES (0, 300, 'number'), (300, 550, 'date'), (550, 1000, 'arabic_text')) v(a, e, kind))
    SELECT doc_id, a + 10 AS x, y, e - a - 20 AS w, h, kind FROM k WHERE len(list_filter(ms, lambda m: m > a AND m < e)) = 0"""
)
def u01_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made up for columns that a printed row left empty."""
    some = boxes(spark, sf_dir).where((F.col("l_partkey") + F.col("box_id")) % 3 != 0).withColumn("page_w", F.lit(1000))
    return forms.missing_cells(some, _KINDS)


@query(f"WITH {_BOXES}, b AS (SELECT doc_id, row, box_id, x + (l_partkey * box_id) % 300 AS x, w FROM boxes) SELECT doc_id, box_id FROM b WHERE EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.row = b.row AND o.box_id <> b.box_id AND least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x) >= 0.5 * least(b.w, o.w))")
def j13_stacked_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that lie above another one of their cluster."""
    blobs = boxes(spark, sf_dir).select("doc_id", F.col("row").alias("cluster"), "box_id", (F.col("x") + (F.col("l_partkey") * F.col("box_id")) % 300).alias("x"), "w")
    return spatial.stacked_overlap(blobs).select("doc_id", "box_id")


@query(f"WITH {_BOXES}, r AS (SELECT doc_id, x + l_partkey % 120 AS x, y - 10 AS y FROM boxes WHERE role = 'quantity') SELECT doc_id, box_id FROM boxes b WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND b.x < r.x + 2 AND r.x < b.x + b.w AND b.y < r.y + 60 AND r.y < b.y + b.h)")
def j18_crossed_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that a vertical rule crosses."""
    b = boxes(spark, sf_dir)
    rules = b.where("role = 'quantity'").select("doc_id", (F.col("x") + F.col("l_partkey") % 120).alias("x"), (F.col("y") - 10).alias("y"), F.lit(2).alias("w"), F.lit(60).alias("h"))
    return spatial.crossing_rules(b, rules).select("doc_id", "box_id")


@query(
    """WITH s AS (SELECT DISTINCT 100 + l_partkey % 400 AS w, 80 + l_partkey % 300 AS h, CAST(l_partkey % 91 - 45 AS DOUBLE) AS a FROM lineitem),
    c AS (SELECT *, cos(radians(a)) AS c, sin(radians(a)) AS s, w // 2 AS cx, h // 2 AS cy FROM s),
    n AS (SELECT *, CAST(floor(h * abs(s) + w * abs(c)) AS INT) AS nw, CAST(floor(h * abs(c) + w * abs(s)) AS INT) AS nh FROM c)
    SELECT w, h, a, nw, nh, round((1 - c) * cx - s * cy + nw / 2 - cx, 6) AS tx, round(s * cx + (1 - c) * cy + nh / 2 - cy, 6) AS ty FROM n"""
)
def f55_rotated_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sizes and shifts of turned pages."""
    part = F.col("l_partkey")
    rows = load(spark, sf_dir, "lineitem").select((100 + part % 400).alias("w"), (80 + part % 300).alias("h"), (part % 91 - 45).cast("double").alias("a")).distinct()
    turned = rows.withColumn("r", geometry.rotated_canvas(F.col("w"), F.col("h"), F.col("a")))
    at = lambda i: F.round(F.get("r.matrix", F.lit(i)), 6)
    return turned.select("w", "h", "a", F.col("r.w").alias("nw"), F.col("r.h").alias("nh"), at(2).alias("tx"), at(5).alias("ty"))


@query(
    """WITH p AS (SELECT DISTINCT l_partkey, l_partkey % 17 AS j FROM lineitem)
    SELECT l_partkey, CAST(10 + j AS VARCHAR) || ' ' || (12 + j) || ' ' || (200 - j) || ' ' || (14 - j) || ' ' || (210 + j) || ' ' || 190 || ' ' || 8 || ' ' || (180 + j) AS corners FROM p"""
)
def f56_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corners of pages, dealt in any order, in theirs."""
    j, k = F.col("l_partkey") % 17, F.col("l_partkey") % 4
    point = lambda x, y: F.struct(F.lit(x).cast("int").alias("x") if isinstance(x, int) else x.cast("int").alias("x"), F.lit(y).cast("int").alias("y") if isinstance(y, int) else y.cast("int").alias("y"))
    four = F.array(point(10 + j, 12 + j), point(200 - j, 14 - j), point(210 + j, 190), point(8, 180 + j))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(four, F.pmod(i * 3 + k.cast("int"), F.lit(4))))
    rows = load(spark, sf_dir, "lineitem").select("l_partkey").distinct().withColumn("p", geometry.ordered_corners(dealt))
    shown = F.array_join(F.transform("p", lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), " ")
    return rows.select("l_partkey", shown.alias("corners"))


@query("SELECT l_suppkey % 10 AS batch, count(*) FILTER (l_partkey % 7 <> 0) AS done, count(*) FILTER (l_partkey % 7 = 0) AS failed, min(l_partkey) FILTER (l_partkey % 3 <> 0) * 0.5 AS least_ink, CAST(max(l_partkey) FILTER (l_partkey % 3 = 0) AS DOUBLE) AS most_paper FROM lineitem GROUP BY ALL")
def a21_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink thresholds from crops with and without text, and how many pages of a batch were done."""
    part = F.col("l_partkey")
    crops = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("batch"), part.cast("double").alias("ratio"), F.when(part % 3 != 0, "x").otherwise(" ").alias("text"), (part % 7 == 0).alias("failed"))
    return crops.groupBy("batch").agg(F.count_if(~F.col("failed")).alias("done"), F.count_if("failed").alias("failed"), *cells.ink_thresholds())


_DIGITS_OF = "regexp_replace(regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', ''), '[^0-9]', '', 'g')"
_POOL_OF = "list_distinct(list_filter([CAST({d} AS DOUBLE), CASE WHEN length({d}) > 1 THEN CAST({d} AS DOUBLE) / 10 END, CASE WHEN length({d}) > 2 THEN CAST({d} AS DOUBLE) / 100 END], lambda v: v IS NOT NULL))"
_EXPLAINED = "list_filter(list_distinct({options}), lambda v: levenshtein(" + _DIGITS_OF + ", {read}) / greatest(length(" + _DIGITS_OF + "), length({read})) <= 0.5)"


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(1 + l_partkey % 9 AS VARCHAR) AS p, CAST((1 + l_partkey % 9) * CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole, l_suppkey % 3 AS k FROM lineitem),
    c AS (SELECT *, CASE WHEN k = 0 THEN whole ELSE CAST((CAST(whole[1] AS INT) + 3) % 9 + 1 AS VARCHAR) || substr(whole, 2) END AS t FROM r),
    n AS (SELECT *, CAST(q AS DOUBLE) AS qv, CAST(p AS DOUBLE) AS pv, CAST(t AS DOUBLE) AS tv, {_POOL_OF.format(d="p")} AS pp, {_POOL_OF.format(d="t")} AS tp FROM c),
    m AS (SELECT *, abs(qv * pv - tv) <= 0.02 AS fine, len(list_filter(flatten(list_transform(pp, lambda a: list_transform(tp, lambda b: abs(a * qv - b)))), lambda x: x <= 0.02)) AS combos,
      CASE WHEN length(p) >= length(q) AND length(p) >= length(t) THEN 'p' WHEN length(q) >= length(t) THEN 'q' ELSE 't' END AS suspect FROM n),
    o AS (SELECT *, CASE suspect WHEN 'p' THEN {_EXPLAINED.format(options="list_transform(tp, lambda b: round(b / qv, 2))", read="p")} WHEN 'q' THEN {_EXPLAINED.format(options="flatten(list_transform(tp, lambda b: list_transform(pp, lambda a: round(b / a, 2))))", read="q")}
      ELSE {_EXPLAINED.format(options="list_transform(pp, lambda a: round(a * qv, 2))", read="t")} END AS options FROM m),
    s AS (SELECT *, NOT fine AND combos = 0 AND len(options) = 1 AS repaired FROM o)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN repaired THEN 'repaired' WHEN fine THEN 'ok' WHEN combos > 0 THEN 'more' ELSE 'open' END AS outcome,
      CASE WHEN repaired AND suspect = 'p' THEN options[1] ELSE pv END AS unit_price, CASE WHEN repaired AND suspect = 'q' THEN round(options[1]) ELSE qv END AS quantity, CASE WHEN repaired AND suspect = 't' THEN options[1] ELSE tv END AS total_price
    FROM s WHERE fine OR combos = 0"""
)
def r12_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole amounts with a misread digit, where no reading fits: the least trusted cell is derived anew if the others leave one value."""
    from ..operators.reconcile import reconcile

    line = load(spark, sf_dir, "lineitem")
    price, count = 1 + F.col("l_partkey") % 9, F.col("l_quantity").cast("bigint")
    whole = (price * count).cast("string")
    misread = F.concat(((F.substring(whole, 1, 1).cast("int") + 3) % 9 + 1).cast("string"), F.substring(whole, 2, 99))
    total = F.when(F.col("l_suppkey") % 3 == 0, whole).otherwise(misread)
    shown = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.cast("string").alias("unit_price_raw"), count.cast("string").alias("quantity_raw"), total.alias("total_price_raw"))
    read = shown.withColumns({c: F.col(f"{c}_raw").cast("double") for c in ("unit_price", "quantity", "total_price")})
    done = reconcile(read)
    return done.where("outcome in ('ok', 'repaired', 'open') and (outcome != 'open' or not arithmetic_ok)").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "outcome", "unit_price", "quantity", "total_price")


_GRID = """g AS (SELECT l_orderkey * 10 + (rk - 1) // 8 AS doc_id, (rk - 1) % 8 AS r, l_partkey AS p FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem)),
  w AS (SELECT doc_id, r, p, c, CASE c WHEN 0 THEN true WHEN 1 THEN p % 3 <> 0 ELSE p % 4 <> 0 END AS wall, CASE c WHEN 0 THEN p % 5 <> 0 WHEN 1 THEN p % 2 <> 0 ELSE true END AS above FROM g, range(3) t(c)),
  i AS (SELECT *, sum(CAST(wall AS INT)) OVER (PARTITION BY doc_id, r ORDER BY c) AS cell FROM w),
  k AS (SELECT doc_id, r, min(c) AS c1, max(c) AS c2, sum(CAST(above AS INT)) >= 0.5 * count(*) AS above FROM i GROUP BY doc_id, r, cell),
  d AS (SELECT *, CASE WHEN above OR lag(r) OVER (PARTITION BY doc_id, c1, c2 ORDER BY r) IS DISTINCT FROM r - 1 THEN 1 ELSE 0 END AS s FROM k),
  e AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, c1, c2 ORDER BY r) AS span FROM d)"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and ink of ruled pages, a row of three columns for each line of an order; some walls and floors aren't drawn, or not all of them."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    table = load(spark, sf_dir, "lineitem")
    rows = dealt(table.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), table, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("p"), rank.alias("at"))
    rows = dealt(rows.select((F.col("l_orderkey") * 10 + F.floor(F.col("at") / 8)).alias("doc_id"), (F.col("at") % 8).alias("r"), "p"), table, "doc_id")
    y, p = 100 + F.col("r") * 50, F.col("p")
    cast = lambda v, name: (v if isinstance(v, Column) else F.lit(v)).cast("int").alias(name)
    box = lambda axis, x, top, w, h: F.struct(F.lit(axis).alias("axis"), cast(x, "x"), cast(top, "y"), cast(w, "w"), cast(h, "h"))
    drawn = F.array(
        F.when(p % 3 != 0, box("v", 199, y, 3, 50)), F.when(p % 3 == 0, box("v", 200, y + 3, 2, 20)),
        F.when(p % 4 != 0, box("v", 300 + p % 3, y + 5, 2, 20)), F.when(p % 4 != 0, box("v", 301, y + 15, 2, 30)),
        F.when(p % 5 != 0, box("h", 100, y - 1, 100, 3)), F.when(p % 2 != 0, box("h", 200, y, 100, 2)), box("h", 300, y, 101, 2),
    )
    ink = rows.select("doc_id", F.explode(drawn).alias("b")).where("b is not null").select("doc_id", "b.*")
    across = rows.select("doc_id", F.lit("h").alias("axis"), F.explode(F.array(y, y + 50)).alias("pos")).distinct()
    down = rows.select("doc_id").distinct().select("doc_id", F.lit("v").alias("axis"), F.explode(F.array(*[F.lit(x) for x in (100, 200, 300, 400)])).alias("pos"))
    return across.withColumn("pos", F.col("pos").cast("int")).unionByName(down), ink


@query(f"WITH {_GRID} SELECT doc_id, CAST(min(r) AS INT) AS row, CAST(c1 AS INT) AS col, CAST(count(*) AS INT) AS row_span, CAST(c2 - c1 + 1 AS INT) AS col_span, 100 + 100 * c1 AS x, 100 + 50 * min(r) AS y, 100 * (c2 - c1 + 1) AS w, 50 * count(*) AS h FROM e GROUP BY doc_id, c1, c2, span")
def i17_span_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of ruled pages; what no ink separates is one cell, across and down."""
    return grids.cells_of(*_grid(spark, sf_dir))


@query(
    f"""WITH {_BOXES}, p AS (SELECT doc_id, box_id, row, l_partkey AS p, x, y FROM boxes WHERE role = 'quantity'),
    f AS (SELECT *, p % 3 <> 2 AND p % 7 <> 0 AS writing FROM p)
    SELECT doc_id, box_id * 2 AS box_id FROM f WHERE NOT writing OR p % 4 = 0 UNION ALL SELECT doc_id, box_id * 2 + 1 FROM f WHERE NOT writing"""
)
def i13_stacked_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that aren't lines of writing: pairs of blobs of like or unlike length, side by side or not, some crossed by a rule."""
    b = boxes(spark, sf_dir).where("role = 'quantity'").withColumn("p", F.col("l_partkey"))
    beside = F.when(F.col("p") % 7 == 0, F.when(F.col("p") % 3 == 2, 0).otherwise(75)).otherwise(0)
    blob = lambda k, x, y, w: F.struct((F.col("box_id") * 2 + k).alias("box_id"), x.cast("int").alias("x"), y.alias("y"), w.cast("int").alias("w"), F.lit(6).alias("h"))
    pair = F.array(blob(0, F.col("x"), F.col("y"), F.lit(80)), blob(1, F.col("x") + beside, F.col("y") + 15, 80 + F.col("p") % 3 * 60))
    blobs = b.select("doc_id", F.inline(pair))
    rules = b.where("p % 4 = 0").select("doc_id", (F.col("x") + 10).alias("x"), (F.col("y") + 2).alias("y"), F.lit(2).alias("w"), F.lit(2).alias("h"))
    return grids.without_stacked_text(blobs, rules).select("doc_id", "box_id")


@query(
    f"""WITH {_BOXES}, l AS (SELECT doc_id, CASE WHEN row % 2 = 0 THEN 'h' ELSE 'v' END AS axis, row AS line_id, CAST(row * 30 AS INT) AS pos, CAST(l_partkey % 50 AS INT) AS lo, CAST(100 + l_partkey % 50 + (l_partkey % 7) * 30 AS INT) AS hi FROM boxes WHERE role = 'quantity'),
    e AS (SELECT doc_id, count(DISTINCT axis) AS axes, min(CASE WHEN axis = 'h' THEN lo ELSE pos END) AS x1, max(CASE WHEN axis = 'h' THEN hi ELSE pos END) AS x2, min(CASE WHEN axis = 'h' THEN pos ELSE lo END) AS y1, max(CASE WHEN axis = 'h' THEN pos ELSE hi END) AS y2 FROM l GROUP BY doc_id)
    SELECT l.doc_id, axis, line_id, pos, CASE WHEN axes < 2 THEN lo WHEN axis = 'h' THEN x1 ELSE y1 END AS lo, CASE WHEN axes < 2 THEN hi WHEN axis = 'h' THEN x2 ELSE y2 END AS hi FROM l JOIN e ON l.doc_id = e.doc_id
    WHERE axes < 2 OR hi - lo >= 0.5 * greatest(1, CASE WHEN axis = 'h' THEN x2 - x1 ELSE y2 - y1 END)"""
)
def i15_extended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines drawn out to the bounds of their table, short ones dropped."""
    p = F.col("l_partkey")
    b = boxes(spark, sf_dir).where("role = 'quantity'")
    made = b.select("doc_id", F.when(F.col("row") % 2 == 0, "h").otherwise("v").alias("axis"), F.col("row").alias("line_id"), (F.col("row") * 30).cast("int").alias("pos"), (p % 50).cast("int").alias("lo"), (100 + p % 50 + p % 7 * 30).cast("int").alias("hi"))
    return grids.extended(made)


@query(
    f"""WITH {_BOXES}, b AS (SELECT doc_id, box_id, row, x, y, CAST(20 + l_partkey % 60 AS INT) AS w FROM boxes),
    s AS (SELECT doc_id, box_id, y + 1 AS pos, x AS lo, x + w AS hi FROM b WHERE w >= 40),
    o AS (SELECT *, sum(g) OVER (PARTITION BY doc_id ORDER BY pos, box_id) AS c FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos, box_id) > 10 THEN 1 ELSE 0 END AS g FROM s))
    SELECT doc_id, CAST(floor(avg(pos)) AS INT) AS pos, min(lo) AS lo, max(hi) AS hi FROM o GROUP BY doc_id, c"""
)
def i12_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from blobs, short ones left out, near ones one."""
    blobs = boxes(spark, sf_dir).select("doc_id", F.lit("h").alias("axis"), "box_id", "x", "y", (20 + F.pmod("l_partkey", F.lit(60))).cast("int").alias("w"), F.lit(2).alias("h"))
    return grids.rule_lines(blobs).select("doc_id", "pos", "lo", "hi")


#: MB of the files of supplier in one part: some 1,500 drawn pages. Such a page costs much more than its bytes say.
DRAWN_MB = 0.03


def _inked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes of ink for each supplier's page, of 160 x 100 pixels."""
    table = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    shapes = F.array(*[F.struct((5 + k % 40 + 3 * i).cast("int").alias("x"), (5 + k % 9 + 30 * i).cast("int").alias("y"), (10 + k % 60 + 5 * i).cast("int").alias("w"), (4 + k % 15).cast("int").alias("h")) for i in range(3)])
    return dealt(table.select("s_suppkey"), table, "s_suppkey", part_mb=DRAWN_MB).select(k.alias("doc_id"), F.inline(shapes))


@query("SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS box_id, CAST(5 + s_suppkey % 40 + 3 * i AS INT) AS x, CAST(5 + s_suppkey % 9 + 30 * i AS INT) AS y, CAST(10 + s_suppkey % 60 + 5 * i AS INT) AS w, CAST(4 + s_suppkey % 15 AS INT) AS h, NULL AS error FROM supplier, range(3) t(i)")
def i12_ink_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages drawn as PNG, read again, split into ink and paper, and boxed."""
    from ..operators import pages

    return pages.ink_boxes(pages.drawn(_inked(spark, sf_dir), 160, 100))


@query("SELECT CAST(s_suppkey AS BIGINT) AS doc_id, 230.0 AS paper, round(sum((10 + s_suppkey % 60 + 5 * i) * (4 + s_suppkey % 15)) / 16000, 9) AS ratio FROM supplier, range(3) t(i) GROUP BY s_suppkey")
def a22_ink_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of the paper and the share of ink of drawn pages."""
    from ..operators import pages

    return pages.ink_ratios(pages.drawn(_inked(spark, sf_dir), 160, 100)).withColumn("ratio", F.round("ratio", 9))


@query("SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CAST(2 AS INT) AS step, CAST(4 AS BIGINT) AS snapshots FROM supplier")
def w15_first_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of drawn pages before each of three steps and after them, and the first that is ink and paper alone."""
    from ..operators import pages

    steps = [("median", {"size": 3}), ("threshold", {}), ("morphology", {"how": "close"})]
    shots = pages.preprocessed(pages.drawn(_inked(spark, sf_dir), 160, 100), steps, snapshots=True)
    count = shots.groupBy("doc_id").agg(F.count(F.lit(1)).alias("snapshots"))
    return pages.first_binary(shots).join(count, "doc_id")
