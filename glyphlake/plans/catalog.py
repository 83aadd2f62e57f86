"""One query for each group of operators over the tables of a data folder, and DuckDB SQL for the same rows.

The tables hold no pages, so boxes and readings are made from lineitem by arithmetic, the same way in both.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, similarity, text
from ..functions.geometry import Box, center_distance, fold_angle, ioa, iou
from ..operators import aggregates, cluster, matching, parse, reconcile, spatial
from ..session import dealt, kept_in_place, load, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


# Readings of quantity, unit price and total, degraded by supplier.
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    shown = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    price = F.format_string("%.2f", "p_retailprice")
    total = F.format_string("%.2f", F.round(F.col("l_quantity") * F.col("p_retailprice"), 2))
    kind = F.pmod("l_suppkey", F.lit(5))
    comma = lambda c: F.translate(c, ".", ",")
    bare = lambda c: F.translate(c, ".", "")
    return shown.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        F.col("l_quantity").cast("bigint").cast("string").alias("quantity_raw"),
        F.when(kind == 2, bare(price)).when(kind == 4, comma(price)).otherwise(price).alias("unit_price_raw"),
        F.when(kind == 1, bare(total)).when(kind == 3, F.lit(None)).when(kind == 4, comma(total)).otherwise(total).alias("total_price_raw"),
    )


_READINGS = """
readings AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, q,
    CASE k WHEN 2 THEN replace(p, '.', '') WHEN 4 THEN replace(p, '.', ',') ELSE p END AS p,
    CASE k WHEN 1 THEN replace(t, '.', '') WHEN 3 THEN NULL WHEN 4 THEN replace(t, '.', ',') ELSE t END AS t
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_suppkey % 5 AS k,
      CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, printf('%.2f', p_retailprice) AS p,
      printf('%.2f', round(l_quantity * p_retailprice, 2)) AS t
    FROM lineitem JOIN part ON l_partkey = p_partkey))
"""

_RECONCILED = f"""
WITH {_READINGS},
cells AS (
  SELECT row_number() OVER () AS i, *, CAST(q AS DOUBLE) AS qv, CAST(replace(p, ',', '.') AS DOUBLE) AS pv, CAST(replace(t, ',', '.') AS DOUBLE) AS tv,
    regexp_replace(p, '[^0-9]', '', 'g') AS pd, coalesce(regexp_replace(t, '[^0-9]', '', 'g'), '') AS td,
    p LIKE '%.%' OR p LIKE '%,%' AS ps, coalesce(t LIKE '%.%' OR t LIKE '%,%', false) AS ts FROM readings),
open_rows AS (SELECT * FROM cells WHERE t IS NOT NULL AND NOT abs(qv * pv - tv) <= 0.02),
combos AS (
  SELECT i, cp, qv, ct,
    CASE WHEN ps THEN CASE WHEN abs(cp - CAST(pd AS DOUBLE) / 100) <= 1e-9 THEN 1 ELSE -1 END WHEN abs(cp - CAST(pd AS DOUBLE)) <= 0.02 THEN 1 ELSE 0 END
    + 1 + CASE WHEN ts THEN CASE WHEN abs(ct - CAST(td AS DOUBLE) / 100) <= 1e-9 THEN 1 ELSE -1 END WHEN abs(ct - CAST(td AS DOUBLE)) <= 0.02 THEN 1 ELSE 0 END AS score
  FROM (SELECT *, unnest([CAST(pd AS DOUBLE), CAST(pd AS DOUBLE) / 10, CAST(pd AS DOUBLE) / 100]) AS cp FROM open_rows),
    (SELECT i AS i2, unnest([CAST(td AS DOUBLE), CAST(td AS DOUBLE) / 10, CAST(td AS DOUBLE) / 100]) AS ct FROM open_rows)
  WHERE i = i2 AND abs(cp * qv - ct) <= 0.02),
ranked AS (SELECT *, count(*) OVER (PARTITION BY i) AS n, rank() OVER (PARTITION BY i ORDER BY score DESC) AS r FROM combos),
tops AS (SELECT *, count(*) OVER (PARTITION BY i) AS winners FROM ranked WHERE r = 1),
chosen AS (SELECT i, cp, qv AS cq FROM tops WHERE n = 1 OR (winners = 1 AND score > 0)),
done AS (
  SELECT c.*, CASE WHEN x.i IS NOT NULL THEN 'scaled' WHEN t IS NULL AND (ps) THEN 'derived' WHEN t IS NOT NULL AND abs(c.qv * pv - tv) <= 0.02 THEN 'ok' ELSE 'open' END AS outcome,
    CASE WHEN x.i IS NOT NULL THEN round(x.cp, 2) ELSE pv END AS price,
    CASE WHEN x.i IS NOT NULL THEN round(x.cp * x.cq, 2) WHEN t IS NULL THEN round(c.qv * pv, 2) ELSE tv END AS total
  FROM cells c LEFT JOIN chosen x ON c.i = x.i)
"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    read = rows.withColumns({c: numbers.strict(F.col(f"{c}_raw"), unicode=False) for c in reconcile.CELLS})
    return reconcile.reconcile(read)


@query(
    _RECONCILED
    + """SELECT l_returnflag, outcome, count(*) AS n, CAST(sum(CAST(abs(qv * price - total) <= 0.02 AS INT)) AS BIGINT) AS consistent,
    CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS price_cents, CAST(sum(CAST(round(total * 100) AS BIGINT)) AS BIGINT) AS total_cents
    FROM done GROUP BY l_returnflag, outcome"""
)
def r10_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded readings repaired; how many came out how, by return flag."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    return _reconciled(spark, sf_dir).groupBy("l_returnflag", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("arithmetic_ok").cast("int")).alias("consistent"), cents("unit_price").alias("price_cents"), cents("total_price").alias("total_cents")
    )


@query(
    f"""WITH {_READINGS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(q AS DOUBLE) * CAST(replace(p, ',', '.') AS DOUBLE), 2) AS total_price
    FROM readings WHERE t IS NULL"""
)
def r13_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that were not read, from the two settled cells."""
    return _reconciled(spark, sf_dir).where("outcome = 'derived'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total_price")


_SHOWN = """CASE o_orderkey % 4 WHEN 0 THEN printf('%.2f', o_totalprice)
    WHEN 1 THEN format('{:,.2f}', o_totalprice)
    WHEN 2 THEN translate(format('{:,.2f}', o_totalprice), ',.', '.,')
    ELSE 'SAR ' || printf('%.2f', o_totalprice) END"""


@query(
    f"""SELECT o_orderkey, round(o_totalprice, 2) AS price, round(o_totalprice, 2) AS strict,
    CAST(regexp_replace(s, '[^0-9]', '', 'g') AS BIGINT) AS quantity FROM (SELECT *, {_SHOWN} AS s FROM orders)"""
)
def f34_parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in four layouts."""
    amount, k = F.col("o_totalprice"), F.pmod("o_orderkey", F.lit(4))
    plain, grouped = F.format_string("%.2f", amount), F.format_number(amount, 2)
    shown = F.when(k == 0, plain).when(k == 1, grouped).when(k == 2, F.translate(grouped, ",.", ".,")).otherwise(F.concat(F.lit("SAR "), plain))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", shown.alias("s"))
    return rows.select("o_orderkey", numbers.price(F.col("s"), False).alias("price"), numbers.strict(F.col("s"), False).alias("strict"), numbers.quantity(F.col("s"), False).alias("quantity"))


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"""
)
def f41_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in four layouts that are all read back."""
    d, k = F.col("o_orderdate"), F.pmod("o_orderkey", F.lit(4))
    shown = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "dd / MM / yyyy"))
        .when(k == 2, F.concat(F.lit("dated "), F.date_format(d, "d.M.yyyy")))
        .otherwise(F.translate(F.date_format(d, "yyyy_MM_dd"), "0123456789", text.ARABIC_INDIC_DIGITS))
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(shown, unicode=False).alias("day"))


_NORM = "trim(lower(regexp_replace(regexp_replace({x}, '[.,;:!?(){{}}\\[\\]<>\"''`/\\\\|_+*=&^%#@~$-]', ' ', 'g'), '\\s+', ' ', 'g')))"


@query(f"SELECT p_partkey, {_NORM.format(x='p_name || chr(58) || p_type')} AS norm, len(string_split({_NORM.format(x='p_name || chr(58) || p_type')}, ' ')) AS n_words FROM part")
def f04_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04, F05 on part names and types."""
    norm = text.normalize_text(F.concat("p_name", F.lit(":"), "p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", norm.alias("norm")).withColumn("n_words", F.size(text.words(F.col("norm"))).cast("bigint"))


_NAMES = "names AS (SELECT lower(p_name) AS name, CAST(min(p_partkey) AS BIGINT) AS ord FROM part GROUP BY ALL)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names, each with the least key of its parts."""
    return load(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").cast("bigint").alias("ord"))


_PAIRS = """pairs AS (SELECT p_partkey, k, a, b FROM (SELECT p_partkey, lower(p_name) AS a, unnest([substr(lower(p_name), 1, 2) || substr(lower(p_name), 4), lower(p_type), string_split(lower(p_name), ' ')[2] || ' ' || string_split(lower(p_name), ' ')[1], lower(p_name) || ' ' || lower(p_type)]) AS b, unnest(range(4)) AS k FROM part))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name beside a misread one, its type, its words in another order, and more words."""
    name, kind = F.lower("p_name"), F.lower("p_type")
    words = F.split(name, " ")
    others = F.array(F.concat(F.substring(name, 1, 2), F.substring(name, 4, 2**31 - 1)), kind, F.concat(F.get(words, F.lit(1)), F.lit(" "), F.get(words, F.lit(0))), F.concat(name, F.lit(" "), kind))
    return load(spark, sf_dir, "part").select("p_partkey", name.alias("a"), F.posexplode(others).alias("k", "b"))


@query(f"WITH {_PAIRS} SELECT p_partkey, CAST(k AS INT) AS k, CASE WHEN a = b THEN 1.0 ELSE (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) END AS score FROM pairs")
def f21_lev_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F21 between part names and what they may be read as."""
    return _pairs(spark, sf_dir).select("p_partkey", "k", similarity.levenshtein_similarity(F.col("a"), F.col("b")).alias("score"))


_WORD = "CASE WHEN {p} = {e} THEN 1.0 ELSE (greatest(length({p}), length({e})) - levenshtein({p}, {e})) / greatest(length({p}), length({e})) END"
_PAIR_SCORES = f"""
SELECT a, b, sum(best) / max(greatest(na, nb)) AS score FROM (
  SELECT a, b, na, nb, i, max({_WORD.format(p="pw", e="ew")}) AS best FROM (
    SELECT a, b, len(pa) AS na, len(pb) AS nb, unnest(range(1, len(pa) + 1)) AS i, pa[i] AS pw, pb FROM pairs), (SELECT DISTINCT name AS bb, unnest(string_split(name, ' ')) AS ew FROM names)
  WHERE b = bb GROUP BY a, b, na, nb, i) GROUP BY a, b"""


@query(
    f"""WITH {_PAIRS}, w AS (SELECT p_partkey, k, len(string_split(a, ' ')) AS na, len(string_split(b, ' ')) AS nb, unnest(string_split(a, ' ')) AS pw, unnest(range(len(string_split(a, ' ')))) AS i, string_split(b, ' ') AS bs FROM pairs),
    e AS (SELECT p_partkey, k, na, nb, i, pw, unnest(bs) AS ew FROM w), m AS (SELECT p_partkey, k, na, nb, i, max({_WORD.format(p="pw", e="ew")}) AS best FROM e GROUP BY ALL)
    SELECT p_partkey, CAST(k AS INT) AS k, round(sum(best) / max(greatest(na, nb)), 6) AS score FROM m GROUP BY p_partkey, k"""
)
def f22_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22 between part names and what they may be read as, whatever the order of words."""
    score = similarity.word_set_similarity(F.split("a", " "), F.split("b", " "))
    return _pairs(spark, sf_dir).select("p_partkey", "k", F.round(score, 6).alias("score"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names without their third letter."""
    name = F.lower("p_name")
    return load(spark, sf_dir, "part").select(F.concat(F.substring(name, 1, 2), F.substring(name, 4, 2**31 - 1)).alias("probe"))


_PROBES = "probes AS (SELECT DISTINCT substr(lower(p_name), 1, 2) || substr(lower(p_name), 4) AS probe FROM part)"
_LEV = "round(100 * ((greatest(length(probe), length(name)) - levenshtein(probe, name)) / greatest(length(probe), length(name))), 2)"


@query(
    f"WITH {_NAMES}, {_PROBES}, s AS (SELECT probe, ord, name, {_LEV} AS score FROM probes, names) "
    "SELECT probe, CAST(rank AS INT) AS rank, ord AS entry_id, name AS entry_name, name AS matched_name, score FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, ord) AS rank FROM s) WHERE rank <= 5"
)
def j04_topk_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best catalog entries of each probe."""
    catalog = _names(spark, sf_dir).select(F.col("ord").alias("entry_ord"), F.col("ord").alias("entry_id"), "name", F.array().cast("array<string>").alias("aliases"))
    return matching.top_matches(_probes(spark, sf_dir), matching.catalog_names(catalog, False), "levenshtein", 5, False)


@query(
    f"WITH {_NAMES}, pairs AS (SELECT a, b, string_split(a, ' ') AS pa, string_split(b, ' ') AS pb FROM (SELECT string_split(x.name, ' ')[2] || ' ' || string_split(x.name, ' ')[1] AS a, y.name AS b FROM names x, names y)), s AS (SELECT a AS probe, b AS name, round(score * 100, 2) AS score FROM ({_PAIR_SCORES})) "
    "SELECT probe, CAST(rank AS INT) AS rank, ord AS entry_id, name AS entry_name, name AS matched_name, score FROM (SELECT s.probe, n.ord, s.name, s.score, row_number() OVER (PARTITION BY probe ORDER BY s.score DESC, n.ord) AS rank FROM s JOIN names n ON s.name = n.name) WHERE rank <= 3"
)
def j06_topk_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapped part names against the dictionary, whatever the order of words."""
    names = _names(spark, sf_dir)
    probes = names.select(F.concat_ws(" ", F.reverse(F.split("name", " "))).alias("probe"))
    catalog = names.select(F.col("ord").alias("entry_ord"), F.col("ord").alias("entry_id"), "name", F.array().cast("array<string>").alias("aliases"))
    return matching.top_matches(probes, matching.catalog_names(catalog, False), "order_independent", 3, False)


@query(
    f"WITH {_NAMES}, {_PROBES}, s AS (SELECT probe, ord, name, {_LEV} AS score FROM probes, names), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, ord) AS r FROM s) WHERE r = 1) "
    "SELECT probe AS text, CASE WHEN score / 100 >= greatest(0.0, (length(probe) - 2) / length(probe)) THEN name ELSE probe END AS corrected, score / 100 AS confidence FROM b"
)
def j07_keyword_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put right by the nearest keyword within two edits."""
    keywords = _names(spark, sf_dir).select("ord", F.col("name").alias("keyword"))
    return matching.correct_keywords(_probes(spark, sf_dir).select(F.col("probe").alias("text")), keywords, unicode=False)


# Boxes: one page for each order, one row of four cells for each line.
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    table = load(spark, sf_dir, "lineitem")
    rows = dealt(table.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), table, "l_orderkey").withColumn("rk", rank)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(x).alias("x"), F.lit(r).alias("role")) for i, (x, r) in enumerate(((100, "line_total"), (300, "unit_price"), (500, "quantity"), (700, "product_name")))])).alias("cell")
    return rows.select("*", cells).select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("rk") * 4 + F.col("cell.c")).cast("bigint").alias("box_id"),
        F.col("rk").alias("row"),
        F.col("cell.role").alias("role"),
        F.col("cell.x").alias("x"),
        (F.col("rk") * 60 + F.pmod("l_partkey", F.lit(7)) - 3).cast("int").alias("y"),
        F.lit(80).alias("w"),
        F.lit(20).alias("h"),
        (F.pmod("l_partkey", F.lit(10)) / 10).alias("confidence"),
        F.col("l_partkey"),
    )


_BOXES = """boxes AS (
  SELECT l_orderkey AS doc_id, rk * 4 + c AS box_id, CAST(rk AS INT) AS row, role, x, CAST(rk * 60 + l_partkey % 7 - 3 AS INT) AS y, 80 AS w, 20 AS h,
    (l_partkey % 10) / 10 AS confidence, l_partkey
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem),
    (VALUES (0, 100, 'line_total'), (1, 300, 'unit_price'), (2, 500, 'quantity'), (3, 700, 'product_name')) v(c, x, role))"""


@query(f"WITH {_BOXES} SELECT doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY doc_id")
def a03_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each page's boxes."""
    return spatial.hull(boxes(spark, sf_dir), "doc_id")


@query(f"WITH {_BOXES} SELECT doc_id, row, CASE WHEN count(*) FILTER (l_partkey % 5 <> 0) = 0 THEN 0.0 ELSE coalesce(avg(CASE WHEN confidence > 0 THEN confidence END) FILTER (l_partkey % 5 <> 0), 0.5) END AS confidence FROM boxes GROUP BY doc_id, row")
def a01_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of rows, some without a known one and some without a fragment."""
    b = boxes(spark, sf_dir).withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")))
    return aggregates.confidences(b, b.where(F.col("l_partkey") % 5 != 0), "doc_id", "row")


@query(f"WITH {_BOXES} SELECT doc_id, string_agg(role, ' ' ORDER BY x DESC, box_id) AS text, (SELECT string_agg(role, ' ' ORDER BY x, box_id) FROM boxes b WHERE b.doc_id = boxes.doc_id AND b.row = boxes.row) AS ltr_text, row FROM boxes GROUP BY doc_id, row")
def a06_ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a row from right to left and from left to right."""
    words = boxes(spark, sf_dir).select("doc_id", "row", "x", F.col("box_id").alias("ord"), F.col("role").alias("text"))
    return aggregates.both_orders(words, "doc_id", "row").select("doc_id", "row", "text", "ltr_text")


@query(f"WITH {_BOXES} SELECT doc_id, row, max(x) FILTER (role = 'line_total') AS total_x, max(x) FILTER (role = 'unit_price') AS price_x, max(x) FILTER (role = 'quantity') AS quantity_x, max(x) FILTER (role = 'product_name') AS name_x FROM boxes GROUP BY doc_id, row")
def a09_role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a row by role; the last of a role wins."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.struct("box_id", "x")))["x"]
    return boxes(spark, sf_dir).groupBy("doc_id", "row").agg(last("line_total").alias("total_x"), last("unit_price").alias("price_x"), last("quantity").alias("quantity_x"), last("product_name").alias("name_x"))


@query(
    f"""WITH {_BOXES}, shifted AS (SELECT doc_id, box_id, x + 5 AS x, y + 4 AS y, w, h FROM boxes),
    s AS (SELECT f.doc_id, f.box_id AS frag_id, r.box_id AS region_id, greatest(least(f.x + f.w, r.x + r.w) - greatest(f.x, r.x), 0) * greatest(least(f.y + f.h, r.y + r.h) - greatest(f.y, r.y), 0) AS o FROM shifted f JOIN boxes r ON f.doc_id = r.doc_id WHERE f.box_id % 2 = 0),
    t AS (SELECT doc_id, frag_id, region_id, 0.3 * (o / 1600) + 0.7 * (o / (3200 - o)) AS score FROM s WHERE o > 0)
    SELECT doc_id, frag_id, CAST(region_id AS VARCHAR) AS region_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, frag_id ORDER BY score DESC, region_id) AS n FROM t WHERE score >= 0.25) WHERE n = 1"""
)
def j02_spatial_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted boxes find their region again."""
    fragments, regions = _fragments(spark, sf_dir)
    return spatial.best_region(fragments, regions).select("doc_id", "frag_id", "region_id", F.round("score", 9).alias("score"))


def _fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes moved a little as fragments, those of odd ids with a source_id, some of it unknown; and boxes as regions."""
    b = boxes(spark, sf_dir)
    source = F.when(F.col("box_id") % 2 == 1, F.when(F.col("l_partkey") % 11 == 0, F.lit("ghost")).otherwise(F.col("box_id").cast("string")))
    fragments = b.select("doc_id", F.col("box_id").alias("frag_id"), F.col("role").alias("text"), (F.col("x") + 5).alias("x"), (F.col("y") + 4).alias("y"), "w", "h", source.alias("source_id"))
    regions = b.select("doc_id", F.col("box_id").cast("string").alias("region_id"), F.col("box_id").cast("int").alias("ord"), "x", "y", "w", "h")
    return fragments, regions


@query(f"WITH {_BOXES} SELECT doc_id, box_id AS frag_id, CASE WHEN l_partkey % 11 <> 0 THEN CAST(box_id AS VARCHAR) END AS region_id FROM boxes WHERE box_id % 2 = 1")
def j01_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that name their region."""
    return spatial.identity_join(*_fragments(spark, sf_dir))


@query(
    f"""WITH {_BOXES}, placed AS (SELECT doc_id, box_id, role, CASE WHEN box_id % 2 = 0 OR l_partkey % 11 <> 0 THEN box_id END AS region_id FROM boxes)
    SELECT b.doc_id, CAST(b.box_id AS VARCHAR) AS element_id, 'region' AS kind, CAST(b.box_id AS INT) AS ord, CAST(p.region_id IS NOT NULL AS BIGINT) AS n_fragments, CASE WHEN p.region_id IS NOT NULL THEN b.role ELSE '' END AS text
    FROM boxes b JOIN placed p ON b.doc_id = p.doc_id AND b.box_id = p.box_id
    UNION ALL SELECT doc_id, 'free:' || n, 'free', CAST(total + n AS INT), 1, role FROM (SELECT p.doc_id, p.role, row_number() OVER (PARTITION BY p.doc_id ORDER BY box_id) - 1 AS n, t.total FROM placed p JOIN (SELECT doc_id, count(*) AS total FROM boxes GROUP BY doc_id) t ON p.doc_id = t.doc_id WHERE region_id IS NULL)"""
)
def j03_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put together from regions and fragments."""
    # planned while it holds that boxes, dealt by page, are joined on further keys where they lie
    with kept_in_place(spark):
        return written(spatial.assemble(*_fragments(spark, sf_dir)))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, and around every row of three or more lines a larger one."""
    b = boxes(spark, sf_dir).select("doc_id", "box_id", "row", "x", "y", "w", "h")
    rows = b.where("row % 3 = 0").groupBy("doc_id", "row").agg(F.max("y").alias("y"))
    outer = rows.select("doc_id", (F.col("row") + 100000).cast("bigint").alias("box_id"), "row", F.lit(50).alias("x"), (F.col("y") - 5).cast("int").alias("y"), F.lit(400).alias("w"), F.lit(40).alias("h"))
    return b.unionByName(outer)


_NESTED = f"{_BOXES}, nested AS (SELECT doc_id, box_id, row, x, y, w, h FROM boxes UNION ALL SELECT doc_id, row + 100000, row, 50, max(y) - 5, 400, 40 FROM boxes WHERE row % 3 = 0 GROUP BY doc_id, row)"


@query(f"WITH {_NESTED} SELECT doc_id, box_id FROM nested a WHERE NOT EXISTS (SELECT 1 FROM nested b WHERE a.doc_id = b.doc_id AND a.box_id <> b.box_id AND a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h)")
def j10_containment_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without a box inside."""
    return spatial.innermost(_nested(spark, sf_dir)).select("doc_id", "box_id")


@query(f"WITH {_NESTED}, lines AS (SELECT doc_id, box_id AS line_id, CASE WHEN box_id % 2 = 0 THEN 'h' ELSE 'v' END AS axis, x, y, w, h FROM nested) SELECT doc_id, line_id, axis FROM lines a WHERE EXISTS (SELECT 1 FROM lines b WHERE a.doc_id = b.doc_id AND a.axis <> b.axis AND a.x - 3 <= b.x + b.w AND b.x <= a.x + a.w + 3 AND a.y - 3 <= b.y + b.h AND b.y <= a.y + a.h + 3)")
def j11_crossing_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that meet a line of the other axis."""
    axis = F.when(F.col("box_id") % 2 == 0, "h").otherwise("v")
    lines = _nested(spark, sf_dir).select("doc_id", F.col("box_id").alias("line_id"), axis.alias("axis"), "x", "y", "w", "h")
    return spatial.crossing_lines(lines).select("doc_id", "line_id", "axis")


@query(
    f"""WITH RECURSIVE {_NESTED}, edges AS (SELECT a.doc_id, a.box_id AS a, b.box_id AS b FROM nested a JOIN nested b ON a.doc_id = b.doc_id AND a.x - 1 < b.x + b.w + 1 AND b.x - 1 < a.x + a.w + 1 AND a.y - 1 < b.y + b.h + 1 AND b.y - 1 < a.y + a.h + 1),
    reach AS (SELECT DISTINCT doc_id, a, b FROM edges UNION SELECT r.doc_id, r.a, e.b FROM reach r JOIN edges e ON r.doc_id = e.doc_id AND r.b = e.a),
    labels AS (SELECT doc_id, a AS box_id, min(b) AS component FROM reach GROUP BY doc_id, a),
    sizes AS (SELECT doc_id, component, count(*) AS n FROM labels GROUP BY doc_id, component)
    SELECT doc_id, component, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, component) AS r FROM sizes) WHERE r = 1"""
)
def a15_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest group of overlapping boxes of each page."""
    return spatial.largest_component(spatial.page_components(_nested(spark, sf_dir)))


@query(f"WITH {_BOXES} SELECT doc_id, box_id FROM (SELECT doc_id, box_id, row_number() OVER (PARTITION BY doc_id, round_even(x / 150, 0), round_even(y / 150, 0), round_even(w / 150, 0), round_even(h / 150, 0) ORDER BY box_id) AS n FROM boxes) WHERE n = 1")
def a17_quantised_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes equal after rounding count once."""
    return spatial.quantised_distinct(boxes(spark, sf_dir), 150).select("doc_id", "box_id")


@query(f"WITH {_BOXES}, s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, box_id) > 58 THEN 1 ELSE 0 END AS st FROM boxes) SELECT doc_id, box_id, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY y, box_id ROWS UNBOUNDED PRECEDING) AS INT) AS cluster FROM s")
def w04_gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page by the gap to the row before."""
    return cluster.gap_clusters(boxes(spark, sf_dir), ["doc_id"], "y", "box_id", F.lit(58)).select("doc_id", "box_id", "cluster")


@query(
    f"""WITH RECURSIVE {_BOXES}, ordered AS (SELECT doc_id, box_id, CAST(y + h / 2 AS DOUBLE) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY y + h / 2, box_id) AS k FROM boxes),
    fold AS (SELECT doc_id, box_id, k, 0 AS cluster, 1 AS n, p AS s FROM ordered WHERE k = 1
      UNION ALL SELECT o.doc_id, o.box_id, o.k, CASE WHEN abs(o.p - f.s / f.n) <= 12 THEN f.cluster ELSE f.cluster + 1 END, CASE WHEN abs(o.p - f.s / f.n) <= 12 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(o.p - f.s / f.n) <= 12 THEN f.s + o.p ELSE o.p END
      FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
    SELECT doc_id, box_id, CAST(cluster AS INT) AS cluster FROM fold"""
)
def w01_mean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page by the running mean of the last line."""
    rows = boxes(spark, sf_dir).withColumn("cy", F.col("y") + F.col("h") / 2)
    height = F.median("h")
    lines = cluster.mean_clusters(rows, ["doc_id"], "cy", "box_id", F.when(height > 0, 0.6 * height).otherwise(6.0))
    return lines.select("doc_id", F.col("id").alias("box_id"), "cluster")


@query(f"WITH {_BOXES}, r AS (SELECT DISTINCT doc_id, row, l_partkey % 3 <> 0 AS ok FROM boxes), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row) AS k FROM r), g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY row) AS g FROM n WHERE ok), s AS (SELECT doc_id, min(row) AS first, max(row) AS last, count(*) AS length FROM g GROUP BY doc_id, g) SELECT doc_id, first, last, length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, first) AS r FROM s) WHERE r = 1")
def w07_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of rows that qualify."""
    rows = boxes(spark, sf_dir).where("role = 'quantity'")
    return cluster.longest_run(rows, "doc_id", "row", F.col("l_partkey") % 3 != 0)


@query(f"WITH {_BOXES} SELECT doc_id, row, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS INT) AS row_index FROM boxes WHERE role = 'quantity' AND confidence >= 0.3")
def w06_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows numbered without holes."""
    rows = boxes(spark, sf_dir).where("role = 'quantity'")
    return cluster.numbered(rows, "doc_id", "row", accepted=F.col("confidence") >= 0.3).select("doc_id", "row", "row_index")


@query(f"WITH {_BOXES}, o AS (SELECT doc_id, row, x + (l_partkey % 5) AS x, w, row_number() OVER (PARTITION BY doc_id, row ORDER BY x + (l_partkey % 5), box_id) - 1 AS ordinal FROM boxes) SELECT doc_id, CAST(ordinal AS INT) AS ordinal, median(x + w / 2) AS center FROM o GROUP BY doc_id, ordinal")
def w14_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column centres of each page."""
    cells = boxes(spark, sf_dir).select("doc_id", "row", F.col("box_id").alias("cell_id"), (F.col("x") + F.pmod("l_partkey", F.lit(5))).alias("x"), "w")
    return cluster.column_template(cells, 4)


@query(f"WITH {_BOXES}, p AS (SELECT a.doc_id, a.box_id, a.x, a.y, a.w, a.h, greatest(least(a.x + a.w, 180) - greatest(a.x, 90), 0) * greatest(least(a.y + a.h, 150) - greatest(a.y, 50), 0) AS o FROM boxes a) SELECT doc_id, box_id, round(o / (w * h), 9) AS ioa, round(o / (w * h + 9000 - o), 9) AS iou, round(sqrt(power(x + w / 2 - 135, 2) + power(y + h / 2 - 100, 2)), 6) AS distance FROM p")
def f50_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlap and distance of boxes from one window."""
    a, b = Box.of(), Box(F.lit(90), F.lit(50), F.lit(90), F.lit(100))
    return boxes(spark, sf_dir).select("doc_id", "box_id", F.round(ioa(a, b), 9).alias("ioa"), F.round(iou(a, b), 9).alias("iou"), F.round(center_distance(a, b), 6).alias("distance"))


@query("SELECT DISTINCT CAST(d AS DOUBLE) AS degrees, CAST(d - 90 * ceil((d - 45) / 90) AS DOUBLE) AS folded FROM (SELECT (l_partkey % 361) - 180 AS d FROM lineitem)")
def f54_fold_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line angles folded to the nearest axis."""
    degrees = (F.pmod("l_partkey", F.lit(361)) - 180).cast("double")
    return load(spark, sf_dir, "lineitem").select(degrees.alias("degrees")).distinct().withColumn("folded", fold_angle(F.col("degrees")))


@query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 4 AS k, l_quantity AS q, p_retailprice AS p, round(l_quantity * p_retailprice, 2) AS t FROM lineitem JOIN part ON l_partkey = p_partkey), v AS (SELECT *, CASE k WHEN 0 THEN [q, p, t] WHEN 1 THEN [t, p, q] WHEN 2 THEN [p, q] ELSE [l_linenumber::DOUBLE, q, p, t] END AS v FROM n),
    fits AS (SELECT *, len(v) AS m, list_reverse(v) AS r FROM v),
    o AS (SELECT *, CASE WHEN abs(v[m - 2] * v[m - 1] - v[m]) <= 0.01 THEN 0 WHEN m >= 4 AND abs(v[m - 3] * v[m - 2] - v[m]) <= 0.01 THEN 1 ELSE 0 END AS s, CASE WHEN abs(r[m - 2] * r[m - 1] - r[m]) <= 0.01 THEN 0 WHEN m >= 4 AND abs(r[m - 3] * r[m - 2] - r[m]) <= 0.01 THEN 1 ELSE 0 END AS b FROM fits),
    z AS (SELECT *, m > 2 AND NOT abs(v[m - 2 - s] * v[m - 1 - s] - v[m]) <= 0.01 AND abs(r[m - 2 - b] * r[m - 1 - b] - r[m]) <= 0.01 AS mirrored, m = 2 AND v[2] = floor(v[2]) AND v[1] <> floor(v[1]) AS turned FROM o)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN m = 2 THEN CASE WHEN turned THEN 1 ELSE 0 END WHEN mirrored THEN 2 + b ELSE m - 3 - s END AS INT) AS quantity_index,
      CAST(CASE WHEN m = 2 THEN CASE WHEN turned THEN 0 ELSE 1 END WHEN mirrored THEN 1 + b ELSE m - 2 - s END AS INT) AS unit_price_index, CAST(CASE WHEN m > 2 THEN CASE WHEN mirrored THEN 0 ELSE m - 1 END END AS INT) AS total_index,
      CASE WHEN m = 2 THEN round(p * q, 2) END AS derived_total FROM z"""
)
def r01_assign_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which numbers of a row are quantity, price and total, and the total of two, in four layouts."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = load(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    q, p = F.col("l_quantity"), F.col("p_retailprice")
    t, k = F.round(q * p, 2), F.pmod("l_suppkey", F.lit(4))
    shown = F.when(k == 0, F.array(q, p, t)).when(k == 1, F.array(t, p, q)).when(k == 2, F.array(p, q)).otherwise(F.array(F.col("l_linenumber").cast("double"), q, p, t))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse.assign_columns(shown).alias("a")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "a.*")


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT conv_id, turn, contains(low, 'the') OR contains(low, 'est') AS hinted, CAST(contains(low, 'the') AS INT) + CAST(contains(low, 'est') AS INT) + CAST(contains(low, 'net') AS INT) AS hints FROM (SELECT *, {_LOW} AS low FROM conversations)")
def p03_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hint words as parts of the texts of all turns, in any script."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.has_hint(low, ("the", "est")).alias("hinted"), text.count_hints(low, ("the", "est", "net")).alias("hints"))


@query("SELECT p_partkey, CAST(len(w) * (len(w) + 1) // 2 AS BIGINT) AS n, p_name || ' ' || p_type AS longest, w[len(w)] AS last FROM (SELECT *, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)")
def w09_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of part names, longest first."""
    runs = load(spark, sf_dir, "part").select("p_partkey", text.ngrams(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("g"))
    return runs.select("p_partkey", F.size("g").cast("bigint").alias("n"), F.get("g", F.lit(0)).alias("longest"), F.element_at("g", -1).alias("last"))
