"""Sources and sinks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_NAMES = "(?i).*\\.(jpg|jpeg|png)$"
UPLOAD_LIMIT = 25 * 1024 * 1024


def images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Images of a folder and those below it, and a quarantine of the files that can't be taken, with error_code.

    Spark's reader passes over files without a byte, so those are in neither.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    code = (
        F.when(~F.col("path").rlike(IMAGE_NAMES), "UNSUPPORTED_FILE_TYPE")
        .when(F.col("length") > UPLOAD_LIMIT, "FILE_TOO_LARGE")
        .when(~F.hex(F.substring("content", 1, 4)).rlike("^(89504E47|FFD8FF)"), "UNREADABLE_IMAGE")
    )
    checked = files.withColumn("error_code", code)
    return checked.where("error_code is null").drop("error_code"), checked.where("error_code is not null").select("path", "length", "error_code")


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """Ord and keyword of a JSON file {"keywords": [...]}; none if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("keywords array<string>").json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], "ord int, keyword string")
    return found.select(F.posexplode("keywords").alias("ord", "keyword"))


CATALOG_JSON = "merchants array<string>, products array<string>, cities array<string>, max_candidates int"
_ENTRY = "struct<id:bigint,name:string,aliases:array<string>>"


def catalogs(requests: DataFrame) -> DataFrame:
    """One row for each catalog entry of requests (request_id, options as JSON).

    An entry is a record {id, name, aliases} or a bare string, which is its name. Entries without a name are
    dropped; max_candidates is held to 1..25, 5 without one.
    """
    parsed = requests.select("request_id", F.from_json("options", CATALOG_JSON).alias("o"))
    most = F.greatest(F.lit(1), F.least(F.lit(25), F.coalesce("o.max_candidates", F.lit(5))))
    out = None
    for field, kind in (("merchants", "merchant"), ("products", "product"), ("cities", "city")):
        rows = parsed.select("request_id", most.alias("max_candidates"), F.lit(kind).alias("kind"), F.posexplode(f"o.{field}").alias("entry_ord", "raw"))
        record = F.from_json("raw", _ENTRY)
        is_record = F.trim("raw").startswith("{")
        entries = rows.select(
            "request_id", "max_candidates", "kind", "entry_ord",
            F.when(is_record, record["id"]).alias("entry_id"),
            F.trim(F.when(is_record, record["name"]).otherwise(F.col("raw"))).alias("name"),
            F.coalesce(F.when(is_record, record["aliases"]), F.array().cast("array<string>")).alias("aliases"),
        )
        entries = entries.where(F.coalesce(F.col("name") != "", F.lit(False)))
        out = entries if out is None else out.unionByName(entries)
    return out


def crop_records(crops: DataFrame) -> DataFrame:
    """Records of crops (doc_id, ord from 1, text, kind, x, y, w, h, confidence, source_id): synthesised ones have no confidence."""
    return crops.select(
        "doc_id", F.format_string("%03d.png", F.col("ord").cast("int")).alias("file"), "text", "kind", "x", "y", "w", "h",
        F.col("confidence").alias("detect_confidence"), F.col("confidence").isNull().alias("synthesised"), "source_id",
    )


def save_runs(runs: DataFrame, folder: str) -> None:
    """Runs (invoice_id, ...) as JSON lines in a folder for each hash of the id, so that no folder is made for each run.

    A run that is saved again stands beside the earlier one; `load_run` gives the later.
    """
    stamped = runs.withColumn("saved_at", F.unix_micros(F.current_timestamp()))
    stamped.withColumn("bucket", F.pmod(F.xxhash64("invoice_id"), F.lit(64)).cast("int")).write.mode("append").partitionBy("bucket").json(folder)


def load_run(spark: SparkSession, folder: str, invoice_id: str, schema: str) -> DataFrame:
    """The run of an id as it was saved last, whole; only its bucket is read. Raises KeyError if there is none."""
    bucket = F.pmod(F.xxhash64(F.lit(invoice_id)), F.lit(64)).cast("int")
    rows = spark.read.schema(f"{schema}, saved_at bigint, bucket int").json(folder).where((F.col("bucket") == bucket) & (F.col("invoice_id") == invoice_id))
    last = rows.agg(F.max("saved_at").alias("at")).first()["at"]
    if last is None:
        raise KeyError(invoice_id)
    return rows.where(F.col("saved_at") == last).drop("saved_at", "bucket")


def _number(a: Column, b: Column | int, c: int, seed: int = 0) -> Column:
    """A number below 2^31 made from two numbers, what it is for, and a seed, by arithmetic that any engine has."""
    b = F.lit(b) if isinstance(b, int) else b
    return (a * 7919 + b.cast("long") * 104729 + c * 1299709 + (15485863 + seed)) * 48271 % 2147483647


def synthetic_pages(spark: SparkSession, pages: int, seed: int = 0) -> DataFrame:
    """Fragments of made-up pages, the same for the same seed: merchant, number, date, city, two to five item rows and their total."""
    doc = F.col("doc_id")
    base = spark.range(pages).withColumnRenamed("id", "doc_id").withColumn("items", (2 + _number(doc, 0, 1, seed) % 4).cast("int"))
    rows = base.select("doc_id", "items", F.explode(F.sequence(F.lit(0), F.col("items") - 1)).alias("row"))
    priced = rows.select("doc_id", "items", "row", (1 + _number(doc, F.col("row"), 2, seed) % 9).alias("q"), (100 + _number(doc, F.col("row"), 3, seed) % 9900).alias("cents"))
    cells = F.array(
        *[
            F.struct(F.lit(x).alias("x"), (240 + 40 * F.col("row")).alias("y"), t.alias("text"))
            for x, t in ((400, F.concat(F.lit("item "), F.col("row").cast("string"))), (250, F.col("q").cast("string")), (150, F.format_string("%.2f", F.col("cents") / 100)), (60, F.format_string("%.2f", F.col("q") * F.col("cents") / 100)))
        ]
    )
    body = priced.select("doc_id", F.inline(cells))
    sums = priced.groupBy("doc_id").agg(F.sum(F.col("q") * F.col("cents")).alias("cents"), F.first("items").alias("items"))
    shown = lambda c, most: (_number(doc, 0, c, seed) % most).cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (_number(doc, 0, 6, seed) % 700).cast("int"))
    line = lambda x, y, *parts: F.struct(F.lit(x).alias("x"), (y if isinstance(y, Column) else F.lit(y)).cast("int").alias("y"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("text"))
    heads = F.array(
        line(300, 20, "merchant ", shown(4, 500), " trading"),
        line(250, 60, "invoice no INV-", F.lpad(shown(5, 100000), 5, "0")),
        line(300, 100, "date ", F.date_format(day, "dd/MM/yyyy")),
        line(300, 140, "city: town ", shown(7, 50)),
        line(300, 200, "item qty price amount"),
        line(250, 280 + 40 * F.col("items"), "total ", F.format_string("%.2f", F.col("cents") / 100)),
    )
    return body.unionByName(sums.select("doc_id", F.inline(heads))).select("doc_id", "text", "x", "y", F.lit(60).alias("w"), F.lit(20).alias("h"), F.lit(0.9).alias("confidence"))
