"""Queries over all rows of their tables, not those that are easy to compare."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from glyphlake.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_hints_of_all_turns(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): (r["hinted"], r["hints"]) for r in entry.queries()["p03_hints"](spark, DATA).collect()}
    rows = turns.collect()
    assert any(not r["text"].isascii() for r in rows) and len(got) == len(rows)
    for r in rows:
        low = r["text"].lower()
        assert got[r["conv_id"], r["turn"]] == ("the" in low or "est" in low, sum(h in low for h in ("the", "est", "net")))


def test_probes_of_long_names(spark, tmp_path):
    spark.createDataFrame([("ab" + "c" * 150,)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert [r["probe"] for r in catalog._probes(spark, str(tmp_path)).collect()] == ["ab" + "c" * 149]


def written(path, rows):
    schema = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_linenumber", pa.int32())])
    pq.write_table(pa.table(list(map(list, zip(*rows))), schema=schema), path)


def raw_texts(spark, folder):
    return {r["doc_id"]: r["raw_text"] for r in entry.queries()["a08_raw_text"](spark, str(folder)).collect()}


# part keys of 100,000 and more give lines of other numbers the same ord, and the SQL leaves their order open
EQUAL = [(1, 118819, 1), (1, 18819, 2), (2, 18819, 2), (2, 118819, 1), (3, 7, None), (3, 9, 3), (3, 8, 1), (3, None, 1), (3, 3, None), (None, 9, 1)]


def test_raw_text_of_equal_places(spark, tmp_path):
    written(tmp_path / "lineitem.parquet", EQUAL)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = raw_texts(spark, tmp_path)
    assert got == {1: "p118819\np18819", 2: "p18819\np118819", 3: "p9\np7\np3", None: "p9"}
    assert got == dict(con.execute(entry.oracle_sql()["a08_raw_text"]).fetchall())


def test_raw_text_of_files(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    written(tmp_path / "lineitem.parquet/a.parquet", [(1, 5, 2), (2, 200001, 1)])
    # the larger file, which Spark reads first
    written(tmp_path / "lineitem.parquet/b.parquet", [(1, 100005, 1), (2, 1, 3), (2, 100001, 2), *((n, 100 * n + 1, 1) for n in range(10, 500))])
    got = raw_texts(spark, tmp_path)
    assert got[1] == "p5\np100005" and got[2] == "p200001\np1\np100001" and len(got) == 492
