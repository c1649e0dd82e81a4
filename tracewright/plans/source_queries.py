"""Queries on the data sources of the library: each writes or generates by a table, and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import custom, writers
from .rollouts import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS largest FROM embeddings")
def s15_npz_arrays(spark, sf_dir):
    """Embeddings written as npz files, and the rows of two arrays of each file put together again."""
    folder = writers.scratch(spark, "npz")
    writers.write_npz(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), folder)
    rows = custom.register(spark).read.format("npz").option("rowsPerPartition", 1000).load(folder)
    ids = rows.where("array = 'vec_id'").select("path", "row", F.get("numbers", F.lit(0)).cast("long").alias("vec_id"))
    vectors = rows.where("array = 'embedding'").select("path", "row", "numbers")
    return ids.join(vectors, ["path", "row"]).select("vec_id", F.size("numbers").alias("n"), F.get("numbers", F.lit(0)).alias("first"), F.array_max("numbers").alias("largest"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderkey % 3 = 0 AS again FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, true FROM orders WHERE o_orderkey % 3 = 0")
def k8_state_files(spark, sf_dir):
    """Orders as state rows, written by two jobs, read back by the manifest."""
    folder = writers.scratch(spark, "states")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("again")).alias("state"))
    custom.register(spark)
    o.write.format("states").mode("append").save(folder)
    o.where("state.again").write.format("states").mode("append").save(folder)
    back = spark.read.format("states").schema(o.schema).load(folder)
    return back.select("o_orderkey", "o_custkey", "state.status", "state.again")


def _number(name: str) -> str:
    return f"CAST('0x' || substr(md5('42:' || c_custkey || ':{name}'), 1, 8) AS BIGINT)"


@query(f"SELECT c_custkey, CAST({_number('question')} % 50 AS BIGINT) AS question_id, CAST(5 + {_number('q')} % 11 AS INTEGER) AS n_query, CAST(5 + {_number('r')} % 11 AS INTEGER) AS n_response, ({_number('reward')} % 10000)::DOUBLE / 1000 AS reward FROM customer")
def s16_debug_episodes(spark, sf_dir):
    """A debug episode for each customer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    each = (customers.agg(F.max("c_custkey")).first()[0] or 0) // 8 + 1
    e = custom.register(spark).read.format("debug_episodes").options(partitions=8, episodesPerPartition=each, questions=50).load()
    return customers.join(e, e.episode_id == F.col("c_custkey")).select("c_custkey", "question_id", F.size("query").alias("n_query"), F.size("response").alias("n_response"), "reward")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'customers_AUTOMOBILE_BUILDING' ELSE 'customers' END AS name FROM customer""")
def k10_named_outputs(spark, sf_dir):
    """Rows of some levels and the others, each in a folder named by its levels, and the names read back from the paths."""
    folder = writers.scratch(spark, "named")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    levels = {"BUILDING", "AUTOMOBILE"}
    some = F.col("c_mktsegment").isin(*levels)
    for rows, chosen in ((c.where(some), levels), (c.where(~some), set())):
        rows.select("c_custkey").write.parquet(f"{folder}/{writers.output_name('customers', chosen)}")
    back = spark.read.schema("c_custkey long").option("recursiveFileLookup", True).parquet(folder)
    return back.select("c_custkey", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("name"))
