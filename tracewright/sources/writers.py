"""Writers of rollout files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .readers import PROMPTS


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a local one only where that is unset and all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewright-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_prompts(df: DataFrame, path: str) -> DataFrame:
    """Write prompt records and read them back; wrong types are an error before anything is written."""
    want, have = {f.name: f.dataType for f in PROMPTS.fields}, {f.name: f.dataType for f in df.schema.fields}
    wrong = [c for c in ("prompt", "reward_model") if have.get(c) is None or have[c].simpleString() != want[c].simpleString()]
    if wrong:
        raise TypeError(f"not in the shape of prompt records: {wrong}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_evaluations(datasets: dict[str, Callable[[], DataFrame]], folder: str, spark: SparkSession) -> DataFrame:
    """Results of each dataset as JSON below folder, and a summary (dataset, n, mean_score, error): one that fails
    is a row with its error, and the others are written all the same."""
    rows = []
    for name, evaluate in datasets.items():
        try:
            path = f"{folder.rstrip('/')}/{name}_results"
            evaluate().write.mode("overwrite").json(path)
            n, mean = spark.read.json(path).agg(F.count("*"), F.avg("score")).first()
            rows.append((name, n, mean, None))
        except Exception as e:  # noqa: BLE001  (the error is the row)
            rows.append((name, None, None, type(e).__name__))
    out = spark.createDataFrame(rows, "dataset string, n long, mean_score double, error string")
    out.write.mode("overwrite").json(f"{folder.rstrip('/')}/summary")
    return out


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace a Parquet table by change(table), which Spark cannot overwrite while it reads it: written beside it, then
    swapped by name. If the job is lost, the old table or the new one is there whole."""
    path = path.rstrip("/")
    staging, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    change(spark.read.parquet(path)).write.parquet(staging)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for a, b in ((path, old), (staging, path)):
        if not files.rename(place(a), place(b)):
            raise OSError(f"cannot rename {a} to {b}")
    files.delete(place(old), True)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    latest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return both.withColumn("_r", latest).where("_r = 1").drop("_r")


def output_name(name: str, levels: set[str]) -> str:
    return f"{name}_{'_'.join(sorted(levels))}" if levels else name


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, compression="gzip")


def write_npz(df: DataFrame, folder: str, rows_per_file: int = 50_000) -> None:
    """Numeric columns, and columns of equally long numeric arrays, as npz files of up to rows_per_file rows, one array a column; rows with a null are left out."""
    import io

    import numpy as np

    from .custom import _at

    def store(batches):
        system, path = _at(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for k in range(0, batch.num_rows, rows_per_file):
                part = batch.slice(k, rows_per_file)
                arrays = {name: np.array(part.column(name).to_pylist()) for name in part.schema.names}
                buffer = io.BytesIO()
                np.savez(buffer, **arrays)
                name = uuid.uuid5(uuid.NAMESPACE_OID, buffer.getvalue()[:1024].hex() + str(len(buffer.getvalue()))).hex
                with system.open_output_stream(f"{path}/.{name}") as file:
                    file.write(buffer.getvalue())
                system.move(f"{path}/.{name}", f"{path}/part-{name}.npz")
        return iter(())

    df.dropna().mapInArrow(store, "done int").write.format("noop").mode("overwrite").save()
