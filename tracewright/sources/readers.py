"""Readers of rollout files. Files of one kind may differ in shape; the schema decides, not the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
PROMPT = T.ArrayType(MESSAGE)
REWARD_MODEL = T.StructType([T.StructField("ground_truth", T.StringType())])
EXTRA = T.StructType([T.StructField(c, T.StringType()) for c in ("split", "index", "level", "type", "source", "problem_source", "config")])
PROMPTS = T.StructType(
    [T.StructField("data_source", T.StringType()), T.StructField("prompt", PROMPT), T.StructField("ability", T.StringType()), T.StructField("reward_model", REWARD_MODEL), T.StructField("extra_info", EXTRA)]
)


def parsed(df: DataFrame, column: str, kind: T.DataType) -> Column:
    """The column as kind: JSON text is parsed, a plain text prompt becomes one user message, structs pass."""
    have = df.schema[column].dataType
    if not isinstance(have, T.StringType) or isinstance(kind, T.StringType):
        return F.col(column)
    if kind == PROMPT:
        plain = F.array(F.struct(F.lit("user").alias("role"), F.col(column).alias("content")))
        return F.when(F.trim(column).startswith("["), F.from_json(column, PROMPT)).otherwise(plain)
    return F.from_json(column, kind)


def read_prompts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Prompt records from Parquet, JSON or JSON lines, in the five-field shape."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path, multiLine=path.endswith(".json"))
    kinds = {f.name: f.dataType for f in PROMPTS.fields}
    out = df.select(*[(parsed(df, c, k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
    return out if limit is None else out.limit(limit)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, sample_idx, response, score) from results with arrays of responses and scores."""
    df = spark.read.json(path)
    one = F.posexplode(F.arrays_zip("responses", "scores")).alias("sample_idx", "x")
    keep = [c for c in df.columns if c not in ("responses", "scores")]
    return df.select(*keep, one).select(*keep, "sample_idx", F.col("x.responses").alias("response"), F.col("x.scores").alias("score"))


def read_folder(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


@dataclass(frozen=True)
class SourceSpec:
    """How a raw dataset becomes prompt records."""

    data_source: str
    question: tuple[str, ...]
    answer: tuple[str, ...]
    system: str = "Let's think step by step and output the final answer within \\boxed{}."
    ability: str = "math"
    keep: str | None = None
    limit: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def _first(self, df: DataFrame, names: tuple[str, ...]) -> Column:
        """The first column there is: by the schema, so nulls in it stay."""
        return F.col(next(c for c in names if c in df.columns)).cast("string")

    def load(self, df: DataFrame, split: str, index: str) -> DataFrame:
        rows = df.where(self.keep) if self.keep else df
        if self.limit:
            rows = rows.orderBy(index).limit(self.limit)
        message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        extra = {"split": F.lit(split), "index": F.col(index).cast("string"), **{k: F.col(v).cast("string") for k, v in self.extra.items() if v in df.columns}}
        return rows.select(
            F.lit(self.data_source).alias("data_source"),
            F.array(message("system", F.lit(self.system)), message("user", self._first(df, self.question))).alias("prompt"),
            F.lit(self.ability).alias("ability"),
            F.struct(self._first(df, self.answer).alias("ground_truth")).alias("reward_model"),
            F.struct(*[extra.get(c, F.lit(None).cast("string")).alias(c) for c in EXTRA.names]).alias("extra_info"),
        )


def server_log_averages(spark: SparkSession, path: str) -> DataFrame:
    """Averages of the throughput figures in inference server logs; 0 where a figure never occurs."""
    figures = {"prompt_throughput": r"[Pp]rompt throughput: ([0-9.]+)", "generation_throughput": r"[Gg]eneration throughput: ([0-9.]+)", "cache_usage": r"KV cache usage: ([0-9.]+)%"}
    lines = spark.read.text(path)
    return lines.agg(*[F.coalesce(F.avg(F.regexp_extract("value", p, 1).try_cast("double")), F.lit(0.0)).alias(n) for n, p in figures.items()])


#: Evaluation sets: which columns hold question and answer; the first that is there counts.
EVALUATIONS = {
    "math500": SourceSpec("math500", ("problem",), ("answer",), extra={"level": "level", "type": "subject"}),
    "gsm8k_test": SourceSpec("gsm8k", ("question",), ("answer",)),
    "amc_2023": SourceSpec("amc_2023", ("problem",), ("answer",)),
    "aime_2024": SourceSpec("aime_2024", ("problem",), ("answer", "solution")),
    "aime_2025": SourceSpec("aime_2025", ("question", "problem"), ("answer",), extra={"config": "config"}),
    "olympiad_bench": SourceSpec("olympiad_bench", ("question",), ("final_answer",)),
    "minerva_math": SourceSpec("minerva_math", ("question", "problem"), ("answer", "solution")),
    "omni_math": SourceSpec("omni_math", ("problem",), ("solution",)),
    "hmmt": SourceSpec("hmmt", ("problem",), ("answer",)),
    "brumo": SourceSpec("brumo", ("problem", "question"), ("answer",)),
    "cmimc": SourceSpec("cmimc", ("problem",), ("answer",)),
}


def load_evaluation(name: str, *parts: tuple[str, DataFrame], index: str) -> DataFrame:
    """Prompt records of an evaluation set from its parts (config, frame), numbered on from part to part by index;
    of a list of answers the first counts."""
    spec, out, begin = EVALUATIONS[name], None, 0
    for config, df in parts:
        answer = next(c for c in spec.answer if c in df.columns)
        if isinstance(df.schema[answer].dataType, T.ArrayType):
            df = df.withColumn(answer, F.coalesce(F.get(answer, F.lit(0)), F.lit("")))
        rows = spec.load(df.withColumn("config", F.lit(config)).withColumn("_index", F.col(index) + begin), "test", "_index")
        out = rows if out is None else out.unionByName(rows)
        begin += df.count() if len(parts) > 1 else 0
    return out


def read_first(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """The first of several paths that can be read; the error of the last if none can."""
    read = read or (lambda s, path: s.read.parquet(path))
    for k, path in enumerate(paths):
        try:
            return read(spark, path)
        except AnalysisException:
            if k == len(paths) - 1:
                raise
    raise ValueError("no path given")
