"""The driver's tables as trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.uniform import sql_uniform, uniform
from wayline.operators import steps as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for rows of few bytes that take long each: by their bytes alone they would be put together into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Users' events in time: ``traj, t, action, language_instruction``; in so many partitions by trajectory, if told."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "traj")
    e = e.repartition(parts, "traj") if parts else e
    k = F.get_json_object("props", "$.k").cast("double")
    return S.with_t(e, ["ts"]).select("traj", "t", F.array("value", k).alias("action"), F.col("event_type").alias("language_instruction"))


EVENTS = """
ev as (
  select user_id as traj, (row_number() over (partition by user_id order by ts) - 1)::int as t, value as a0,
    json_extract_string(props, '$.k')::double as a1, event_type as lang from events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders, short trajectories: ``traj, t, action``."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "traj")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return S.with_t(li, order).select("traj", "t", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("action"))


ITEMS = """
li as (
  select l_orderkey as traj, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1)::int as t,
    l_quantity as a0, l_extendedprice as a1, l_discount as a2, l_tax as a3 from lineitem)"""


def drawn(name: str, *key: str) -> str:
    return sql_uniform(f"'{name}'", *key)


def arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-dimensional predictions and truths drawn for each event: ``traj, t, pred, truth, height``."""
    rows = events(spark, sf_dir).select("traj", "t")
    own = (F.col("traj"), F.col("t"))
    truth = [uniform(f"truth{d}", *own) - (0.5 if d < 6 else 0.0) for d in range(7)]
    pred = [(uniform(f"truth{d}", *own) - (0.5 if d < 6 else 0.0)) * 0.5 + (uniform(f"pred{d}", *own) - (0.5 if d < 6 else 0.0)) * 0.5 for d in range(7)]
    return rows.select("traj", "t", F.array(*pred).alias("pred"), F.array(*truth).alias("truth"), (uniform("height", *own) * 0.02).alias("height"))


def _arm_sql() -> str:
    off = lambda d: "0.5::double" if d < 6 else "0.0::double"
    q = ", ".join(f"{drawn(f'truth{d}', 'traj', 't')} - {off(d)} as q{d}" for d in range(7))
    p = ", ".join(f"({drawn(f'truth{d}', 'traj', 't')} - {off(d)}) * 0.5::double + ({drawn(f'pred{d}', 'traj', 't')} - {off(d)}) * 0.5::double as p{d}" for d in range(7))
    return f"{EVENTS},\narm as (select traj, t, {p}, {q}, {drawn('height', 'traj', 't')} * 0.02::double as height from ev)"


ARM = _arm_sql()
