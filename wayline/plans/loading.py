"""Queries that read and write shards, skip what is damaged, shuffle through buffers, take steps that come late and cut words into pieces, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.uniform import uniform
from wayline.operators import images, mixture, subwords
from wayline.operators import steps as S
from wayline.operators.skips import Skipped
from wayline.plans import views
from wayline.plans.pipelines import Source, TrajectoryTransforms, single
from wayline.plans.views import EVENTS, ITEMS, drawn
from wayline.sources import files, records
from wayline.sources.shared import new_folder
from wayline.streaming import ordered

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Shards of a numbered table.
SHARDS = 16


def _written_and_read(df: DataFrame, name: str, **options) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    records.write_framed(df, path)
    return records.framed(df.sparkSession, path, **options)


@query(f"with {EVENTS} select traj, t, a0::float::double as a0, a1::float::double as a1, lang from ev")
def record_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step written as a record, and read back by byte ranges with all checksums."""
    steps = files.as_examples(views.events(spark, sf_dir, views.tasks(spark)).withColumnRenamed("language_instruction", "lang"), ["traj", "t", "action", "lang"])
    rows = files.parse_examples(_written_and_read(steps, "steps"), "traj long, t int, action array<float>, lang string")
    return rows.select("traj", "t", F.get("action", 0).cast("double").alias("a0"), F.get("action", 1).cast("double").alias("a1"), "lang")


@query(f"""
with {ITEMS}, n as (select traj, count(*) as n, sum(a0)::float as s from li group by traj),
r as (select *, row_number() over (partition by traj % {SHARDS} order by traj) - 1 as r from n) select traj, n, s::double as s, r::bigint as place from r
""")
def record_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a record for each order; a record's number in its shard comes from an index of lengths, without gathering the shard."""
    li = views.items(spark, sf_dir).groupBy("traj").agg(F.count("*").alias("n"), F.sum(F.get("action", 0)).alias("s"))
    path = new_folder(spark, "orders")
    dealt = li.repartitionById(SHARDS, F.pmod("traj", F.lit(SHARDS)).cast("int")).sortWithinPartitions("traj")
    records.write_framed(files.as_examples(dealt, ["traj", "n", "s"]), path)
    placed = records.with_places(records.framed(spark, path), records.framed(spark, path, contents=False))
    rows = files.parse_examples(placed.select("place", "content", "fault"), "traj long, n long, s float")
    return rows.select("traj", "n", F.col("s").cast("double").alias("s"), "place")


def _episodes(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    """A record for each user's events, as episodes are stored; a share of them cut short, so that they cannot be read."""
    one = S.nested(views.events(spark, sf_dir, views.tasks(spark)).withColumnRenamed("language_instruction", "lang"))
    flat = one.select("traj", F.flatten("steps.action").alias("action"), F.col("steps.lang").alias("lang"))
    coded = files.as_examples(flat, ["traj", "action", "lang"])
    cut = uniform("cut", F.col("traj")) < share
    return coded.select(F.when(cut, F.substring("content", 1, 40)).otherwise(F.col("content")).alias("content"))


@query(f"""
with {EVENTS}, k as (select traj, t, a0::float::double as a0, lang, count(*) over (partition by traj) as n from ev where {drawn('cut', 'traj')} >= 0.1),
s as (select avg(a0) as m, stddev_pop(a0) as d from k)
select traj, t, lang, round((a0 - m) / (d + 1e-8::double), 5) + 0 as z, n from k, s
""")
def sound_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes from shards, those that cannot be read left out, as steps of a source."""
    rows = files.parse_examples(_written_and_read(_episodes(spark, sf_dir, 0.1), "episodes"), "traj long, action array<float>, lang array<string>")
    sound = Skipped().rows(rows, F.col("fault").isNotNull(), "episodes").drop("path", "part", "nth", "start", "size", "fault")
    steps = files.episode_steps(sound, {"action": 2, "lang": 1}).withColumn("action", F.col("action").cast("array<double>"))
    out, _ = single(Source("events", steps), TrajectoryTransforms())
    return out.select("traj", "t", "lang", (F.round(F.get(F.get(F.get("action", 0), 0), 0), 5) + 0.0).alias("z"), S.length().alias("n"))


_BAD = f"""
e as (select *, bool_or({drawn('bad', "'events'", 'traj', 't')} < 0.01) over (partition by traj) as bad from ev),
i as (select *, bool_or({drawn('bad', "'items'", 'traj', 't')} < 0.03) over (partition by traj) as bad from li)"""


def _sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    """Two sources whose values do not parse at some steps."""
    out = []
    for name, rows, share in (("events", views.events(spark, sf_dir), 0.01), ("items", views.items(spark, sf_dir), 0.03)):
        text = F.when(uniform("bad", name, F.col("traj"), F.col("t")) < share, "?").otherwise(F.get("action", 0).cast("string"))
        rows = rows.select("traj", "t", F.array(text.try_cast("double")).alias("action"))
        out.append(Source(name, rows, bad=F.get("action", 0).isNull()))
    return out


@query(f"""
with {EVENTS}, {ITEMS}, {_BAD}
select 'events' as source, count(distinct traj) as trajectories, count(distinct traj) filter (bad) as skipped_trajectories, count(*) filter (bad) as skipped_steps from e
union all select 'items', count(distinct traj), count(distinct traj) filter (bad), count(*) filter (bad) from i
""")
def skipped_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of a pipeline leaves out."""
    skipped = Skipped()
    for source in _sources(spark, sf_dir):
        single(source, TrajectoryTransforms(), skipped=skipped)
    return skipped.report(spark)


@query(f"""
with {EVENTS}, {ITEMS}, {_BAD}, s as (select avg(a0) as m, stddev_pop(a0) as d from e where not bad)
select traj, t, round((a0 - m) / (d + 1e-8::double), 6) + 0 as z from e, s where not bad
""")
def unskipped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source without the trajectories that do not parse; its statistics leave them out too."""
    out, _ = single(_sources(spark, sf_dir)[0], TrajectoryTransforms())
    return out.select("traj", "t", (F.round(F.get(F.get(F.get("action", 0), 0), 0), 6) + 0.0).alias("z"))


BUFFER, LANES = 256, 4


@query(f"""
with {EVENTS}, f as (select *, lang as file, {drawn('file', "'9'", 'lang')} as draw from ev),
l as (select *, ((dense_rank() over (order by draw, file) - 1) % {LANES})::int as lane from f),
i as (select *, row_number() over (partition by lane order by draw, file, traj, t) - 1 as i, count(*) over (partition by lane) as n from l),
s as (select *, case when i < {BUFFER} then i else floor({drawn('buffer', "'9'", 'lane', 'i')} * {BUFFER})::bigint end as slot from i),
x as (select *, lead(i) over (partition by lane, slot order by i) as going from s)
select lane, traj, t, case when going is not null then going - {BUFFER}
  else greatest(n - {BUFFER}, 0) + row_number() over (partition by lane, going is null order by {drawn('flush', "'9'", 'lane', 'slot')}, slot) - 1 end as place from x
""")
def buffered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps file by file in the order of a draw, through a bounded buffer; the kind of event stands for a file."""
    rows = mixture.file_lanes(views.events(spark, sf_dir).select("traj", "t", F.col("language_instruction").alias("file")), "file", LANES, 9)
    return mixture.buffer_shuffled(rows, ["file_draw", "file", "traj", "t"], BUFFER, LANES, 9).select("lane", "traj", "t", "place")


def _streamed(df: DataFrame, batches: int, through) -> DataFrame:
    """A table cut at random into so many files, sent through a stream one file after the other; what comes out is kept in the shared folder."""
    spark = df.sparkSession
    path, out, name = new_folder(spark, "in"), new_folder(spark, "out"), "spark.sql.streaming.stateStore.providerClass"
    lot = F.floor(uniform("lot", F.col("traj"), F.col("t")) * batches).cast("int")
    df.withColumn("lot", lot).repartition("lot").write.partitionBy("lot").parquet(path)
    before = spark.conf.get(name)
    ordered.use_state_store(spark)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/lot=*")
        through(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{out}/rows")


@query(f"""
with {EVENTS}
select traj, t, coalesce(lag(a0, 2) over w, first_value(a0) over w) as h0, coalesce(lag(a0) over w, a0) as h1, a0 as h2, t >= 2 as m0, t >= 1 as m1
from ev window w as (partition by traj order by t)
""")
def late_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of steps that three micro-batches bring in no order."""
    rows = views.events(spark, sf_dir).select("traj", "t", F.slice("action", 1, 1).alias("x"))
    out = _streamed(rows, 3, lambda s: ordered.histories(s, 3)).where("not late")
    cell = lambda i: F.get(F.get("history", i), 0)
    return out.select("traj", "t", cell(0).alias("h0"), cell(1).alias("h1"), cell(2).alias("h2"), F.get("mask", 0).alias("m0"), F.get("mask", 1).alias("m1"))


@query(f"""
with {EVENTS}, x as (select traj, t as made, unnest(range(4)) as j, a0 from ev),
c as (select traj, made, (made + j)::int as t, a0 + j as v, row_number() over (partition by traj, made + j order by made) - 1 as i from x),
w as (select traj, t, sum(v * exp(-0.1::double * i)) / sum(exp(-0.1::double * i)) as action from c group by traj, t)
select traj, t, round(action, 6) + 0 as action from w join ev using (traj, t)
""")
def late_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensembles of chunks that three micro-batches bring in no order."""
    rows = views.events(spark, sf_dir).select("traj", "t", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get("action", 0) + j).alias("chunk"))
    out = _streamed(rows, 3, lambda s: ordered.ensembles(s, 4, 0.1)).where("not late")
    return out.select("traj", "t", (F.round("action", 6) + 0.0).alias("action"))


LENGTH = 24


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary by rule: beginnings of four characters and ends of three of the texts' words, and single characters; none with q, x or z."""
    text = F.lower(F.coalesce("text", F.lit("")))
    w = views.table(spark, sf_dir, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), 1))).alias("w")).distinct()
    single = F.explode(F.split("w", "")).alias("piece")
    starts = w.select(F.substring("w", 1, 4).alias("piece")).union(w.select(single))
    ends = w.where(F.length("w") > 3).select(F.substring("w", -3, 3).alias("piece")).union(w.select(single))
    both = starts.union(ends.select(F.concat(F.lit("##"), "piece"))).distinct().where("not rlike(piece, '[qxz]') and piece not in ('', '##')")
    return mixture.numbered(both, F.col("piece"), ["piece"], "rn").select("piece", (F.col("rn") + 3).cast("int").alias("id"))


@query(rf"""
with c as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]') as w from conversations),
w as (select distinct unnest(w) as w from c),
one as (select w, unnest(string_split(w, '')) as p from w),
v as (
  select piece, (row_number() over (order by encode(piece)) + 3)::int as id
  from (select w[1:4] as piece from w union select p from one union select '##' || w[-3:] from w where length(w) > 3 union select '##' || p from one)
  where not regexp_matches(piece, '[qxz]') and piece not in ('', '##')),
p as (
  select id, true as begins, piece as p, length(piece) as n from v where not (piece like '##%')
  union all select id, false, substring(piece, 3), length(piece) - 2 from v where piece like '##%'),
cut as (
  with recursive r(w, pos, ids) as (
    select w, 1::bigint, []::int[] from w
    union all
    select r.w, r.pos + max(p.n), list_append(any_value(r.ids), arg_max(p.id, p.n)) from r join p on p.begins = (r.pos = 1) and substring(r.w, r.pos, p.n) = p.p
    where r.pos <= length(r.w) group by r.w, r.pos)
  select w, ids from r where pos > length(w)),
k as (select w, coalesce(ids, [1::int]) as ids from w left join cut using (w)),
t as (
  select conv_id, turn, coalesce(flatten(list(ids order by i)), []) as ids
  from (select conv_id, turn, unnest(w) as w, generate_subscripts(w, 1) as i from c) join k using (w) group by conv_id, turn),
f as (select conv_id, turn, [2::int] || coalesce(ids, [])[1:{LENGTH - 2}] || [3::int] as ids from c left join t using (conv_id, turn))
select conv_id, turn, array_to_string(list_resize(ids, {LENGTH}, 0::int), ' ') as input_ids, len(ids)::bigint as n_real from f
""")
def subword_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of whole texts' first pieces, cut greedily by a vocabulary of the texts' own words."""
    pieces = subwords.Pieces(subwords.vocabulary(_pieces(spark, sf_dir)))
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", subwords.tokens(F.col("text"), pieces, LENGTH).alias("k"))
    real = F.aggregate("k.attention_mask", F.lit(0), lambda s, x: s + x).cast("long")
    return c.select("conv_id", "turn", F.array_join(F.transform("k.input_ids", lambda i: i.cast("string")), " ").alias("input_ids"), real.alias("n_real"))


def _grid(sign: str) -> str:
    return f"greatest(0, least(255, floor(({sign}x::double + 0.5) * 255)))"


@query(f"""
with v as (select vec_id, unnest(range(64)) as k, unnest(embedding) as x from embeddings),
g as (select vec_id, k // 8 as i, k % 8 as j, {_grid('')} as v, {_grid('-')} as n from v),
s as (select a, i, ((i + 0.5) - (a + 0.5) * 2) / 2.0::double as x from range(4) t(a), range(8) u(i)),
l as (select a, i, case when abs(x) >= 3 then 0 else 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * pi() * x * x) end as w from s),
w as (select a, i, w / sum(w) over (partition by a) as w from l),
o as (select vec_id, y.a, x.a as b, sum(y.w * x.w * v) as v, sum(y.w * x.w * n) as n from g join w y on y.i = g.i join w x on x.i = g.j group by all),
r as (select vec_id, a, b, greatest(0, least(255, round(v)))::int as v, greatest(0, least(255, round(n)))::int as n from o)
select vec_id, 2::int as steps, 4::int as height, array_to_string(list(v order by a, b), ' ') as now, array_to_string(list(n order by a, b), ' ') as negative from r group by vec_id
""")
def resized_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images of 8 by 8, in windows of two with a goal, at half the size."""
    e = views.table(spark, sf_dir, "embeddings")

    def grid(sign: int):
        level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * sign + 0.5) * 255))).cast("int")
        digits = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(level(x)), 2, "0")), "")
        return F.unhex(F.concat(F.hex(F.lit("P5\n8 8\n255\n").cast("binary")), digits))

    frames = e.select("vec_id", F.array(grid(1), grid(-1)).alias("image_a"), grid(-1).alias("goal"))
    out = images.window_transforms(frames, ["image_a"], {"goal": "image_a"}, {"image_a": (4, 4)}, train=False, key=("vec_id",))
    levels = lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.conv(F.hex(F.substring(c, k, F.lit(1))), 16, 10)), " ")
    return out.select("vec_id", F.size("image_a").alias("steps"), F.col("goal.height").alias("height"), levels(F.get("image_a", 0)["data"]).alias("now"), levels(F.col("goal.data")).alias("negative"))
