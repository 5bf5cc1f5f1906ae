"""Queries of the operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import vectors as V
from wayline.functions.uniform import uniform
from wayline.operators import evaluate, mixture, model, relabel, standardise, statistics
from wayline.operators import steps as S
from wayline.plans import loading, standards, views
from wayline.plans.pipelines import Source, TrajectoryTransforms, interleaved, single, validation
from wayline.plans.views import ARM, EVENTS, ITEMS, drawn, table
from wayline.sources import catalog
from wayline.streaming import control

QUERIES: dict[str, object] = {**standards.QUERIES, **loading.QUERIES}
SQL: dict[str, str] = {**standards.SQL, **loading.SQL}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def at(name: str, *places: int) -> Column:
    c = F.col(name)
    for p in places:
        c = F.get(c, p)
    return c


W = "over (partition by traj order by t)"
ALL = "over (partition by traj order by t rows between unbounded preceding and unbounded following)"


@query(f"""
with {EVENTS},
s as (select avg(a0) as m0, stddev_pop(a0) as s0, avg(a1) as m1, stddev_pop(a1) as s1 from ev),
z as (select traj, t, (a0 - m0) / (s0 + 1e-8::double) as z0, (a1 - m1) / (s1 + 1e-8::double) as z1, count(*) over (partition by traj) as n from ev, s)
select traj, t, round(coalesce(lag(z0) {W}, z0), 6) + 0 as h0, round(z0, 6) + 0 as h1, round(z1, 6) + 0 as k1,
  round(coalesce(lead(z0, 1) {W}, last_value(z0) {ALL}), 6) + 0 as f1, round(coalesce(lead(z1, 2) {W}, last_value(z1) {ALL}), 6) + 0 as f2,
  t >= 1 as m0, true as m1, n - 1 - (t - 3) <= 0 as c00, n - 1 - (t - 3 + 1 + 2) <= 0 as c12, not (n - 1 - (t - 3 + 1 + 2) <= 0) as a12
from z
""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    transforms = TrajectoryTransforms(window=2, horizon=3, observations=("state",))
    rows = views.events(spark, sf_dir)
    stats = statistics.vectors_of(statistics.statistics(rows, "action"))
    rows = statistics.normalized(rows, stats, "action").withColumn("state", F.col("action"))
    out = transforms(rows)
    return out.select(
        "traj", "t", r6(at("state", 0, 0)).alias("h0"), r6(at("state", 1, 0)).alias("h1"), r6(at("state", 1, 1)).alias("k1"), r6(at("action", 1, 1, 0)).alias("f1"), r6(at("action", 1, 2, 1)).alias("f2"),
        at("timestep_pad_mask", 0).alias("m0"), at("timestep_pad_mask", 1).alias("m1"), at("task_completed", 0, 0).alias("c00"), at("task_completed", 1, 2).alias("c12"), at("action_pad_mask", 1, 2, 0).alias("a12"),
    )


@query(f"""
with {ITEMS}, n as (select *, count(*) over (partition by traj) as n from li)
select traj, t, list_extract(list(a0) over (partition by traj order by t rows between current row and 11 following), least(12, n - t)::bigint) as ahead11,
  list_extract(list(a0) over (partition by traj order by t rows between 11 preceding and current row), 1) as back11, 12::bigint as size from n
""")
def wide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.items(spark, sf_dir).withColumn("a0", at("action", 0))
    both = li.select("traj", "t", S.future("a0", 12).alias("f"), S.history("a0", 12).alias("h"))
    return both.select("traj", "t", F.get("f", 11).alias("ahead11"), F.get("h", 0).alias("back11"), F.size("f").cast("long").alias("size"))


@query(f"""
with {EVENTS}, g as (select traj, t, {drawn('grip', 'traj', 't')} as g from ev),
k as (select *, case when g > 0.95 then 1.0::double when g < 0.05 then 0.0::double end as b, (g - 0.5) * 0.4 as d from g),
m as (select *, case when d < -0.1 then 1.0::double when d > 0.1 then -1.0::double end as o, case when d > 1e-3 then 0.0::double when d < -1e-3 then 1.0::double end as c from k)
select traj, t,
  round(coalesce(first_value(b ignore nulls) over (partition by traj order by t rows between current row and unbounded following), last_value(g) {ALL}), 6) + 0 as binary_grip,
  coalesce(last_value(o ignore nulls) over (partition by traj order by t rows between unbounded preceding and current row), -first_value(o ignore nulls) {ALL}, 1.0::double) / 2 + 0.5 as absolute_grip,
  coalesce(first_value(c ignore nulls) {ALL}, 0.0::double) as start_grip, round(1 - g, 6) + 0 as inverted_grip from m
""")
def gripper_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.events(spark, sf_dir).select("traj", "t", uniform("grip", F.col("traj"), F.col("t")).alias("g")).withColumn("d", (F.col("g") - 0.5) * 0.4)
    return g.select(
        "traj", "t", r6(S.binarized_gripper(F.col("g"))).alias("binary_grip"), S.absolute_gripper(F.col("d")).alias("absolute_grip"),
        S.open_or_closed(F.col("d")).alias("start_grip"), r6(S.inverted_gripper(F.col("g"))).alias("inverted_grip"),
    )


@query(f"""
with {EVENTS}, g as (select traj, t, {drawn('sticky', 'traj', 't')} > 0.4 as want from ev),
r as (select *, case when want is distinct from lag(want) {W} then 1 else 0 end as new from g),
x as (select *, sum(new) over (partition by traj order by t) as run from r),
p as (select *, row_number() over (partition by traj, run order by t) as place from x)
select traj, t, want, coalesce(last_value(case when place >= 3 then want end ignore nulls) over (partition by traj order by t rows between unbounded preceding and current row), false) as closed from p
""")
def sticky_gripper(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.events(spark, sf_dir).select("traj", "t", (uniform("sticky", F.col("traj"), F.col("t")) > 0.4).alias("want"))
    return S.sticky_gripper(g, "want", 3)


@query(f"""
with {EVENTS}, n as (select *, count(*) over (partition by traj) as n from ev)
select x.traj, x.t, round(lead(x.a0) over (partition by x.traj order by x.t) - x.a0, 6) + 0 as ahead, b.a0 as roll3, f.a0 as roll_minus2,
  first_value(x.a0) over w as first_a0, nth_value(x.a0, 2) over w as second_a0, last_value(x.a0) over w as last_a0, x.n - x.t as left_steps
from n x join ev b on x.traj = b.traj and b.t = (((x.t - 3) % x.n) + x.n) % x.n join ev f on x.traj = f.traj and f.t = (x.t + 2) % x.n
window w as (partition by x.traj order by x.t rows between unbounded preceding and unbounded following)
""")
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.rolled(views.events(spark, sf_dir).withColumn("a0", at("action", 0)), {"roll3": ("a0", 3), "roll_minus2": ("a0", -2)})
    return rows.select(
        "traj", "t", r6(at_of(S.difference_ahead("action"), 0)).alias("ahead"), "roll3", "roll_minus2",
        S.at_step("a0", 0).alias("first_a0"), S.at_step("a0", 1).alias("second_a0"), S.at_step("a0", -1).alias("last_a0"), S.to_end().alias("left_steps"),
    )


def at_of(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i))


@query(f"with {EVENTS} select traj, (t // 3)::int as t, a0, a1 from ev where t % 3 = 0")
def stride_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stride(views.events(spark, sf_dir), 3).select("traj", "t", at("action", 0).alias("a0"), at("action", 1).alias("a1"))


@query(f"""
with {EVENTS}, u as (select *, row_number() over (partition by traj order by {drawn('sub', 'traj', 't')}, t) as r from ev) select traj, t, a0 from u where r <= 20
""")
def subsample_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subsample(views.events(spark, sf_dir), 20, uniform("sub", F.col("traj"), F.col("t"))).select("traj", "t", at("action", 0).alias("a0"))


@query(f"""
with {EVENTS}, n as (select *, count(*) over (partition by traj) - 1 as m from ev)
select traj, t from n where t in (0, floor(m * 1 / 4.0)::int, floor(m * 2 / 4.0)::int, floor(m * 3 / 4.0)::int, m)
""")
def picked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.picked_steps(views.events(spark, sf_dir), 5).select("traj", "t")


@query(f"""
with {EVENTS}, l as (select *, case when {drawn('label', 'traj', 't')} < 0.01 then lang else '' end as label from ev),
k as (select *, bool_or(label <> '') over (partition by traj) as keep from l) select traj, t, label from k where keep
""")
def labelled_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(uniform("label", F.col("traj"), F.col("t")) < 0.01, F.col("language_instruction")).otherwise("")
    rows = views.events(spark, sf_dir).withColumn("label", label)
    return S.skip_unlabeled(rows, "label").select("traj", "t", "label")


@query(f"""
with {ITEMS}, s as (select avg(a0) as m, stddev_pop(a0) as d from li), z as (select traj, t, (a0 - m) / (d + 1e-8::double) as z from li, s),
k as (select *, bool_and(abs(z) <= 1.5) over (partition by traj) as keep from z) select traj, t, round(z, 6) + 0 as z from k where keep
""")
def bounded_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.items(spark, sf_dir).withColumn("action", F.array(at("action", 0)))
    stats = statistics.vectors_of(statistics.statistics(rows, "action"))
    return S.max_abs(statistics.normalized(rows, stats, "action"), "action", 1.5).select("traj", "t", r6(at("action", 0)).alias("z"))


@query(f"with {ITEMS}, n as (select *, count(*) over (partition by traj) as n from li) select traj, t, a0 from n where n > 1")
def long_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.longer_than(views.items(spark, sf_dir), 1).select("traj", "t", at("action", 0).alias("a0"))


@query(f"""
with {EVENTS}, k as (select traj, row_number() over (order by traj) as r, count(*) over () as n from (select distinct traj from ev))
select traj, case when r <= floor(0.95 * n + 0.5) then 'train' else 'val' end as split from k
""")
def split_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.split(views.events(spark, sf_dir).select("traj").distinct(), "traj")


@query("""
with c as (select conv_id, turn, role, case when turn = 1 then '' else text end as text from conversations)
select conv_id, turn, strlen(text) <> 0 as has_text, strlen(role) <> 0 as has_role, true as has_turn from c
""")
def pad_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") == 1, "").otherwise(F.col("text")))
    m = c.select("conv_id", "turn", S.pad_mask(c, ["text", "role", "turn"]).alias("m"))
    return m.select("conv_id", "turn", F.col("m.text").alias("has_text"), F.col("m.role").alias("has_role"), F.col("m.turn").alias("has_turn"))


@query("""
select vec_id, 70::bigint as size, round(embedding[64]::double, 6) + 0 as last_value, 0.0::double as padding, true as mask63, false as mask69 from embeddings
""")
def padded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("action", F.col("embedding").cast("array<double>"))
    p = S.pad_vectors(e, 70)
    return p.select("vec_id", F.size("action").cast("long").alias("size"), r6(at("action", 63)).alias("last_value"), at("action", 69).alias("padding"), at("action_pad_mask", 63).alias("mask63"), at("action_pad_mask", 69).alias("mask69"))


DIMS = """
d as (select label, vec_id, unnest(range(64))::int as dim, unnest(embedding)::double as x from embeddings),
s as (select label, dim, avg(x) as mean, stddev_pop(x) as std, max(x) as max, min(x) as min, quantile_cont(x, 0.99) as p99, quantile_cont(x, 0.01) as p01, count(*) as num_transitions, count(distinct vec_id) as num_trajectories from d group by label, dim)"""


def _embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("action", F.col("embedding").cast("array<double>"))
    return statistics.statistics(e, "action", ["label"], ["vec_id"], exact=True)


NUMBERS = ("mean", "std", "max", "min", "p99", "p01")


@query(f"with {DIMS} select label, dim, {', '.join(f'round({c}, 6) + 0 as {c}' for c in NUMBERS)}, num_transitions, num_trajectories from s")
def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _embedding_stats(spark, sf_dir)
    return s.select("label", "dim", *(r6(c).alias(c) for c in NUMBERS), "num_transitions", "num_trajectories")


@query("""
with d as (select vec_id, unnest(range(64))::int as dim, unnest(embedding)::double as x from embeddings)
select dim, round(avg(x), 6) + 0 as mean, round(stddev_pop(x), 6) + 0 as std, round(max(x), 6) + 0 as max, round(min(x), 6) + 0 as min, count(*)::bigint as num_transitions from d group by dim
""")
def combined_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = statistics.combine(_embedding_stats(spark, sf_dir))
    return c.select("dim", *(r6(x).alias(x) for x in ("mean", "std", "max", "min")), F.col("num_transitions").cast("long").alias("num_transitions"))


@query(f"""
with {ITEMS}, s as (select quantile_cont(a0, 0.01) as lo, quantile_cont(a0, 0.99) as hi, avg(a0) as m, stddev_pop(a0) as d from li),
z as (select *, greatest(-1.0::double, least(1.0::double, (a0 - lo) * 2 / (hi - lo + 1e-8::double) - 1)) as b, (a0 - m) / (d + 1e-8::double) as z from li, s)
select traj, t, round(b, 6) + 0 as b, a1 as unmasked, round(z, 6) + 0 as z, round((b + 1) * (hi - lo) / 2 + lo, 6) + 0 as from_bounds, round(z * d + m, 6) + 0 as from_normal from z
""")
def normalisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.items(spark, sf_dir).withColumn("action", F.slice("action", 1, 2))
    s = statistics.vectors_of(statistics.statistics(li, "action", exact=True))
    both = li.crossJoin(F.broadcast(s))
    mask = F.array(F.lit(True), F.lit(False))
    both = both.withColumns({"b": V.normalize_bounds(F.col("action"), F.col("p01"), F.col("p99"), mask), "z": V.normalize(F.col("action"), F.col("mean"), F.col("std"), mask)})
    back, un = V.unnormalize_bounds(F.col("b"), F.col("p01"), F.col("p99"), mask), V.unnormalize(F.col("z"), F.col("mean"), F.col("std"), mask)
    return both.select("traj", "t", r6(at("b", 0)).alias("b"), at("b", 1).alias("unmasked"), r6(at("z", 0)).alias("z"), r6(at_of(back, 0)).alias("from_bounds"), r6(at_of(un, 0)).alias("from_normal"))


@query(f"""
with {EVENTS}, n as (select *, count(*) over (partition by traj) as n from ev),
g as (select *, least((t + floor({drawn('goal', "'0'", 'traj', 't')} * (least(t + 25, n) - t)))::int, (n - 1)::int) as task_timestep from n)
select g.traj, g.t, g.task_timestep, e.a0 as goal_a0, e.a1 as goal_a1 from g join ev e on e.traj = g.traj and e.t = g.task_timestep
""")
def relabelled_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relabel.relabel_goals(views.events(spark, sf_dir), ["action"], 0, 25)
    return out.select("traj", "t", "task_timestep", at("task_action", 0).alias("goal_a0"), at("task_action", 1).alias("goal_a1"))


@query(f"""
with {EVENTS}, p(instruction, paraphrases) as (select distinct event_type, event_type || ' now.do ' || event_type from events where event_type <> 'error'),
f as (select *, first_value(lang) {ALL} as f from ev),
o as (select f.*, string_split(f.f || case when coalesce(paraphrases, '') <> '' then '.' || paraphrases else '' end, '.') as o from f left join p on p.instruction = f.f)
select traj, t, case when {drawn('rephrase', "'3'", 'traj')} < 0.5 then o[(floor({drawn('phrase', "'3'", 'traj', 't')} * len(o)) + 1)::bigint] else lang end as language_instruction from o
""")
def rephrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    phrases = table(spark, sf_dir, "events").where(e != "error").select(e.alias("instruction"), F.concat(e, F.lit(" now.do "), e).alias("paraphrases")).distinct()
    return relabel.rephrase(views.events(spark, sf_dir), phrases, 0.5, 3).select("traj", "t", "language_instruction")


@query(f"""
with {EVENTS}, k as (select *, (count(*) over (partition by traj) - 1)::int as m, {drawn('delete', "'4'", 'traj', 't')} < 0.5 or lang = 'error' as keep from ev)
select traj, t, keep as keep_images, case when keep or lang = 'error' then '' else lang end as language_instruction, case when keep then 'img' else '' end as image, case when keep then least(t + 1, m) else m end as task_timestep from k
""")
def deleted_conditioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).withColumn("language_instruction", F.when(F.col("language_instruction") == "error", "").otherwise(F.col("language_instruction")))
    rows = rows.withColumns({"image": F.lit("img"), "task_timestep": F.least(F.col("t") + 1, (S.length() - 1).cast("int"))})
    out = relabel.delete_conditioning(rows, ["image"], 0.5, 4)
    return out.select("traj", "t", "keep_images", "language_instruction", "image", "task_timestep")


@query(f"""
with {EVENTS}, i as (select traj, t, case when {drawn('there', 'traj', 't')} < 0.3 then '' else 'a' end as image_a, 'b' as image_b from ev),
k as (select *, case when image_a = '' then 'image_b' else case when floor({drawn('keep', "'5'", 'traj', 't')} * 2) = 0 then 'image_a' else 'image_b' end end as keep from i)
select traj, t, image_a <> '' and (keep = 'image_a' or {drawn('drop', "'5'", "'image_a'", 'traj', 't')} >= 0.6) as image_a_kept, keep = 'image_b' or {drawn('drop', "'5'", "'image_b'", 'traj', 't')} >= 0.6 as image_b_kept from k
""")
def dropped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).select("traj", "t", F.when(uniform("there", F.col("traj"), F.col("t")) < 0.3, "").otherwise("a").alias("image_a"), F.lit("b").alias("image_b"))
    return relabel.drop_images(rows, ["image_a", "image_b"], 0.6, 5).select("traj", "t", "image_a_kept", "image_b_kept")


@query("""
select conv_id, turn, mode, case when mode in ('image_conditioned', 'unconditioned') then '' else text end as text, case when mode in ('text_conditioned', 'unconditioned') then '' else role end as image
from conversations cross join (select unnest(['base', 'text_conditioned', 'image_conditioned', 'unconditioned']) as mode)
""")
def conditioning_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("role", "image")
    return relabel.modes(c, ["image"], "text").select("conv_id", "turn", "mode", "text", "image")


def _listed(column: int, place: int) -> str:
    return f"nullif(list_filter(string_split(trim(x[{column}]), ' '), lambda y: y <> '')[{place}], '-')"


LISTED = f"""
line as (select unnest(string_split('{catalog.SOURCES.strip()}', chr(10))) as line, unnest(range(len(string_split('{catalog.SOURCES.strip()}', chr(10))))) as i),
cat as (select i, trim(x[1]) as name, {', '.join(f"{_listed(2 + k // 3, k % 3 + 1)} as {('image', 'depth')[k // 3]}_{v}" for k, v in enumerate([*catalog.VIEWS, *catalog.VIEWS]))},
  trim(x[4]) as proprio_encoding, trim(x[5]) as action_encoding,
  case trim(x[5]) when 'EEF_POS' then 7 when 'JOINT_POS' then 8 when 'NAV_2D' then 2 when 'JOINT_POS_BIMANUAL' then 14 when 'JOINT_POS_BIMANUAL_NAV' then 16 end::int as action_dim
  from (select i, string_split(line, '|') as x from line))"""


@query(f"with {LISTED} select * exclude (i) from cat")
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_frame(spark)


@query(f"""
with {LISTED}, l as (select unnest(string_split('{catalog.MIXES.strip()}', chr(10))) as l, unnest(range(len(string_split('{catalog.MIXES.strip()}', chr(10))))) as k),
h as (select k, l, last_value(case when l like '%:' then rtrim(l, ':') end ignore nulls) over (order by k) as mix from l),
e as (select mix, (row_number() over (partition by mix order by k) - 1)::int as pos, string_split(l, ' ')[1] as name, string_split(l, ' ')[2]::double as weight from h where l not like '%:'),
a as (select * from e where mix <> 'franka' union all select 'rtx_franka', pos, name, weight from e where mix = 'rtx'
  union all select 'rtx_franka', pos + (select count(*) from e where mix = 'rtx')::int, name, weight from e where mix = 'franka'
  union all select 'full', i::int, name, 1.0 from cat where i <= (select i from cat where name = 'gnm_dataset')),
f as (select *, row_number() over (partition by mix, name order by pos) as r from a)
select mix, pos, f.name, weight, action_encoding, action_dim from f join cat on f.name = cat.name where r = 1
""")
def named_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixes = catalog.distinct_entries(catalog.mix_frame(spark))
    return mixes.join(catalog.catalog_frame(spark).select("name", "action_encoding", "action_dim"), "name")


SIZES = "z as (select label::varchar as name, count(*)::bigint as num_transitions, 1.0::double + label as weight from embeddings group by label)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").count().select(F.col("label").cast("string").alias("name"), F.col("count").alias("num_transitions"), (F.col("label") + 1.0).alias("weight"))


@query(f"""
with {SIZES}, w as (select *, weight * num_transitions / sum(weight * num_transitions) over () as sampling_weight from z),
p as (select *, (48 - count(*) over before) / (sum(sampling_weight) over () - coalesce(sum(sampling_weight) over before, 0)) as unit from w
  window before as (order by sampling_weight, name rows between unbounded preceding and 1 preceding)),
o as (select *, bool_or(sampling_weight * unit >= 1) over (order by sampling_weight, name rows between unbounded preceding and current row) as open from p),
s as (select *, case when open then sampling_weight * (48 - count(*) filter (where not open) over ()) / sum(sampling_weight) filter (where open) over () else 1.0::double end as share from o)
select name, num_transitions, round(sampling_weight, 6) as sampling_weight,
  (floor(share) + case when row_number() over (order by share - floor(share) desc, name desc) <= 48 - sum(floor(share)) over () then 1 else 0 end)::bigint as units from s
""")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = mixture.allocated(mixture.balanced(_sizes(spark, sf_dir)), 48)
    return w.select("name", "num_transitions", r6("sampling_weight").alias("sampling_weight"), "units")


@query(f"""
with {SIZES}, w as (select *, sum(weight * num_transitions) over (order by name) / sum(weight * num_transitions) over () as upto, row_number() over (order by name) - 1 as i from z),
s as (select slot, {drawn('slot', "'1'", 'slot')} as u from (select unnest(range((select floor(sum(num_transitions * weight) * 0.95)::bigint from z))) as slot)),
p as (select slot, least((select count(*) from w where upto <= u), 9) as i from s),
q as (select slot, w.name, (row_number() over (partition by w.name order by slot) - 1) % num_transitions as frame_no from p join w using (i)),
f as (select label::varchar as name, row_number() over (partition by label order by vec_id) - 1 as frame_no, vec_id from embeddings)
select slot, q.name, q.frame_no, vec_id from q join f using (name, frame_no)
""")
def interleaved_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("name"), "vec_id")
    frames = mixture.numbered_within(e, "name", ["vec_id"], "frame_no")
    sizes = _sizes(spark, sf_dir)
    return mixture.interleaved(frames, mixture.balanced(sizes), mixture.expected_length(sizes), 1).select("slot", "name", "frame_no", "vec_id")


@query(f"""
with {EVENTS}, r as (select traj, t, row_number() over (order by {drawn('shuffle', "'2'", 'traj', 't')}, traj, t) - 1 as r from ev) select traj, t, (r // 64)::bigint as batch_id, (r % 64)::bigint as place from r
""")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.batches(views.events(spark, sf_dir).select("traj", "t"), 64, 2, "traj", "t")


@query("select n_nationkey, n_name, epoch::int as epoch from nation cross join (select unnest(range(3)) as epoch)")
def repeated_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.repeated(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 3)


def _norm(*xs: str) -> str:
    return f"sqrt({' + '.join(f'{x} * {x}' for x in xs)})"


METRIC_SQL = f"""{ARM},
m as (select *, {' + '.join(f'(p{d} - q{d}) * (p{d} - q{d})' for d in range(7))} as mse, {' + '.join(f'(p{d} - q{d}) * (p{d} - q{d})' for d in range(3))} as mse_xyz,
  acos(greatest(-1.0::double, least(1.0::double, (p0 * q0 + p1 * q1 + p2 * q2) / (({_norm('p0', 'p1', 'p2')} + 1e-6::double) * ({_norm('q0', 'q1', 'q2')} + 1e-6::double))))) as xyz_angle,
  {_norm('p0', 'p1', 'p2')} as np, {_norm('q0', 'q1', 'q2')} as nq, p6 > 0.5 as cp, q6 > 0.5 as cq from arm),
s as (select *, xyz_angle < 0.5 as xyz_angle_accuracy, xyz_angle < 0.5 and np < nq * 2 and nq < np * 2 as xyz_accuracy, cp = cq as gripper_correct, nq > 0.01 as moving, count(*) over (partition by traj) as n from m)"""


@query(f"with {METRIC_SQL} select traj, t, round(mse, 6) as mse, round(mse_xyz, 6) as mse_xyz, round(xyz_angle, 6) as xyz_angle, xyz_angle_accuracy, xyz_accuracy, gripper_correct, moving from s")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.step_metrics(views.arm(spark, sf_dir))
    return m.select("traj", "t", *(r6(c).alias(c) for c in ("mse", "mse_xyz", "xyz_angle")), "xyz_angle_accuracy", "xyz_accuracy", "gripper_correct", "moving")


AROUND = f"""{METRIC_SQL},
r as (select s.*, b.cq as cb, a.cq as ca, o.cq as co, s.n - s.t as left_steps from s
  join s b on b.traj = s.traj and b.t = (((s.t - 3) % s.n) + s.n) % s.n join s a on a.traj = s.traj and a.t = (s.t + 3) % s.n join s o on o.traj = s.traj and o.t = (s.t - 1 + s.n) % s.n),
h as (select *, (cq and not cb) or (ca and not cq) as gripping, (cb and not cq) or (cq and not ca) as releasing, cq and not co as is_first_grip from r),
g as (select *, gripping or releasing as gripper_changing, not (gripping or releasing) as still, left_steps < 10 as "<10_to_end", left_steps > 20 as ">20_to_end" from h)"""


@query(f'with {AROUND} select traj, t, gripping, releasing, gripper_changing, still, is_first_grip, "<10_to_end" as under_10_to_end, ">20_to_end" as over_20_to_end from g')
def trajectory_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.trajectory_metrics(evaluate.step_metrics(views.arm(spark, sf_dir)))
    near, far = (F.col(f"`{c}`").alias(a) for c, a in ((evaluate.NEAR_END, "under_10_to_end"), (evaluate.FAR_FROM_END, "over_20_to_end")))
    return m.select("traj", "t", "gripping", "releasing", "gripper_changing", "still", "is_first_grip", near, far)


@query(f"""
with {METRIC_SQL},
e as (select s.traj, s.t, s.cp, s.cq and not j1.cq as g, b.cp as np1, {' or '.join(f'j{k}.cp' for k in range(1, 5))} as early, {' or '.join(f'(j{k}.cp and j{k}.height - s.height > 0.005)' for k in range(1, 5))} as high,
  greatest({', '.join(f'case when j{k}.cp then {k} else 0 end' for k in range(1, 5))})::int as steps,
  greatest({', '.join(f'case when j{k}.cp then greatest(j{k}.height - s.height, 0.0::double) else 0.0::double end' for k in range(1, 5))}) as height
  from s {' '.join(f'join s j{k} on j{k}.traj = s.traj and j{k}.t = (((s.t - {k}) % s.n) + s.n) % s.n' for k in range(1, 5))} join s b on b.traj = s.traj and b.t = (s.t + 1) % s.n)
select traj, t, g as is_first_grip, g and early as early_gripped, g and high as early_gripped_height_aware, case when g then steps else 0 end as timestep_to_grip,
  round(case when g then height else 0.0::double end, 6) as height_to_grip, g and (cp or np1) as gripped_on_time from e
""")
def early_grips(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.early_grip_metrics(evaluate.step_metrics(views.arm(spark, sf_dir)))
    return m.select("traj", "t", "is_first_grip", "early_gripped", "early_gripped_height_aware", "timestep_to_grip", r6("height_to_grip").alias("height_to_grip"), "gripped_on_time")


def _means_sql() -> str:
    parts = []
    metrics = {"mse": ("mse", []), "xyz_angle": ("xyz_angle", ["moving"]), "xyz_angle_accuracy": ("xyz_angle_accuracy", ["moving"]), "xyz_accuracy": ("xyz_accuracy", ["moving"])}
    metrics |= {"gripping_accuracy": ("gripper_correct", ["gripper_changing"]), "gripping_accuracy_full": ("gripper_correct", [])}
    for name, (quantity, own) in metrics.items():
        for c in ("all", "<10_to_end", ">20_to_end"):
            where = " and ".join([*own, *([] if c == "all" else [f'"{c}"'])]) or "true"
            parts.append(f"select '{name}' as metric, '{c}' as condition, round(avg({quantity}::double) filter (where {where}), 6) as value from g")
    return f"with {AROUND} {' union all '.join(parts)}"


@query(_means_sql())
def conditional_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.trajectory_metrics(evaluate.step_metrics(views.arm(spark, sf_dir)))
    return evaluate.conditional_means(m, conditions=(evaluate.NEAR_END, evaluate.FAR_FROM_END)).select("metric", "condition", r6("value").alias("value"))


@query(f"with {EVENTS}, b as (select lang, traj, avg(a0) as m from ev group by lang, traj) select lang, round(avg(m), 6) as a0 from b group by lang")
def means_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).select("traj", F.col("language_instruction").alias("lang"), at("action", 0).alias("a0"))
    return evaluate.mean_of_batch_means(rows, "a0", ["traj"], ["lang"]).select("lang", r6("a0").alias("a0"))


@query(f"with {EVENTS} select traj, round(sum(a0), 4) as episode_return, count(*)::bigint as episode_length, max(a0) >= 1 as best from ev group by traj")
def episode_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluate.returns(views.events(spark, sf_dir).withColumn("reward", at("action", 0)))
    return e.select("traj", F.round("episode_return", 4).alias("episode_return"), "episode_length", "best")


@query("select least(floor((o_totalprice - 0) / 500000.0::double * 20), 19)::int as bin, count(*)::bigint as n from orders where o_totalprice between 0 and 500000 group by 1")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0, 500000, 20)


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, floor(greatest(1e-6::double, least(0.1::double - 1e-6::double, l_discount)) / 0.1::double * 256)::int as bin,
  round((floor(greatest(1e-6::double, least(0.1::double - 1e-6::double, l_discount)) / 0.1::double * 256) + 0.5) * 0.1 / 256, 6) as centre from lineitem
""")
def uniform_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("bin", V.uniform_bins(F.col("l_discount"), 0.0, 0.1, 256))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "bin", r6(V.uniform_bin_centre(F.col("bin"), 0.0, 0.1, 256)).alias("centre"))


_THRESHOLDS = ", ".join(f"{t!r}::double" for t in V.normal_thresholds(16))


@query(f"""
with x as (select vec_id, embedding[1]::double * 8 as x from embeddings), b as (select *, len(list_filter([{_THRESHOLDS}], lambda v: v <= x)) as k from x)
select vec_id, case when k < 1 or k > 16 then 0 else k - 1 end::int as bin from b
""")
def normal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.normal_bins(at("embedding", 0).cast("double") * 8, 16).alias("bin"))


@query(f"""
with {ARM}, l as (select (p0 - q0) as d, q6 > 0.3 as m from arm)
select round(avg(d * d * m::int) / greatest(avg(m::int), 1e-5) * 7, 6) as mse_loss, round(avg(abs(d) * m::int) / greatest(avg(m::int), 1e-5) * 7, 6) as l1_loss from l
""")
def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, m = views.arm(spark, sf_dir), at("truth", 6) > 0.3
    mse, _ = model.loss(at("pred", 0), at("truth", 0), m, "mse", 7)
    l1, _ = model.loss(at("pred", 0), at("truth", 0), m, "l1", 7)
    return a.agg(F.round(mse, 6).alias("mse_loss"), F.round(l1, 6).alias("l1_loss"))


@query("""
with f as (select i, pow(cos((i / 50.0::double + 0.008::double) / 1.008::double * pi() / 2), 2) as f from (select unnest(range(51)) as i)),
b as (select x.i::int as i, least(greatest(1 - y.f / x.f, 0.0::double), 0.999::double) as beta from f x join f y on y.i = x.i + 1)
select i, round(beta, 6) as beta, round(product(1 - beta) over (order by i), 6) as alpha_hat from b
""")
def diffusion_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.cosine_betas(spark, 50).select("i", r6("beta").alias("beta"), r6("alpha_hat").alias("alpha_hat"))


@query("""
select step, round(case when step < 100 then 0.003::double * step / 100 else 0.003::double end, 8) as constant,
  round(case when step < 100 then 0.003::double * step / 100 else (cos(least((step - 100) / 900.0::double, 1.0::double) * pi()) + 1) * 0.5 * (0.003::double - 0.0001::double) + 0.0001::double end, 8) as cosine,
  round(case when step < 100 then 0.003::double * step / 100 else 0.003::double / sqrt((step - 100 + 10000.0::double) / 10000.0::double) end, 8) as rsqrt from (select unnest(range(1200)) as step)
""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.range(1200).withColumnRenamed("id", "step")
    rate = lambda kind, **k: F.round(model.learning_rate(F.col("step"), kind, 0.003, 100, **k), 8).alias(kind)
    return s.select("step", rate("constant"), rate("cosine", decay=1000, end=0.0001), rate("rsqrt"))


@query("""
with k(name, step, present) as (values ('task_language', -1, true), ('task_image', -1, false), ('obs_primary', 0, true), ('obs_wrist', 0, true), ('readout_action', 0, true), ('obs_primary', 1, true), ('obs_wrist', 1, false), ('readout_action', 1, true)),
x as (select *, row_number() over () - 1 as pos from k),
r as (select a.pos as from_pos, b.pos as to_pos, a.step as s, b.step as o, b.present, case when a.name like 'task%' then case when b.name like 'task%' then 'causal' else 'never' end
  when a.name like 'obs%' then case when b.name like 'task%' or b.name like 'obs%' then 'causal' else 'never' end
  else case when b.name like 'task%' or b.name like 'obs%' then 'causal' when b.name = a.name then 'current' else 'never' end end as rule from x a, x b)
select from_pos::bigint as from_pos, to_pos::bigint as to_pos, present and case rule when 'causal' then o <= s when 'current' then o = s else false end as attends from r
""")
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("task_language", -1, True), ("task_image", -1, False), ("obs_primary", 0, True), ("obs_wrist", 0, True), ("readout_action", 0, True), ("obs_primary", 1, True), ("obs_wrist", 1, False), ("readout_action", 1, True)]
    tokens = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, name string, step int, present boolean")
    obs = {"task_*": "causal", "obs_*": "causal"}
    groups = {"task_language": {"task_*": "causal"}, "task_image": {"task_*": "causal"}, "obs_primary": obs, "obs_wrist": obs, "readout_action": {**obs, "readout_action": "current"}}
    return model.attention(tokens, model.rule_frame(spark, groups))


@query("""
with o as (select n_name as path, n_regionkey::varchar as v from nation where n_nationkey < 20), n as (select n_name as path, case when n_nationkey % 3 = 0 then 'x' else n_regionkey::varchar end as v from nation where n_nationkey > 4),
j as (select coalesce(n.path, o.path) as path, o.v as old_value, n.v as new_value, n.path is null as gone, o.path is null as new from n full join o on n.path = o.path)
select path, case when new then 'added' when gone then 'removed' else 'changed' end as status, old_value, new_value from j where new or gone or old_value <> new_value
""")
def configuration_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    v = F.col("n_regionkey").cast("string")
    old = n.where("n_nationkey < 20").select(F.col("n_name").alias("path"), v.alias("value"))
    new = n.where("n_nationkey > 4").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise(v).alias("value"))
    return model.config_diff(new, old)


@query("""
with t as (select s_suppkey as path, s_nationkey as shape, s_acctbal as value from supplier), c as (select c_custkey as path, c_nationkey as shape, c_acctbal as value from customer)
select t.path, t.shape, case when c.shape = t.shape then c.value else t.value end as value, coalesce(c.shape = t.shape, false) as taken from t left join c on c.path = t.path
""")
def merged_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("shape"), F.col("s_acctbal").alias("value"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("shape"), F.col("c_acctbal").alias("value"))
    return model.merged(t, c)


@query(f"""
with {ARM}, q as (select traj, t, {', '.join(f'q{d} / sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) as r{d}' for d in range(4))} from arm)
select traj, t, round(atan2((r3 * r0 + r1 * r2) * 2, 1 - (r0 * r0 + r1 * r1) * 2), 6) + 0 as roll, round(asin(greatest(-1.0::double, least(1.0::double, (r3 * r1 - r2 * r0) * 2))), 6) + 0 as pitch,
  round(atan2((r3 * r2 + r0 * r1) * 2, 1 - (r1 * r1 + r2 * r2) * 2), 6) + 0 as yaw, round(r0 * cos(r2) + r1 * sin(r2), 6) + 0 as x, round(r1 * cos(r2) - r0 * sin(r2), 6) + 0 as y from q
""")
def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.arm(spark, sf_dir).select("traj", "t", F.slice("truth", 1, 4).alias("q")).withColumn("q", V.let(V.norm(F.col("q")), lambda n: F.transform("q", lambda x: x / n)))
    x, y = V.rotate(at("q", 0), at("q", 1), at("q", 2))
    e = q.withColumn("e", V.euler_of_quaternion(F.col("q")))
    return e.select("traj", "t", r6(at("e", 0)).alias("roll"), r6(at("e", 1)).alias("pitch"), r6(at("e", 2)).alias("yaw"), r6(x).alias("x"), r6(y).alias("y"))


_E = [f"exp(e[{d}]::double)" for d in range(1, 9)]


@query(f"""
with x as (select vec_id, embedding as e from embeddings), s as (select *, ln({' + '.join(_E)}) as z from x)
select vec_id, round(e[1]::double - z, 6) + 0 as log_p0, round(z - e[4]::double, 6) + 0 as entropy3, (list_position(e[1:8], list_max(e[1:8])) - 1)::int as best, round(e[3]::double * tanh(ln(1 + exp(e[3]::double))), 6) + 0 as mish from s
""")
def softmax_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("e"))
    return e.select("vec_id", r6(at_of(V.log_softmax(F.col("e")), 0)).alias("log_p0"), r6(V.cross_entropy(F.col("e"), F.lit(3))).alias("entropy3"), V.argmax(F.col("e")).alias("best"), r6(V.mish(at("e", 2))).alias("mish"))


@query("""
with w as (select conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:12] as w from conversations)
select conv_id, turn, 12::bigint as size, len(w)::bigint as n_real from w
""")
def tokenized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", model.tokenized(F.col("text"), 12).alias("k"))
    real = F.aggregate("k.attention_mask", F.lit(0), lambda s, x: s + x).cast("long")
    return c.select("conv_id", "turn", F.size("k.input_ids").cast("long").alias("size"), real.alias("n_real"))


@query(f"""
with {ARM}, g as (select traj, t, case when q6 > 0.95 then 1.0::double when q6 < 0.05 then 0.0::double end as k, q6, {', '.join(f'lead(p{d}) over w - p{d} as d{d}' for d in range(6))}, count(*) over (partition by traj) as n from arm window w as (partition by traj order by t)),
b as (select *, coalesce(first_value(k ignore nulls) over (partition by traj order by t rows between current row and unbounded following), last_value(q6) over (partition by traj order by t rows between unbounded preceding and unbounded following)) as b from g)
select 'bridge_dataset' as dataset_name, traj, t, {', '.join(f'round(d{d}, 6) + 0 as a{d}' for d in range(6))}, round(b, 6) + 0 as a6 from b where t < n - 1
""")
def standard_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.arm(spark, sf_dir).select("traj", "t", F.col("truth").alias("action"), F.struct(F.col("pred").alias("state")).alias("observation"), F.lit("").alias("language_instruction"))
    out = standardise.restructured(rows, "bridge_dataset", proprio=True)
    return out.select("dataset_name", "traj", "t", *(r6(at("action", d)).alias(f"a{d}") for d in range(7)))


@query(f"""
with {ARM}, h as (select traj, t, q0, q1, q2, p0, p1, n, first_value(x) over w / first_value(d) over w as scale from (
  select *, sqrt(q0 * q0 + q1 * q1) as x, sqrt(pow(lead(p0) over v - p0, 2) + pow(lead(p1) over v - p1, 2)) as d, count(*) over (partition by traj) as n from arm window v as (partition by traj order by t)) window w as (partition by traj order by t)),
s as (select *, lead(p0) over w - p0 as dx, lead(p1) over w - p1 as dy from h where t % 3 = 0 window w as (partition by traj order by t))
select traj, (t // 3)::int as t, round((dx * cos(q2) + dy * sin(q2)) * scale, 6) + 0 as a0, round((dy * cos(q2) - dx * sin(q2)) * scale, 6) + 0 as a1 from s where dx is not null
""")
def standard_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.arm(spark, sf_dir).select(
        "traj", "t", F.slice("truth", 1, 2).alias("action"), F.struct(F.slice("pred", 1, 2).alias("position"), at("truth", 2).alias("yaw"), F.slice("pred", 1, 2).alias("state")).alias("observation"), F.lit("go").alias("language_instruction")
    )
    out = standardise.standardised(rows, "gnm_dataset")
    return out.select("traj", "t", r6(at("action", 0)).alias("a0"), r6(at("action", 1)).alias("a1"))


@query(f"with {ITEMS} select traj, t, a0, a3 from li")
def nested_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flattened(S.nested(views.items(spark, sf_dir))).select("traj", "t", at("action", 0).alias("a0"), at("action", 3).alias("a3"))


@query(f"""
with {EVENTS}, x as (select traj, t as made, unnest(range(4)) as j, a0 from ev),
c as (select traj, made, (made + j)::int as t, a0 + j as v, row_number() over (partition by traj, made + j order by made) - 1 as i from x),
w as (select traj, t, sum(v * exp(-0.1::double * i)) / sum(exp(-0.1::double * i)) as action from c group by traj, t)
select traj, t, round(action, 6) + 0 as action from w join ev using (traj, t)
""")
def ensembled_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).select("traj", "t", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: at("action", 0) + j).alias("chunk"))
    return control.ensemble_batch(rows, 4, 0.1).select("traj", "t", r6("action").alias("action"))


@query(f"""
with {EVENTS}, x as (select traj, t as chunk_no, unnest(range(3))::int as i, a0 from ev where t % 3 = 0),
d as (select *, a0 + i as action, i * 1.0::double as reward, {drawn('done', 'traj', 'chunk_no', 'i')} < 0.2 as done from x),
e as (select *, coalesce(bool_or(done) over (partition by traj, chunk_no order by i rows between unbounded preceding and 1 preceding), false) as ended, sum(reward) over (partition by traj, chunk_no order by i) as reward_so_far from d)
select traj, chunk_no, i, action, reward_so_far from e where not ended
""")
def executed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).where("t % 3 = 0")
    seq = F.sequence(F.lit(0), F.lit(4))
    rows = rows.select(
        "traj", "t", F.transform(seq, lambda j: at("action", 0) + j).alias("chunk"), F.transform(seq, lambda j: j * 1.0).alias("rewards"),
        F.array(*(uniform("done", F.col("traj"), F.col("t"), F.lit(j)) < 0.2 for j in range(5))).alias("dones"),
    )
    rows = rows.withColumn("rewards", F.col("rewards").cast("array<double>"))
    return control.executed(rows, 3).select("traj", "chunk_no", "i", "action", "reward_so_far")


@query("""
select n_name, sha256(n_name || n_comment_key) as key from (select n_name, n_regionkey::varchar as n_comment_key from nation)
""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", statistics.cache_key_column(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("key"))


@query("""
select d.lang, round(avg(l.quality), 6) as quality, round(avg(d.n_chars) filter (where l.toxic = 1), 4) as toxic_chars, count(*)::bigint as n from documents d join labels l on d.doc_id = l.doc_id group by d.lang
""")
def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("n_chars"))), 4).alias("toxic_chars"), F.count("*").alias("n"))


@query(f"""
with {EVENTS}, m as (select avg(a0) as m0, stddev_pop(a0) as s0, avg(a1) as m1, stddev_pop(a1) as s1 from ev),
k as (select traj, row_number() over (order by traj) as r, count(*) over () as n from (select distinct traj from ev)),
z as (select traj, t, (a0 - m0) / (s0 + 1e-8::double) as z0, (a1 - m1) / (s1 + 1e-8::double) as z1, count(*) over (partition by traj) as n from ev, m
  where traj in (select traj from k where r <= floor(0.95 * n + 0.5))),
b as (select *, bool_and(coalesce(abs(z0) <= 5 and abs(z1) <= 5, false)) over (partition by traj) as keep from z),
g as (select *, least((t + floor({drawn('goal', "'0'", 'traj', 't')} * (n - t)))::int, (n - 1)::int) as task_timestep,
  row_number() over (partition by traj order by {drawn('subsample', "'0'", 'traj', 't')}, t) as r from b where keep)
select g.traj, g.t, g.task_timestep, 2::int as w, round(g.z0, 6) + 0 as now, round(e.z0, 6) + 0 as goal from g join z e on e.traj = g.traj and e.t = g.task_timestep where r <= 30
""")
def single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = single(Source("events", views.events(spark, sf_dir)), TrajectoryTransforms(window=2, horizon=4, goals="uniform", goal_columns=("action",), subsample=30, max_action=5.0), "train")
    return out.select("traj", "t", "task_timestep", F.size("action").alias("w"), r6(at("action", 1, 0, 0)).alias("now"), r6(at("task_action", 0)).alias("goal"))


@query(f"""
with {EVENTS}, p as (select traj, t, a0, a1, a1 * 2 as p0, a0 - a1 as p1 from ev),
m as (select avg(p0) as m0, stddev_pop(p0) as s0, avg(p1) as m1, stddev_pop(p1) as s1, avg(a0) as m, stddev_pop(a0) as s from p),
z as (select traj, t, a1, (a0 - m) / (s + 1e-8::double) as z, (p0 - m0) / (s0 + 1e-8::double) as z0, (p1 - m1) / (s1 + 1e-8::double) as z1 from p, m),
b as (select *, bool_and(coalesce(abs(z0) <= 3 and abs(z1) <= 3, false)) over (partition by traj) as keep from z)
select traj, t, round(z, 6) + 0 as action0, a1 as action1, 3::int as n_action, round(coalesce(lag(z0) {W}, z0), 6) + 0 as before0, round(z1, 6) + 0 as now1, 4::int as n_proprio from b where keep
""")
def proprio_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).withColumn("proprio", F.array(at("action", 1) * 2, at("action", 0) - at("action", 1)))
    transforms = TrajectoryTransforms(window=2, observations=("proprio",), max_proprio=3.0, max_action_dim=3, max_proprio_dim=4)
    out, _ = single(Source("events", rows, mask=(True, False)), transforms)
    return out.select(
        "traj", "t", r6(at("action", 1, 0, 0)).alias("action0"), at("action", 1, 0, 1).alias("action1"), F.size(at("action", 0, 0)).alias("n_action"),
        r6(at("proprio", 0, 0)).alias("before0"), r6(at("proprio", 1, 1)).alias("now1"), F.size(at("proprio", 0)).alias("n_proprio"),
    )


@query(f"""
with {EVENTS}, n as (select *, count(*) over (partition by traj) as n from ev)
select traj, t, coalesce(lag(a0) {W}, a0) as h00, coalesce(lag(a0) {W}, a0) + 1 as h01, a0 as h10, a0 + 1 as h11, 2::int as horizon, not (n - 1 - (t - 3 + 1 + 1) <= 0) as mask11 from n
""")
def chunks_as_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.array(at("action", 0) + j))
    rows = S.pad_vectors(views.events(spark, sf_dir).select("traj", "t", chunk.alias("action")), 2)
    out = S.chunked(rows, (), window=2, horizon=2)
    cell = lambda w, h: at("action", w, h, 0)
    return out.select("traj", "t", cell(0, 0).alias("h00"), cell(0, 1).alias("h01"), cell(1, 0).alias("h10"), cell(1, 1).alias("h11"), F.size(at("action", 0)).alias("horizon"), at("action_pad_mask", 1, 1, 0).alias("mask11"))


@query(f"""
with {EVENTS}, i as (select traj, t, lang, case when {drawn('there', 'traj', 't')} < 0.3 then '' else 'a' end as image_a, {drawn('delete', "'4'", 'traj', 't')} < 0.5 or lang = '' as keep from (select traj, t, case when lang = 'error' then '' else lang end as lang from ev)),
d as (select traj, t, keep, image_a <> '' and keep as a, keep as b, lang <> '' and not keep as said from i),
k as (select *, case when a and b then case when floor({drawn('keep', "'5'", 'traj', 't')} * 2) = 0 then 'image_a' else 'image_b' end when b then 'image_b' end as stays from d)
select traj, t, said as has_language, a and (stays = 'image_a' or {drawn('drop', "'5'", "'image_a'", 'traj', 't')} >= 0.6) as has_a, b and (stays = 'image_b' or {drawn('drop', "'5'", "'image_b'", 'traj', 't')} >= 0.6) as has_b from k
""")
def masks_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uniform("there", F.col("traj"), F.col("t"))
    said = F.when(F.col("language_instruction") == "error", "").otherwise(F.col("language_instruction"))
    rows = views.events(spark, sf_dir).select("traj", "t", said.alias("language_instruction"), F.when(u < 0.3, "").otherwise("a").alias("image_a"), F.lit("b").alias("image_b"))
    images = ["image_a", "image_b"]
    rows = rows.withColumn("pad_mask_dict", S.pad_mask(rows, [*images, "language_instruction"]))
    out = relabel.drop_images(relabel.delete_conditioning(rows, images, 0.5, 4), images, 0.6, 5)
    return out.select("traj", "t", *(F.col(f"pad_mask_dict.{c}").alias(a) for c, a in (("language_instruction", "has_language"), ("image_a", "has_a"), ("image_b", "has_b"))))


@query(f"""
with {EVENTS}, {ITEMS},
f as (select 'events' as name, traj, t, row_number() over (order by {drawn('frame', "'0'", 'traj', 't')}, traj, t) - 1 as frame_no from ev
  union all select 'items', traj, t, row_number() over (order by {drawn('frame', "'0'", 'traj', 't')}, traj, t) - 1 from li),
z as (select name, count(*) as n, case name when 'events' then 1.0::double else 0.5::double end as weight from f group by name),
w as (select *, sum(weight * n) over (order by name) / sum(weight * n) over () as upto, row_number() over (order by name) - 1 as i from z),
s as (select slot, {drawn('slot', "'0'", 'slot')} as u from (select unnest(range((select floor(sum(weight * n) * 0.95)::bigint from z))) as slot)),
p as (select slot, least((select count(*) from w where upto <= u), 1) as i from s),
q as (select slot, w.name, (row_number() over (partition by w.name order by slot) - 1) % n as frame_no from p join w using (i))
select slot, q.name, q.frame_no, traj, t from q join f using (name, frame_no)
""")
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.items(spark, sf_dir).withColumn("action", F.slice("action", 1, 2)).withColumn("language_instruction", F.lit(""))
    out = interleaved([Source("events", views.events(spark, sf_dir)), Source("items", li, kind="bounds", weight=0.5)], TrajectoryTransforms(horizon=2))
    return out.select("slot", "name", "frame_no", "traj", "t")


@query(f"""
with {EVENTS}, m as (select avg(a0) as m0, stddev_pop(a0) as s0 from ev),
k as (select traj, row_number() over (order by traj) as r, count(*) over () as n from (select distinct traj from ev))
select traj, t, round((a0 - m0) / (s0 + 1e-8::double), 6) + 0 as action0, 3::int as horizon from ev, m where traj in (select traj from k where r > floor(0.95 * n + 0.5))
""")
def validation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = validation(Source("events", views.events(spark, sf_dir)), TrajectoryTransforms(horizon=3, subsample=1))
    return out.select("traj", "t", r6(at("action", 0, 0, 0)).alias("action0"), F.size(at("action", 0)).alias("horizon"))


@query(f"with {SIZES} select name, weight from z where name in ('1', '3', '4', 'none') union all select name || ' of all', 1.0::double from z")
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    some = mixture.chosen(sizes, ["1", "3", "4", "none"]).select("name", "weight")
    every = mixture.chosen(sizes.drop("weight")).select(F.concat("name", F.lit(" of all")).alias("name"), "weight")
    return some.union(every).union(mixture.chosen(sizes, []).select("name", "weight"))


@query(f"with {SIZES} select '# ' || name || ': ' || lpad(format('{{:.6f}}', weight), (80 - length(name))::int, '=') || ' #' as line from z")
def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(_sizes(spark, sf_dir))


@query("""
select conv_id, string_agg(role, '|' order by turn) as roles, string_agg(turn::varchar, '|' order by turn) as turns from conversations group by conv_id
""")
def transposed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj"), F.col("turn").alias("t"), "role")
    rows = S.nested(c).select("traj", S.transposed(F.col("steps"), ["t", "role"]).alias("x"))
    return rows.select(F.col("traj").alias("conv_id"), F.array_join("x.role", "|").alias("roles"), F.array_join(F.transform("x.t", lambda t: t.cast("string")), "|").alias("turns"))


@query(f"""
with {EVENTS}, g as (select *, last_value(a0) {ALL} as goal from ev)
select traj, t, round(a0 + goal, 6) + 0 as first_sample, round(a0 * 2 + goal, 6) + 0 as second_sample, a0 as truth0, a1 as truth1 from g
""")
def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).withColumn("state", at("action", 0))
    asked = S.rollout(S.chunked(rows, ["state"], window=2, horizon=2), ["state"]).select("traj", "t", at("state", 1).alias("now"), "task_state", "truth")

    def policy(batch):  # two samples of chunks of two actions
        chunks = [[[k * now + goal, -1.0] for k in (1, 2)] for now, goal in zip(batch["now"], batch["task_state"], strict=True)]
        return batch[["traj", "t", "truth"]].assign(chunks=chunks)

    out = model.apply_policy(asked, policy, 64, "traj long, t int, truth array<double>, chunks array<array<double>>")
    first = out.withColumn("p", S.first_predictions(F.col("chunks")))
    return first.select("traj", "t", r6(at("p", 0)).alias("first_sample"), r6(at("p", 1)).alias("second_sample"), at("truth", 0).alias("truth0"), at("truth", 1).alias("truth1"))


@query(f"with {EVENTS} select traj, t, round(coalesce(lag(a0) {W}, a0) * 2 + 1, 6) + 0 as before, round(a0 * 2 + 1, 6) + 0 as now, round(a1 * 2 + 1, 6) + 0 as task from ev")
def functions_over_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).select("traj", "t", at("action", 0).alias("state"), at("action", 1).alias("task"))
    out = S.over_history(rows.withColumn("state", S.history("state", 2)), lambda x: x * 2 + 1, ["state"], ["task"])
    return out.select("traj", "t", r6(at("state", 0)).alias("before"), r6(at("state", 1)).alias("now"), r6("task").alias("task"))


@query(f"with {EVENTS} select traj, t, round((a0 - 0.25::double) / (2.0::double + 1e-8::double), 6) + 0 as x0, a1 as x1 from ev")
def online_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir).withColumnRenamed("action", "proprio")
    out = control.normalised(rows, {"mean": [0.25, 9.0], "std": [2.0, 3.0], "mask": [True, False]})
    return out.select("traj", "t", r6(at("proprio", 0)).alias("x0"), at("proprio", 1).alias("x1"))


@query(f"""
with {EVENTS} select traj, t, round(cos(a0 / 10), 6) + 0 as wave0, round(cos(a0 / 10 * exp(-ln(10000.0::double) / 2)), 6) + 0 as wave1, round(sin(a0 / 10 * exp(-ln(10000.0::double))), 6) + 0 as wave5,
  round(a0 / 127.5::double - 1, 6) + 0 as plain, round((a1 / 255.0::double - 0.456::double) / 0.224::double, 6) + 0 as scaled, a0 + 1 as second_chunk, 2::int as n_chunks from ev
""")
def vector_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.events(spark, sf_dir)
    waves, both = V.fourier(at("action", 0) / 10, 6), V.chunks(F.concat("action", F.transform("action", lambda x: x + 1)), 2)
    rows = rows.select("traj", "t", waves.alias("w"), V.pixels(F.col("action")).alias("p"), V.pixels(F.col("action"), "channels").alias("c"), both.alias("b"))
    return rows.select(
        "traj", "t", r6(at("w", 0)).alias("wave0"), r6(at("w", 1)).alias("wave1"), r6(at("w", 5)).alias("wave5"), r6(at("p", 0)).alias("plain"), r6(at("c", 1)).alias("scaled"),
        at("b", 1, 0).alias("second_chunk"), F.size("b").alias("n_chunks"),
    )


@query(f"""
with {EVENTS}, n as (select *, count(*) over (partition by traj) as n from ev)
select traj, t, t >= 1 and not (n - 1 - (t - 3) <= 0) as before, not (n - 1 - (t - 3 + 1) <= 0) as now, a0 > 0 or lang = 'click' as any_there, true as none_asked from n
""")
def combined_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.chunked(S.pad_vectors(views.events(spark, sf_dir).withColumn("a0", at("action", 0))), (), window=2)
    mask = model.combined_mask(F.col("timestep_pad_mask"), F.col("action_pad_mask"))
    there = model.any_present([F.col("a0") > 0, F.col("language_instruction") == "click"])
    return rows.withColumn("m", mask).select("traj", "t", at("m", 0, 0, 0).alias("before"), at("m", 1, 0, 0).alias("now"), there.alias("any_there"), model.any_present([]).alias("none_asked"))


@query("""
select conv_id, turn, 'text/bytes' as name, strlen(text)::double as value from conversations union all select conv_id, turn, 'text/by/chars', length(text)::double from conversations union all select conv_id, turn, 'place', turn::double from conversations
""")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.struct(F.octet_length("text").alias("bytes"), F.struct(F.length("text").alias("chars")).alias("by"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("place"), text.alias("text"))
    return evaluate.metric_rows(rows, ["conv_id", "turn"])


@query(f"""
with {EVENTS}, n as (select *, count(*) over (partition by traj) as n from (select traj, t, case when lang = 'error' then '' else lang end as lang from ev)),
g as (select *, least((t + floor({drawn('goal', "'6'", 'traj', 't')} * (n - t)))::int, (n - 1)::int) as goal from n)
select 'image_conditioned' as modality, traj, t, true as keep_images, '' as language_instruction, 'img' || goal as image, goal as task_timestep from g
union all select 'text_conditioned', traj, t, lang = '', lang, case when lang = '' then 'img' || t else '' end, -1 from g
""")
def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("language_instruction") == "error", "").otherwise(F.col("language_instruction"))
    rows = views.events(spark, sf_dir).select("traj", "t", said.alias("language_instruction"), F.concat(F.lit("img"), "t").alias("image"))
    both = [relabel.conditioned(rows, m, ["image"], 6).withColumn("modality", F.lit(m)) for m in ("image_conditioned", "text_conditioned")]
    both[1] = both[1].withColumn("task_timestep", F.lit(-1))
    names = ["modality", "traj", "t", "keep_images", "language_instruction", "image", "task_timestep"]
    return both[0].select(names).union(both[1].select(names))
