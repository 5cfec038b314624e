"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.functions import scalars as S
from episodelake.lenses import eval_results, frames, log_lines, prompts, sql, vectors
from episodelake.operators.stats import global_quantiles
from episodelake.plans.projections import r6
from episodelake.registry import query

PROMPT_SQL = S.PROMPT.replace("'", "''").replace("{task}", "")


@query(sql("prompts", f"SELECT pos, '{PROMPT_SQL}' || CASE WHEN pos % 10 = 0 THEN 'wait' ELSE task END AS prompt FROM prompts"))
def fn_prompt_template(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("pos", S.prompt_template(F.col("task"), F.when(F.col("pos") % 10 == 0, "wait")).alias("prompt"))


SIDES = """t AS (SELECT pos, CASE pos % 5 WHEN 0 THEN task || '@x' WHEN 1 THEN '@' || dataset WHEN 2 THEN dataset || '@ ' || dataset WHEN 3 THEN dataset ELSE task END AS task FROM prompts),
s AS (SELECT pos, task, CASE WHEN strpos(task, '@') = 0 THEN [task] ELSE [left(task, strpos(task, '@') - 1), substr(task, strpos(task, '@') + 1)] END AS sides FROM t),
v AS (SELECT pos, task, list_filter(list_transform(sides, lambda x: trim(x)), lambda x: x <> '') AS v FROM s)"""


def odd_tasks(spark: SparkSession, sf: str) -> DataFrame:
    m, at = F.col("pos") % 5, F.lit("@")
    task = F.when(m == 0, F.concat("task", F.lit("@x"))).when(m == 1, F.concat(at, "dataset")).when(m == 2, F.concat("dataset", F.lit("@ "), "dataset")).when(m == 3, F.col("dataset")).otherwise(F.col("task"))
    return prompts(spark, sf).select("pos", task.alias("task"))


@query(sql("prompts", f"{SIDES} SELECT DISTINCT pos, unnest(v) AS variant, len(string_split(task, '@')) > 2 AS more FROM v"))
def fn_bilingual_variants(spark: SparkSession, sf: str) -> DataFrame:
    return odd_tasks(spark, sf).select("pos", F.explode(S.bilingual_variants(F.col("task"))).alias("variant"), S.has_more_sides(F.col("task")).alias("more"))


@query(sql("prompts", """t AS (SELECT pos, dataset, CAST(concat('0x', substr(md5(concat('3:', CAST(pos AS varchar))), 1, 8)) AS bigint) / 4294967296.0::double AS u,
CASE WHEN pos % 4 = 0 THEN NULL WHEN pos % 7 = 0 THEN dataset WHEN pos % 2 = 0 THEN left(task, strpos(task, '@') - 1) ELSE substr(task, strpos(task, '@') + 1) END AS low, CASE WHEN pos % 5 = 0 THEN '' ELSE dataset END AS high FROM prompts)
SELECT pos, CASE WHEN low IS NULL THEN '[high] ' || high WHEN u >= 0.5 THEN '[High]: ' || high || ', [Low]: ' || low ELSE low END AS instruction,
CASE WHEN low IS NULL THEN '[high] ' || high WHEN u >= 0.5 THEN '[High]: ' || high || ', [Low]: ' || low ELSE '[Low]: ' || low END AS prefixed FROM t"""))
def fn_augment_instruction(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("pos")
    low = F.when(pos % 4 != 0, F.when(pos % 7 == 0, F.col("dataset")).otherwise(F.col("task")))
    high, u = F.when(pos % 5 != 0, F.col("dataset")), S.hash_unit(F.lit(3), pos)
    made = [S.augment(high, low, u, F.lit(0.5), pos % 2 == 0, p) for p in (False, True)]
    return prompts(spark, sf).select("pos", made[0].alias("instruction"), made[1].alias("prefixed"))


@query(sql("prompts", "SELECT pos, concat(sha256(task), '.t5_len128.umt5.pt') AS key FROM prompts"))
def fn_prompt_key(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("pos", S.prompt_key(F.col("task"), 128, "umt5").alias("key"))


@query(sql("prompts", r"SELECT pos, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS cleaned, lower(trim(regexp_replace(task, '[ \t\n\r\f]+', ' ', 'g'))) AS lowered FROM prompts"))
def fn_whitespace_clean(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("pos", S.whitespace_clean(F.col("text")).alias("cleaned"), S.whitespace_clean(F.col("task"), lower=True).alias("lowered"))


@query()
def fn_basic_clean(spark: SparkSession, sf: str) -> DataFrame:
    escaped = F.concat(F.lit(" &amp;lt;b&amp;gt; "), "text", F.lit(" &quot;"))
    return prompts(spark, sf).select("pos", S.basic_clean(escaped).alias("cleaned"))


@query(sql("prompts", r"""SELECT pos, trim(regexp_replace(lower(translate(replace(task || '_' || dataset, '_', ' '), '!"#$%&''()*+,-./:;<=>?@[\]^`{|}~', '')), '[ \t\n\r\f]+', ' ', 'g')) AS canonical,
trim(regexp_replace(lower(array_to_string(list_transform(string_split(replace(task || '_<s>, ' || dataset, '_', ' '), '<s>'), lambda x: translate(x, '!"#$%&''()*+,-./:;<=>?@[\]^`{|}~', '')), '<s>')), '[ \t\n\r\f]+', ' ', 'g')) AS kept FROM prompts"""))
def fn_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    kept = S.canonicalize(F.concat("task", F.lit("_<s>, "), "dataset"), keep="<s>")
    return prompts(spark, sf).select("pos", S.canonicalize(F.concat("task", F.lit("_"), "dataset")).alias("canonical"), kept.alias("kept"))


@query(sql("prompts", """t AS (SELECT pos, string_split(task, ' ') AS w FROM prompts)
SELECT pos, CAST(i AS bigint) AS at, coalesce(w[i + 1], '<pad>') AS token, i < len(w) AS mask FROM t, LATERAL unnest(range(0, 6)) x(i)"""))
def fn_pad_truncate(spark: SparkSession, sf: str) -> DataFrame:
    p = prompts(spark, sf).select("pos", S.pad_truncate(F.split("task", " "), 6).alias("p"))
    z = p.select("pos", F.posexplode(F.arrays_zip(F.col("p.ids").alias("token"), F.col("p.mask").alias("mask"))).alias("at", "z"))
    return z.select("pos", F.col("at").cast("long").alias("at"), "z.token", "z.mask")


NORM = """s AS (SELECT avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99, min(value) AS mn, max(value) AS mx FROM frames),
c AS (SELECT *, 1 / (std + 1e-8) AS zs, CASE WHEN q99 - q01 < 1e-4 THEN 1 ELSE 2 / (q99 - q01) END AS qs, CASE WHEN mx - mn < 1e-4 THEN 1 ELSE 2 / (mx - mn) END AS ms FROM s)"""


def with_scales(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    # statistics of all values are one row of numbers
    (q01, q99), row = global_quantiles(f, "value", [0.01, 0.99], [F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")])
    s = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in (row.asDict() | {"q01": q01, "q99": q99}).items() if not n.startswith("__")])
    scales = spark.range(1).select(s.alias("s")).select(*[S.norm_scale(F.col("s"), m).alias(n) for n, m in MODES.items()])
    return f.crossJoin(F.broadcast(scales))


MODES = {"z": "z", "quantile": "quantile", "minmax": "minmax", "constant": "-20/180"}


def normal(mode: str) -> Column:
    return S.normalize(F.col("value"), F.col(mode)["scale"], F.col(mode)["offset"])


@query(sql("frames", f"""{NORM} SELECT index, round(greatest(-5, least(5, value * zs - mean * zs)), 6) + 0.0 AS z, round(greatest(-5, least(5, value * qs - 1 - q01 * qs)), 6) + 0.0 AS quantile,
round(greatest(-5, least(5, value * ms - 1 - mn * ms)), 6) + 0.0 AS minmax, round(greatest(-5, least(5, value * 0.01::double - 0.8)), 6) + 0.0 AS constant FROM frames, c"""))
def fn_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return with_scales(spark, sf).select("index", *[r6(normal(m)).alias(m) for m in MODES])


@query(sql("frames", f"{NORM} SELECT index, round((greatest(-5, least(5, value * qs - 1 - q01 * qs)) - (-1 - q01 * qs)) / qs, 6) + 0.0 AS value FROM frames, c"))
def fn_denormalize(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("quantile")
    return with_scales(spark, sf).select("index", r6(S.denormalize(normal("quantile"), q["scale"], q["offset"])).alias("value"))


@query(sql("vectors", "SELECT vec_id, CAST(i AS bigint) AS pos, round(atan2(sin(v[i + 1] * 40), cos(v[i + 1] * 40)), 6) + 0.0 AS x FROM vectors, LATERAL unnest(range(0, 64)) t(i)"))
def fn_wrap_angle(spark: SparkSession, sf: str) -> DataFrame:
    w = vectors(spark, sf).select("vec_id", F.posexplode(F.transform("v", lambda x: S.wrap_angle(x * 40))).alias("pos", "x"))
    return w.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@query(sql("eval_results", """s AS (SELECT trial, CAST(round_even(duration / (1 + trial % 300), 0) AS bigint) AS s FROM eval_results)
SELECT trial, CASE WHEN s < 60 THEN printf('%02ds', s) WHEN s < 3600 THEN printf('%02dm%02ds', CAST(floor(s / 60) AS bigint), s % 60)
ELSE printf('%02dh%02dm%02ds', CAST(floor(s / 3600) AS bigint), CAST(floor(s % 3600 / 60) AS bigint), s % 60) END AS text,
CASE WHEN x < 0.5 THEN '0.5s' WHEN x < 60 THEN concat(CAST(floor(x) AS bigint), '.5s') WHEN x < 3600 THEN printf('%d:%02d', CAST(floor(x / 60) AS bigint), CAST(floor(x) AS bigint) % 60)
ELSE printf('%d:%02d:%02d', CAST(floor(x / 3600) AS bigint), CAST(floor(x % 3600 / 60) AS bigint), CAST(floor(x) AS bigint) % 60) END AS clock FROM s JOIN (SELECT trial, floor(duration / (1 + trial % 300)) + 0.5::double AS x FROM eval_results) USING (trial)"""))
def fn_format_duration(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.col("duration") / (1 + F.col("trial") % 300)
    return eval_results(spark, sf).select("trial", S.format_duration(seconds).alias("text"), S.clock(F.floor(seconds) + 0.5).alias("clock"))


@query(sql("prompts", r"SELECT pos, substr(translate(lower(substr(text, 1, 200)), ' ' || chr(10) || '.', '___'), 1, 50) AS slug FROM prompts"))
def fn_slug(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("pos", S.slug(F.col("text")).alias("slug"))


@query(sql("log_lines", r"""SELECT run, regexp_extract(line, 'task=(\S+)', 1) AS task, regexp_extract(line, 'phase=(\S+)', 1) AS phase, CAST(regexp_extract(line, 'gpu=(\d+)', 1) AS int) AS gpu,
CAST(regexp_extract(line, 'success_rate=([0-9.]+)', 1) AS double) AS success_rate, NULL::bigint AS step, NULL::double AS loss, NULL::double AS lr FROM log_lines WHERE line_no % 9 <> 0
UNION ALL SELECT run, 'train', NULL, CAST(line_no % 7 AS int), NULL, line_no, CAST((line_no % 1000) / 8.0::double AS double), 0.0003 FROM log_lines
UNION ALL SELECT run, 'val', NULL, NULL, (line_no % 50) / 4.0::double, line_no, (line_no % 100) / 2.0::double, NULL FROM log_lines WHERE line_no % 4 = 0"""))
def fn_parse_log(spark: SparkSession, sf: str) -> DataFrame:
    done = result_records(spark, sf)
    return done.unionByName(trainer_records(spark, sf), allowMissingColumns=True)


def each_record(logs: DataFrame, records: Column) -> DataFrame:
    """(run, r) of each record of each log; of ``explode`` Spark would derive a filter that parses every log once more."""
    return logs.select("run", F.explode_outer(records).alias("r")).where(F.col("r").isNotNull())


def trainer_records(spark: SparkSession, sf: str) -> DataFrame:
    """Training and validation records of logs whose lines are wrapped."""
    n, eight = F.col("line_no"), lambda c: (c).cast("string")
    train = F.concat(F.lit("[train] epoch="), eight(n % 7), F.lit(" step="), eight(n), F.lit("/99999 eta=1h\n    loss="), eight((n % 1000) / 8.0), F.lit(" loss_action=0.5\n   grad=1 loss_video=0.25 speed=3\n lr=3e-4\n"))
    val = F.concat(F.lit("step="), eight(n), F.lit("\n   val_loss="), eight((n % 100) / 2.0), F.lit(" infer_psnr=20.5\n infer_ssim=0.75 action_l2="), eight((n % 50) / 4.0), F.lit("\n  action_l1=0.125\n"))
    text = F.concat(train, F.when(n % 4 == 0, val).otherwise(F.lit("saved\n")))
    logs = log_lines(spark, sf).groupBy("run", F.floor(n / 200).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", text.alias("t")))), lambda s: s["t"]), "").alias("log"))
    parsed = lambda kind: each_record(logs, S.parse_records(F.col("log"), kind)).select("run", F.lit(kind).alias("task"), "r.*")
    t = parsed("train").select("run", "task", F.col("epoch").cast("int").alias("gpu"), "step", "loss", "lr")
    return t.unionByName(parsed("val").select("run", "task", "step", F.col("val_loss").alias("loss"), F.col("action_l2").alias("success_rate")), allowMissingColumns=True)


def result_records(spark: SparkSession, sf: str) -> DataFrame:
    # a log holds ten lines of a run, some of them no results
    line = F.when(F.col("line_no") % 9 == 0, F.concat(F.lit("warn: "), F.substring("line", 6, 100))).otherwise(F.col("line"))
    logs = log_lines(spark, sf).groupBy("run", F.floor(F.col("line_no") / 200).alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    return each_record(logs, S.parse_log(F.col("log"))).select("run", "r.*")


@query(sql("log_lines", """SELECT line_no, CASE WHEN line_no % 3 = 0 THEN NULL ELSE CAST(line_no AS double) / 4 END AS value FROM log_lines"""))
def fn_last_number_line(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.col("line_no") % 3 != 0, F.concat(F.lit("7\n"), (F.col("line_no") / F.lit(4.0)).cast("string"))).otherwise(F.lit("none"))
    return log_lines(spark, sf).select("line_no", S.last_number_line(F.concat(F.lit("result\n"), number, F.lit("\n"), "line")).alias("value"))


@query(sql("eval_results", r"SELECT trial, CAST(regexp_extract(file_name, '_task(\d+)_', 1) AS int) AS task_id FROM eval_results"))
def fn_task_id_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return eval_results(spark, sf).select("trial", S.task_id_of(F.col("file_name")).alias("task_id"))


@query(sql("prompts", "SELECT pos, coalesce(translate(lower(trim(CASE WHEN pos % 7 = 0 THEN NULL ELSE '  ' || dataset || '-A-b ' END)), '-', '_'), 'meta') AS tag FROM prompts"))
def fn_normalize_tag(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("pos") % 7 != 0, F.concat(F.lit("  "), "dataset", F.lit("-A-b ")))
    return prompts(spark, sf).select("pos", S.normalize_tag(raw, "meta").alias("tag"))


@query(sql("vectors", """f AS (SELECT a.vec_id, i, 10 * log10(4.0::double / (list_sum(list_transform(range(i * 16 + 1, i * 16 + 17), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j]))) / 16 + 1e-8)) AS p
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1, LATERAL unnest(range(0, 4)) t(i)),
g AS (SELECT a.vec_id, 10 * log10(65025.0::double / greatest(1e-8, list_sum(list_transform(range(1, 65), lambda j: pow(floor(a.v[j] * 255) - CASE WHEN a.vec_id % 5 = 0 THEN floor(a.v[j] * 255) ELSE floor(b.v[j] * 255) END, 2))) / 64)) AS q FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(avg(p), 6) + 0.0 AS psnr, round(any_value(q), 6) AS psnr_8bit FROM f JOIN g USING (vec_id) GROUP BY vec_id"""))
def fn_psnr(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    frames_ = [S.psnr(F.slice("v", 16 * i + 1, 16), F.slice("w", 16 * i + 1, 16), 2.0) for i in range(4)]
    bytes_ = lambda c: F.transform(c, lambda x: F.floor(x * 255).cast("double"))
    same = F.when(F.col("vec_id") % 5 == 0, F.col("v")).otherwise(F.col("w"))  # equal frames reach the bound eps
    return p.select("vec_id", r6(sum(frames_[1:], frames_[0]) / 4).alias("psnr"), F.round(S.psnr_8bit(bytes_(F.col("v")), bytes_(same)), 6).alias("psnr_8bit"))


@query(sql("frames", """SELECT DISTINCT episode_index, printf('data/chunk-%03d/episode_%06d.parquet', CAST(floor(episode_index / 10) AS bigint), episode_index) AS data_path,
printf('data/chunk-%03d/file-%03d.parquet', CAST(floor(episode_index / 10) AS bigint), episode_index % 10) AS v3_path, printf('videos/chunk-%03d/%s/episode_%06d.mp4', CAST(floor(episode_index / 10) AS bigint), 'cam_high', episode_index) AS video_path FROM frames"""))
def fn_path_format(spark: SparkSession, sf: str) -> DataFrame:
    e, chunk = F.col("episode_index"), F.floor(F.col("episode_index") / 10)
    return frames(spark, sf).select("episode_index").distinct().select(
        e, S.data_path(chunk, e).alias("data_path"), S.data_path(chunk, e % 10, "v3.0").alias("v3_path"), S.video_path(chunk, F.lit("cam_high"), e).alias("video_path")
    )


@query(sql("frames", "SELECT index, concat('dataset=', source, ' episode=', episode_index, ' frame=', frame_index) AS described FROM frames"))
def fn_describe_source(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("index", S.describe_source(F.col("source"), F.col("episode_index"), F.col("frame_index")).alias("described"))
