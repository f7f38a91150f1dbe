"""Episode-level recipes: arm layouts, action encoders, audits, condition reports and metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrain.functions import geometry

#: Channel names of an arm.
EULER_CHANNELS = ("dx", "dy", "dz", "rx", "ry", "rz", "gripper")
SIX_CHANNELS = ("dx", "dy", "dz", "r1", "r2", "r3", "r4", "r5", "r6", "gripper")
STATE_CHANNELS = ("x", "y", "z", "qx", "qy", "qz", "qw", "gripper")


def channel_names(arms: list[str], channels: tuple[str, ...]) -> list[str]:
    """Names in storage order: arm by arm, with the arm in front where there are several."""
    return [f"{a}_{c}" if len(arms) > 1 else c for a in arms for c in channels]


def named_channels(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """A vector's channels as columns."""
    return df.select("*", *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)])


def both_arms(left: str, right: str) -> Column:
    """The arms' vectors as one; a missing arm fails."""
    there = F.col(left).isNotNull() & F.col(right).isNotNull()
    return F.when(there, F.concat(left, right)).otherwise(F.raise_error(F.lit("an arm is missing")).cast("array<double>"))


def per_arm(vector: str, width: int, arm: int) -> Column:
    return F.slice(vector, arm * width + 1, width)


def camera_roles(cameras: Column) -> Column:
    """struct(primary, left, right, wrist) of a list of camera names: by their words, the first one as primary if none says so."""
    named = lambda *words: F.get(F.filter(cameras, lambda c: F.lower(c).rlike("|".join(words))), 0)
    return F.struct(F.coalesce(named("front", "high", "top", "head"), F.get(cameras, 0)).alias("primary"), named("left").alias("left"), named("right").alias("right"), named("wrist", "hand").alias("wrist"))


def local_actions(df: DataFrame, position: str, quaternion: str, gripper: str, episode: str, order: list[str], scales: tuple[float, float, float], six: bool = False) -> DataFrame:
    """Adds `action`: the encoded step to the next frame's pose. The last frame repeats the action before it;
    the only frame of an episode gets the step to itself."""
    w = Window.partitionBy(episode).orderBy(*order)
    rows = df.withColumn("_m", geometry.quaternion_to_matrix(F.col(quaternion)))
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    rows = rows.withColumn("_p1", nxt(position)).withColumn("_m1", nxt("_m")).withColumn("_g1", nxt(gripper)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    delta = geometry.local_delta(F.col(position), F.col("_m"), F.col("_p1"), F.col("_m1"))
    rows = rows.withColumn("_d", delta).withColumn("_a", geometry.encode_action(F.col("_d"), F.col("_g1"), *scales, six=six))
    return rows.withColumn("action", F.when(F.col("_last"), F.coalesce(F.lag("_a").over(w), F.col("_a"))).otherwise(F.col("_a"))).drop("_m", "_p1", "_m1", "_g1", "_last", "_d", "_a")


def absolute_actions(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("action", F.col(vector))


def paired_actions(df: DataFrame, position: str, quaternion: str, target_position: str, target_quaternion: str, gripper: str, scales: tuple[float, float, float], six: bool = False) -> DataFrame:
    """Adds `action`: the encoded step from a frame's pose to the target pose of the same frame."""
    start, end = geometry.quaternion_to_matrix(F.col(quaternion)), geometry.quaternion_to_matrix(F.col(target_quaternion))
    delta = geometry.local_delta(F.col(position), start, F.col(target_position), end)
    return df.withColumn("_d", delta).withColumn("action", geometry.encode_action(F.col("_d"), F.col(gripper), *scales, six=six)).drop("_d")


def joint_actions(df: DataFrame, joints: str, target_joints: str, chain: list[dict], gripper: str, scales: tuple[float, float, float], six: bool = False) -> DataFrame:
    """Adds `action`: the encoded step from the pose that a frame's joints give to the one that its target joints give."""
    rows = df.withColumn("_a", geometry.forward_kinematics(F.col(joints), chain)).withColumn("_b", geometry.forward_kinematics(F.col(target_joints), chain))
    delta = geometry.local_delta(F.col("_a.position"), F.col("_a.rotation"), F.col("_b.position"), F.col("_b.rotation"))
    return rows.withColumn("_d", delta).withColumn("action", geometry.encode_action(F.col("_d"), F.col(gripper), *scales, six=six)).drop("_a", "_b", "_d")


#: How actions are made, by what they are made from and how they are encoded.
STRATEGIES = {(name, kind): (lambda df, f=f, kind=kind, **k: f(df, six=kind == "six", **k)) for name, f in (("next_pose", local_actions), ("same_frame", paired_actions), ("joints", joint_actions)) for kind in ("euler", "six")}
ENCODERS = {"euler": STRATEGIES["next_pose", "euler"], "six": STRATEGIES["next_pose", "six"], "absolute": absolute_actions}


def proprio(df: DataFrame, position: str, quaternion: str, gripper: str, episode: str, order: list[str], low: list[float], high: list[float]) -> DataFrame:
    """Adds `proprio`: position, sign-continuous unit quaternion and gripper, scaled to [-1, 1]; a value that is not finite fails."""
    from framegrain.operators import frames, stats

    rows = frames.continuous_quaternions(df.withColumn("_q", F.col(quaternion)), "_q", episode, order)
    v = stats.scale_minmax(F.concat(position, "_q", F.array(gripper)), low, high)
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    checked = F.when(F.exists("_v", wrong), F.raise_error(F.lit("proprio is not finite")).cast("array<double>")).otherwise(F.col("_v"))
    return rows.withColumn("_v", v).withColumn("proprio", checked).drop("_q", "_v")


def first_episode_bounds(df: DataFrame, vector: str, episode: str, order: str, most: int = 5) -> DataFrame:
    """(channel, n, min, max, mean, std) over the first `most` episodes in order only: a quick estimate."""
    from framegrain.operators import stats

    few = df.groupBy(episode).agg(F.min(order).alias("_o")).orderBy("_o", episode).limit(most).select(episode)
    return stats.channel_stats(df.join(F.broadcast(few), episode, "left_semi"), vector, [])  # at most `most` rows


def arm_report(df: DataFrame, predicted: str, target: str, threshold: float = 0.5, at=(1, 4, 8, 16), keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of one arm's errors over all frames of all chunks (arrays of ten channels), the share of grippers on the right
    side of the threshold, and the errors of the frames at each of the places `at`."""
    side = lambda v: F.element_at(v, -1) >= threshold
    # The errors are made before the frames become rows: an aggregation would ask for them once for each of its columns.
    each = F.transform(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t")), lambda v: F.struct(arm_errors(v["p"], v["t"]).alias("e"), (side(v["p"]) == side(v["t"])).alias("ok")))
    rows = df.select(*keys, F.posexplode(each).alias("_k", "_v")).select(*keys, "_k", F.col("_v.e").alias("_e"), F.col("_v.ok").alias("_ok"))
    names = ("translation", "rotation_degrees", "gripper")
    cols = [F.avg(f"_e.{n}").alias(n) for n in names] + [F.avg(F.col("_ok").cast("double")).alias("gripper_accuracy")]
    cols += [F.avg(F.when(F.col("_k") == h - 1, F.col(f"_e.{n}"))).alias(f"{n}_at_{h}") for h in at for n in names]
    return rows.groupBy(*keys).agg(*cols)


def arm_errors(predicted: Column, target: Column) -> Column:
    """struct(translation, rotation_degrees, gripper) errors of one arm's ten channels."""
    def errors(v: Column) -> Column:
        p, t = v["p"], v["t"]
        gap = F.aggregate(F.zip_with(F.slice(p, 1, 3), F.slice(t, 1, 3), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 3
        turn = geometry.angle_between(geometry.six_to_matrix(F.slice(p, 4, 6)), geometry.six_to_matrix(F.slice(t, 4, 6)))
        return F.struct(gap.alias("translation"), turn.alias("rotation_degrees"), F.abs(F.element_at(p, -1) - F.element_at(t, -1)).alias("gripper"))

    return geometry.together(errors, p=predicted, t=target)


def loss_masks(kind: Column, table: dict[str, list[bool]]) -> Column:
    """The mask over positions for each kind of sample; an unknown kind fails."""
    out = None
    for name, mask in table.items():
        out = (F if out is None else out).when(kind == name, F.array(*[F.lit(bool(m)) for m in mask]))
    return out.otherwise(F.raise_error(F.concat(F.lit("no mask for "), kind)).cast("array<boolean>"))


#: Places of the action and the value among nine positions of a sample; the four before the action are what is seen.
ACTION_AT, VALUE_AT, POSITIONS = 4, 8, 9
#: What an inverse-dynamics sample is shown.
SHOWN = ("normal", "current_only", "future_only", "future_shuffle")


def temporal_masks(kind: Column, shown: str = "normal") -> Column:
    """struct(condition, loss) over the nine positions for `policy`, `world`, `value` and `inverse_dynamics` samples.

    What is seen is no target. World samples see the action too, value samples all before the value. Inverse dynamics
    sees what comes before and after the action (or one of them, by `shown`) and has the action as its only target.
    """
    if shown not in SHOWN:
        raise ValueError(f"shown is one of {SHOWN}")
    seen = lambda *places: [i in places for i in range(POSITIONS)]
    past, future = range(ACTION_AT), range(ACTION_AT + 1, VALUE_AT)
    both = seen(*(past if shown != "future_only" else ()), *(future if shown != "current_only" else ()))
    condition = {"policy": seen(*past), "world": seen(*past, ACTION_AT), "value": seen(*range(VALUE_AT)), "inverse_dynamics": both}
    loss = {k: [not m for m in c] for k, c in condition.items()} | {"inverse_dynamics": seen(ACTION_AT)}
    return F.struct(loss_masks(kind, condition).alias("condition"), loss_masks(kind, loss).alias("loss"))


def without_failed_actions(loss: Column, kind: Column, failed: Column) -> Column:
    """A loss mask in which the action of a failed policy sample is no target; a null `failed` counts as not failed."""
    return F.when((kind == "policy") & F.coalesce(failed, F.lit(False)), F.transform(loss, lambda m, i: m & (i != ACTION_AT))).otherwise(loss)


def series_columns(df: DataFrame, features: dict[str, dict], time: str = "timestamp") -> tuple[DataFrame, list[str]]:
    """The time and each channel of the float32 and int32 features as columns; and the features of more dimensions, left out.

    features: {name: {"dtype", "shape", "names"}}. Names are a list, or nested by what they name, when the first list inside
    counts; without any a channel is called {feature}_{place}. A feature of another type, and the time, have no columns.
    """
    columns, left = [F.col(time)], []
    for name, f in features.items():
        if f["dtype"] not in ("float32", "int32") or name == time:
            continue
        if len(f["shape"]) > 1:
            left.append(name)
            continue
        names = f.get("names")
        while names and not isinstance(names, (list, tuple)):
            names = next(iter(names.values()))
        n = f["shape"][0] if f["shape"] else 1
        names = list(names) if names else [f"{name}_{i}" for i in range(n)]
        if len(names) != n:
            raise ValueError(f"{name} has {n} channels and {len(names)} names")
        vector = str(df.schema[name].dataType.typeName()) == "array"
        columns += [(F.get(f"`{name}`", F.lit(i)) if vector else F.col(f"`{name}`")).alias(c) for i, c in enumerate(names)]
    return df.select(*columns), left


def reward_counts(df: DataFrame, episode: str, reward: str, threshold: float) -> DataFrame:
    """(episode, positive, negative): frames above the threshold, and the others."""
    up = F.col(reward) > threshold
    return df.groupBy(episode).agg(F.sum(up.cast("long")).alias("positive"), F.sum((~up).cast("long")).alias("negative"))


def single_frame_episodes(df: DataFrame, keep: Column, episode: str, order: list[str], numbering) -> DataFrame:
    """Kept frames, each an episode of one frame. numbering gives a dense index over the kept rows."""
    return numbering(df.filter(keep)).withColumn("frame_index", F.lit(0).cast("long"))


def source_fps(df: DataFrame, seconds: str, episode: str, order: list[str]) -> DataFrame:
    """(episode, fps): the inverse of the median positive step, rounded to whole numbers, halves to even."""
    step = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(episode).orderBy(*order))
    return df.withColumn("_s", step).filter("_s > 0").groupBy(episode).agg(F.rint(1 / F.percentile("_s", 0.5)).cast("long").alias("fps"))


def first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the most frequent value, of equally frequent ones the first to appear."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_f"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_f"))).alias(value))


def task_table(df: DataFrame, episode: str, text: str, order: str, wrapper: str = "^[\\[\\(\"']+|[\\]\\)\"']+$") -> DataFrame:
    """(episode, tasks): indexes of an episode's distinct texts, stripped of wrappers, dense in order of first appearance."""
    from framegrain.operators.frames import first_seen_codes

    rows = df.withColumn("_t", F.trim(F.regexp_replace(text, wrapper, "")))
    return rows.join(first_seen_codes(rows, "_t", order), "_t").groupBy(episode).agg(F.array_sort(F.collect_set("code")).alias("tasks"))


def condition_report(df: DataFrame, keys: list[str], metrics: list[str], count: str) -> DataFrame:
    """Weighted means of metrics for each condition, with the summed count."""
    n = F.sum(count)
    return df.groupBy(*keys).agg(n.alias(count), *[(F.sum(F.col(m) * F.col(count)) / n).alias(m) for m in metrics])


def metric_series(long: DataFrame, metric: str, modes: list[str], support: dict[str, float] | None = None) -> DataFrame:
    """(mode, global_step, value) of a metric of (mode, global_step, metric, value) rows, finite values in order of
    steps; steps at which a supporting count is zero are left out."""
    rows = long.filter((F.col("metric") == metric) & F.col("mode").isin(modes) & ~F.isnan("value") & (F.abs("value") < float("inf")))
    for name in support or {}:
        empty = long.filter((F.col("metric") == name) & (F.col("value") == 0)).select("mode", "global_step").distinct()
        rows = rows.join(empty, ["mode", "global_step"], "left_anti")
    return rows.select("mode", "global_step", "value").orderBy("mode", "global_step")


def latest_report(df: DataFrame, step: str, keys: str, position: str) -> DataFrame:
    """The row of the largest step; of those the one with the most keys, then the first."""
    return df.orderBy(F.desc(step), F.desc(keys), F.asc(position)).limit(1)


def array_difference(a: Column, b: Column) -> Column:
    """struct(mae, max_abs, rmse, different) of two aligned arrays."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    total = lambda f: F.aggregate(d, F.lit(0.0), lambda s, x: s + f(x)) / F.size(d)
    return F.struct(total(lambda x: x).alias("mae"), F.array_max(d).alias("max_abs"), F.sqrt(total(lambda x: x * x)).alias("rmse"), F.size(F.filter(d, lambda x: x != 0)).alias("different"))


def peer_issues(df: DataFrame, key: str, side: str, length: str) -> DataFrame:
    """(key, issue): recordings whose left or right peer is missing or of another length."""
    a = df.filter(F.col(side) == "left").select(key, F.col(length).alias("_l"))
    b = df.filter(F.col(side) == "right").select(key, F.col(length).alias("_r"))
    issue = F.when(F.col("_r").isNull(), "right missing").when(F.col("_l").isNull(), "left missing").when(F.col("_l") != F.col("_r"), "lengths differ")
    return a.join(b, key, "full_outer").select(key, issue.alias("issue")).filter("issue is not null")


def structural_similarity(df: DataFrame, keys: list[str], a: str, b: str, width: int, window: int = 7) -> DataFrame:
    """(keys, ssim): mean structural similarity over sliding windows of two images in [0, 1], flat arrays of rows."""
    schema = df.select(*keys).schema.add("ssim", T.DoubleType())

    def task(batches):
        import numpy as np

        def blurred(x):
            c = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
            return (c[window:, window:] - c[:-window, window:] - c[window:, :-window] + c[:-window, :-window]) / window**2

        def one(x, y):
            x, y = np.asarray(x, float).reshape(-1, width), np.asarray(y, float).reshape(-1, width)
            mx, my = blurred(x), blurred(y)
            vx, vy, vxy = blurred(x * x) - mx**2, blurred(y * y) - my**2, blurred(x * y) - mx * my
            return float((((2 * mx * my + 1e-4) * (2 * vxy + 9e-4)) / ((mx**2 + my**2 + 1e-4) * (vx + vy + 9e-4))).mean())

        for pdf in batches:
            yield pdf[keys].assign(ssim=[one(x, y) for x, y in zip(pdf[a], pdf[b], strict=True)])

    return df.select(*keys, a, b).mapInPandas(task, schema)


def position_differences(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, position, total, n, max_abs, different): two streams of arrays compared at each position, row by row."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("position", "_v"))
    gap = F.abs(F.col("_v.a") - F.col("_v.b"))
    return rows.groupBy(*keys, "position").agg(F.sum(gap).alias("total"), F.count(gap).alias("n"), F.max(gap).alias("max_abs"), F.sum((gap != 0).cast("long")).alias("different"))


def kinematics_error(df: DataFrame, joints: str, recorded: str, chain: list[dict], episode: str, order: list[str], most: int = 200) -> DataFrame:
    """(episode, frames, max_error, mean_error): distance of the chain's end from the recorded position, over at most `most` evenly spaced frames."""
    from framegrain.operators.frames import evenly_spaced

    rows = evenly_spaced(df, episode, order, F.least(F.lit(most).cast("long"), F.col("episode_length")))
    gap = geometry.norm(geometry.minus(geometry.forward_kinematics(F.col(joints), chain)["position"], F.col(recorded)))
    return rows.withColumn("_e", gap).groupBy(episode).agg(F.count(F.lit(1)).alias("frames"), F.max("_e").alias("max_error"), F.avg("_e").alias("mean_error"))
