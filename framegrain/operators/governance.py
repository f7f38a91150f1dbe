"""Inventories, issues, severities, move plans and comparisons of dataset-governance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegrain.session import stored

#: From best to worst.
SEVERITIES = ("passed", "warning", "review", "quarantine", "unreadable")


def inventory(value: str, episode: str, bytes_: str) -> list[Column]:
    """Aggregates of a roll-up: counts, lengths, bytes."""
    v = F.col(value)
    return [
        F.count(F.lit(1)).alias("files"), F.countDistinct(episode).alias("episodes"), F.sum(v).alias("total"), F.min(v).alias("shortest"), F.max(v).alias("longest"),
        F.avg(v).alias("average"), F.sum(v.isNull().cast("long")).alias("missing"), F.sum(bytes_).alias("bytes"),
    ]


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """The aggregates over each set of keys, with grouping_id; keys outside a set are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("grouping_id"), *aggregates)


def issues(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def severity(issue_list: Column, ranks: dict[str, str], default: str = "review") -> Column:
    """The worst severity of a list of issues; `passed` for none."""
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(SEVERITIES.index(v)))])
    worst = F.array_max(F.transform(issue_list, lambda i: F.coalesce(table[i], F.lit(SEVERITIES.index(default)))))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.coalesce(worst, F.lit(0)) + 1)


def worst_by_group(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(status))
    return df.groupBy(*keys).agg(F.max_by(status, rank).alias(status), F.count(F.lit(1)).alias("n"))


def baseline(df: DataFrame, family: str, schema_id: str) -> DataFrame:
    """(family, baseline, n): the schema with the most files, the larger id on a tie."""
    counts = df.groupBy(family, schema_id).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(family).agg(F.max_by(schema_id, F.struct("n", schema_id)).alias("baseline"), F.max("n").alias("n"))


def signal_changes(schemas: DataFrame, base: DataFrame, family: str, schema_id: str, signals: str) -> DataFrame:
    """(family, schema_id, added, missing) against the family's baseline schema."""
    mine = schemas.join(base.select(family, "baseline"), family)
    ref = schemas.select(F.col(family).alias("_f"), F.col(schema_id).alias("_s"), F.col(signals).alias("_ref"))
    both = mine.join(ref, (F.col(family) == F.col("_f")) & (F.col("baseline") == F.col("_s")))
    return both.select(family, schema_id, F.array_sort(F.array_except(signals, "_ref")).alias("added"), F.array_sort(F.array_except("_ref", signals)).alias("missing"))


def duplicates(df: DataFrame, keys: list[str], names: str) -> DataFrame:
    """(keys, n, first) for keys that occur twice or more."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(names).alias("first")).filter("n > 1")


def homogeneous(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column whether it has one value."""
    return df.agg(*[(F.count_distinct(c) == 1).alias(c) for c in columns])


def move_plan(files: DataFrame, batch: str, episode: str, schema_id: str, bucket: str, movable: str) -> tuple[DataFrame, DataFrame]:
    """(plan, conflicts). A batch moves as one unit if all its files are movable and share schema and bucket;
    else its episodes move, each under the same condition; what is left is a conflict."""
    one = lambda: (F.count_distinct(schema_id) == 1) & (F.count_distinct(bucket) == 1) & F.bool_and(movable)
    batches = files.groupBy(batch).agg(one().alias("whole"))
    whole = files.join(batches.filter("whole"), batch).groupBy(batch).agg(F.lit(None).cast("string").alias(episode), F.count(F.lit(1)).alias("files"), F.first(schema_id).alias(schema_id)).withColumn("unit", F.lit("batch"))
    parts = files.join(batches.filter("not whole"), batch).groupBy(batch, episode).agg(one().alias("whole"), F.count(F.lit(1)).alias("files"), F.first(schema_id).alias(schema_id))
    split = parts.filter("whole").drop("whole").withColumn("unit", F.lit("episode")).withColumn(episode, F.col(episode).cast("string"))
    return whole.unionByName(split), parts.filter("not whole").drop("whole")


def verified(plan: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status, differs): planned totals against what is found after a move."""
    there = found.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns])
    out = plan.join(there, key, "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_f_{c}")), F.lit(c)) for c in columns]))
    return out.select(key, differs.alias("differs")).withColumn("status", F.when(F.size("differs") == 0, "verified").otherwise("failed"))


def changed(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): only_left, only_right or changed."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).filter("change is not null")


def differing_fields(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fields): the columns in which rows of equal key differ."""
    a = left.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    fields = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    return a.join(b, key).select(key, fields.alias("fields")).filter(F.size("fields") > 0)


def index_gaps(df: DataFrame, index: str) -> DataFrame:
    """(index, n, problem): duplicated indexes, and those after which one is missing."""
    counts = df.groupBy(index).agg(F.count(F.lit(1)).alias("n"))
    nxt = counts.select((F.col(index) - 1).alias(index), F.lit(True).alias("_next"))
    top = counts.agg(F.max(index).alias("_top"))
    out = counts.join(nxt, index, "left").crossJoin(F.broadcast(top))
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("_next").isNull() & (F.col(index) < F.col("_top")), "gap after")
    return out.select(index, "n", problem.alias("problem")).filter("problem is not null")


def vector_contract(vector: str, size: int) -> dict[str, Column]:
    """Rules for a fixed-size vector column: presence, size, finite values."""
    v = F.col(vector)
    return {
        f"{vector} missing": v.isNull(),
        f"{vector} has wrong size": v.isNotNull() & (F.size(v) != size),
        f"{vector} not finite": F.coalesce(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)),
    }


def status_counts(journal: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(status, n) over the latest row of each key."""
    return journal.groupBy(key).agg(F.max_by(status, order).alias(status)).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


#: What a journal row may turn into.
TRANSITIONS = {"planned": ("moving",), "moving": ("moved", "failed"), "moved": ("verified", "failed"), "failed": ("moving",), "verified": ()}


def illegal_transitions(journal: DataFrame, key: str, order: str, status: str) -> DataFrame:
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    rows = journal.withColumn("before", before).filter("before is not null")
    return rows.filter(~F.array_contains(pairs, F.concat("before", F.lit(">"), F.col(status)))).select(key, order, "before", status)


def recovered(source_there: Column, destination_there: Column) -> Column:
    """State of an interrupted move from what exists."""
    return F.when(source_there & ~destination_there, "planned").when(~source_there & destination_there, "moved").when(source_there & destination_there, "conflict").otherwise("lost")


def schema_catalog(df: DataFrame, schema_id: str, family: str, station: str, task: str, status: str, path: str) -> DataFrame:
    """(family, schema_id, files, stations, tasks, passed, representative): what each schema's files are like, most files first."""
    out = df.groupBy(family, schema_id).agg(
        F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set(station)).alias("stations"), F.count_distinct(task).alias("tasks"),
        F.sum((F.col(status) == "passed").cast("long")).alias("passed"), F.min(path).alias("representative"),
    )
    return out.orderBy(F.desc("files"), schema_id)


def family_rollup(catalog: DataFrame, family: str) -> DataFrame:
    """(family, schemas, files, stations): the catalogue's schemas by family."""
    return catalog.groupBy(family).agg(F.count(F.lit(1)).alias("schemas"), F.sum("files").alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("stations")))).alias("stations"))


def stats_contract(low: str, high: str, std: str, span: float = 1e-8) -> dict[str, Column]:
    """Rules for a channel's statistics: there, finite, and a range above `span`."""
    cols = [F.col(c) for c in (low, high, std)]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return {
        "missing": cols[0].isNull() | cols[1].isNull() | cols[2].isNull(),
        "not finite": F.coalesce(bad(cols[0]) | bad(cols[1]) | bad(cols[2]), F.lit(False)),
        "constant": F.coalesce(cols[1] - cols[0] < span, F.lit(False)),
    }


# --- documents of metadata and configuration ---------------------------------------------------------------


def document_issues(docs: DataFrame, name: str, document: str, values: dict[str, str], lengths: dict[str, int], only: Column | None = None) -> DataFrame:
    """(name, issue): JSON documents whose fields are not as they should be.

    values: {path: text that the field must have}, as `$.action.encoding`; a number's text is its JSON. lengths: {path, or paths
    with `|` between them of which the first that is there counts: length that the list must have}. only: which documents are
    looked at, a condition on `_doc`. A document that is null, or no JSON, has the one issue "no document".
    """
    rows = docs.select(name, F.when(F.schema_of_variant(F.try_parse_json(document)).isNotNull(), F.col(document)).alias("_doc"))
    if only is not None:
        rows = rows.filter(only)
    field = lambda path: F.get_json_object("_doc", path)
    found = []
    for path, want in values.items():
        is_ = field(path)
        found.append(F.when(~is_.eqNullSafe(F.lit(want)), F.concat(F.lit(f"{path[2:]} is "), F.coalesce(is_, F.lit("missing")), F.lit(f", not {want}"))))
    for paths, n in lengths.items():
        held = F.coalesce(*[F.json_array_length(field(p)) for p in paths.split("|")])
        found.append(F.when(~held.eqNullSafe(F.lit(n)), F.lit(f"{paths.split('|')[0][2:]} has not {n} values")))
    issue = F.when(F.col("_doc").isNull(), F.array(F.lit("no document"))).otherwise(F.array_compact(F.array(*found)))
    return rows.select(name, F.explode(issue).alias("issue"))


#: What a training configuration is made of, as far as it is checked.
CONFIG = """struct<training: struct<batch_size_per_rank: bigint, gradient_accumulation_steps: bigint, validation_every_steps: bigint, validation_every_epochs: bigint>,
data: struct<root: string, layout: string, workers_per_rank: bigint, prefetch_factor: bigint>, model: struct<checkpoint_path: string, tokenizer_path: string>,
objectives: struct<training_mode: string, policy_auxiliary_targets: boolean, loss_reduction: string, policy_probability: double, world_probability: double, value_probability: double, inverse_dynamics_probability: double>,
split: struct<max_episodes: bigint, ratios: array<double>>, evaluation: struct<protocol: string, sigma_values: array<double>, objectives: array<string>, step_validation_max_batches: bigint, step_validation_objectives: array<string>>>"""
#: Modes of training and what each of them may be evaluated on.
MODES = ("policy_only", "inverse_dynamics_only", "base_joint", "joint_with_inverse", "custom_mix")
TARGETS = ("policy", "world", "value", "inverse_dynamics")


def training_rules(c: Column) -> dict[str, Column]:
    """{issue: whether a configuration of type CONFIG has it}; what is missing has its default."""
    at = lambda part, field, default: F.coalesce(c[part][field], F.lit(default))
    mode, protocol = at("objectives", "training_mode", ""), at("evaluation", "protocol", "fixed_suite")
    shares = [at("objectives", f"{t}_probability", 0.0) for t in TARGETS]
    ratios, sigmas = c["split"]["ratios"], c["evaluation"]["sigma_values"]
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    unified, every = at("data", "layout", "") == "unified", at("training", "validation_every_steps", 0)
    known = lambda list_: F.forall(list_, lambda x: x.isin(*TARGETS))
    steps = c["evaluation"]["step_validation_objectives"]
    none = lambda v: F.coalesce(v, F.lit("")) == ""
    return {
        "no model checkpoint": none(c["model"]["checkpoint_path"]), "no tokenizer": none(c["model"]["tokenizer_path"]), "no data root": none(c["data"]["root"]),
        "batch size below 1": at("training", "batch_size_per_rank", 0) < 1, "accumulation below 1": at("training", "gradient_accumulation_steps", 0) < 1,
        "validation steps below 0": every < 0, "validation epochs below 0": at("training", "validation_every_epochs", 1) < 0,
        "workers below 0": at("data", "workers_per_rank", -1) < 0, "prefetch below 1": at("data", "prefetch_factor", 0) < 1,
        "unknown mode": ~F.trim(mode).isin(*MODES), "policy without auxiliary targets": (F.trim(mode) == "policy_only") & ~at("objectives", "policy_auxiliary_targets", False),
        "unknown reduction": ~at("objectives", "loss_reduction", "masked_mean").isin("masked_mean", "learner_actor_full_tensor_mean"),
        "shares are no distribution": (F.trim(mode) == "custom_mix") & (F.least(*shares) < 0) | (F.trim(mode) == "custom_mix") & (F.abs(sum(shares[1:], shares[0]) - 1) > 1e-6),
        "too few episodes": (at("split", "max_episodes", 0) < 0) | unified & (at("split", "max_episodes", 0) < 2),
        "ratios are no three shares": unified & F.coalesce((F.size(ratios) != 3) | (F.array_min(ratios) < 0) | (F.abs(total(ratios) - 1) > 1e-6), F.lit(True)),
        "train or validation is empty": unified & F.coalesce((F.get(ratios, F.lit(0)) <= 0) | (F.get(ratios, F.lit(1)) <= 0), F.lit(False)),
        "unknown protocol": ~protocol.isin("fixed_suite", "learner_actor"),
        "no sigmas within 0 and 1": (protocol == "fixed_suite") & F.coalesce((F.size(sigmas) == 0) | ~F.forall(sigmas, lambda x: (x > 0) & (x <= 1)), F.lit(True)),
        "protocol needs policy_only": (protocol == "learner_actor") & (F.trim(mode) != "policy_only"),
        "unknown targets of evaluation": c["evaluation"]["objectives"].isNotNull() & F.coalesce((F.size(c["evaluation"]["objectives"]) == 0) | ~known(c["evaluation"]["objectives"]), F.lit(True)),
        "step validation without batches": (every > 0) & (protocol == "fixed_suite") & (at("evaluation", "step_validation_max_batches", 0) < 1),
        "step validation without targets": (every > 0) & (protocol == "fixed_suite") & F.coalesce((F.size(steps) == 0) | ~known(steps), F.lit(True)),
    }


def config_issues(configs: DataFrame, name: str, document: str) -> DataFrame:
    """(name, issue): training configurations, as JSON, that break a rule; one that is no JSON object is "no configuration"."""
    rows = configs.select(name, F.from_json(document, CONFIG).alias("_c"), F.coalesce(F.trim(document).startswith("{") & F.try_parse_json(document).isNotNull(), F.lit(False)).alias("_ok"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(issue)) for issue, broken in training_rules(F.col("_c")).items()]))
    return rows.select(name, F.explode(F.when(F.col("_ok"), found).otherwise(F.array(F.lit("no configuration")))).alias("issue"))


# --- trees of schemas --------------------------------------------------------------------------------------


def tree_digests(nodes: DataFrame, file: str = "file", path: str = "path", what: str = "what", separator: str = "/") -> DataFrame:
    """(file, path, nodes, digest) of every node of every file's tree: equal digests are equal subtrees, wherever they are.

    nodes: (file, path, what), one row a group or dataset with a text that describes it; parents that have no row are groups
    without a description, and the root is the empty path. A digest is over what the node is and the names and digests of its
    children, made level by level from the deepest; no tree is ever held whole or compared.
    """
    parts = F.filter(F.split(path, separator), lambda p: p != "")
    own = nodes.select(file, parts.alias("_p"), F.coalesce(F.col(what), F.lit("")).alias("_w"))
    above = own.select(file, F.explode(F.transform(F.sequence(F.lit(0), F.size("_p")), lambda n: F.slice("_p", 1, n))).alias("_p"))
    every = above.distinct().join(own.groupBy(file, "_p").agg(F.array_join(F.array_sort(F.collect_list("_w")), "\n").alias("_w")), [file, "_p"], "left")
    every = stored(every.select(file, "_p", F.size("_p").alias("_depth"), F.coalesce("_w", F.lit("")).alias("_w")), "nodes")
    deepest = every.agg(F.coalesce(F.max("_depth"), F.lit(-1))).first()[0]
    done, below = None, None
    for depth in range(deepest, -1, -1):
        level = every.filter(F.col("_depth") == depth)
        if below is not None:
            children = below.groupBy(file, F.slice("_p", F.lit(1), F.lit(depth)).alias("_p")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("_p", -1).alias("n"), F.col("digest").alias("d")))).alias("_c"), F.sum("nodes").alias("_n"))
            level = level.join(children, [file, "_p"], "left")
        else:
            level = level.withColumn("_c", F.lit(None).cast("array<struct<n:string,d:string>>")).withColumn("_n", F.lit(None).cast("long"))
        inside = F.transform(F.coalesce("_c", F.array().cast("array<struct<n:string,d:string>>")), lambda c: F.concat(F.lit("\n"), c["n"], F.lit("\t"), c["d"]))
        level = level.select(file, "_p", F.sha2(F.concat(F.col("_w"), F.array_join(inside, "")), 256).alias("digest"), (1 + F.coalesce("_n", F.lit(0))).alias("nodes"))
        below = stored(level, "digests")
        done = below if done is None else done.unionByName(below)
    if done is None:
        return every.select(file, F.lit("").alias("path"), F.lit(0).cast("long").alias("nodes"), F.lit("").alias("digest"))
    return done.select(file, F.array_join("_p", separator).alias("path"), "nodes", "digest")
