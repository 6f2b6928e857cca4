"""Label spaces: how native ids of datasets become channels of a protocol or a model.

Dimension tables (all small): ``stored(dataset, native_id, native_label)``,
``aliases(dataset, native_label, label)``, ``drops(dataset, native_label)``,
``protocol(channel, label)`` and ``model(model_id, label)``, channel and model id 0 being
background.  Compilations are joins over them; applying a table to pixels stays in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.arrays import bind, bind_fields, sequence0
from maskframe.operators.stacks import merged_arrays

BACKGROUND = "background"


def resolve_datasets(requested: DataFrame, aliases: DataFrame) -> DataFrame:
    """requested(dataset) with ``canonical``, by aliases(alias, canonical)."""
    return requested.join(aliases.withColumnRenamed("alias", "dataset"), "dataset", "left").withColumn("canonical", F.coalesce("canonical", "dataset"))


def explain_labels(stored: DataFrame, aliases: DataFrame, drops: DataFrame, protocol: DataFrame) -> DataFrame:
    """dataset, native_id, native_label, rule, channel, label: background before drop before alias before identity.

    Drops and background go to channel 0.  A label that the protocol lacks has a null channel.
    """
    rules = (
        stored.join(drops.select("dataset", "native_label", F.lit(True).alias("dropped")).distinct(), ["dataset", "native_label"], "left")
        .join(aliases.select("dataset", "native_label", F.col("label").alias("alias")), ["dataset", "native_label"], "left")
    )
    rule = (
        F.when(F.col("native_label") == BACKGROUND, "background").when(F.col("dropped"), "drop").when(F.col("alias").isNotNull(), "alias").otherwise("identity")
    )
    label = F.when(rule.isin("background", "drop"), F.lit(BACKGROUND)).otherwise(F.coalesce("alias", "native_label"))
    ruled = rules.select("dataset", "native_id", "native_label", rule.alias("rule"), label.alias("label"))
    return ruled.join(protocol, "label", "left").select("dataset", "native_id", "native_label", "rule", "channel", "label")


def compile_luts(explained: DataFrame) -> DataFrame:
    """dataset, lut: the channel of each native id from 0, -1 for ids not stored; unknown labels raise."""
    known = F.coalesce("channel", F.raise_error(F.concat(F.lit("label not in protocol: "), F.col("label"))).cast("int"))
    by_id = explained.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("native_id", known))).alias("m"), F.max("native_id").alias("last"))
    return by_id.select("dataset", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias("lut"))


def remap_to_model(explained: DataFrame, model: DataFrame) -> DataFrame:
    """The explanation with ``model_id``: labels outside the model's become background."""
    return explained.join(model, "label", "left").withColumn("model_id", F.coalesce("model_id", F.lit(0)))


def apply_lut(labels: str | Column, lut: str | Column, unmapped: str = "raise") -> Column:
    """Gather ``lut[label]`` over an array of labels; ids outside or at -1 raise, or count as background."""
    labels, lut = (F.col(x) if isinstance(x, str) else x for x in (labels, lut))
    bad = F.raise_error("label id without a mapping").cast("int") if unmapped == "raise" else F.lit(0)
    found = lambda x: F.when(x >= 0, F.get(lut, x.cast("int")))
    return F.transform(labels, lambda x: F.when(F.coalesce(found(x), F.lit(-1)) < 0, bad).otherwise(found(x)))


def one_hot(labels: str | Column, classes: int) -> Column:
    """Channels of an array of labels: [class][pixel] of 0 and 1."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.transform(sequence0(classes), lambda c: F.transform(labels, lambda x: F.when(x == c, 1.0).otherwise(0.0)))


def background_complement(channels: str | Column) -> Column:
    """[class][pixel] with channel 0 set to 1 where no other channel is positive; a single channel is all 1."""
    channels = F.col(channels) if isinstance(channels, str) else channels

    def completed(s: Column) -> Column:
        background = F.transform(sequence0(s["pixels"]), lambda i: F.when(F.exists(s["rest"], lambda c: F.get(c, i) > 0), 0.0).otherwise(1.0))
        return F.concat(F.array(background), s["rest"])

    return bind(channels, lambda m: bind_fields(completed, pixels=F.size(F.get(m, F.lit(0))), rest=F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))))


def project_labels(labels: str | Column, lut: str | Column, classes: int) -> Column:
    """Dense native labels to model channels with a complementary background."""
    return background_complement(bind(apply_lut(labels, lut), lambda native: one_hot(native, classes)))


def project_channels(channels: DataFrame, names: DataFrame, target: DataFrame) -> DataFrame:
    """Named channels onto target channels; several of one name merge by the largest value.

    channels(sample_id, label, data array), names(label, target_label), target(channel, label);
    names without a target are left out, targets without a source are not made (they are 0).
    """
    named = channels.join(names, "label", "left").withColumn("label", F.coalesce("target_label", "label")).join(target, "label")
    return merged_arrays(named, ["sample_id", "channel"], "data", "max")


def supervised_ids(explained: DataFrame) -> DataFrame:
    """Native foreground ids that map to a foreground channel."""
    return explained.where("native_id > 0 AND channel > 0").select("dataset", "native_id", "channel")


def known_negatives(empties: DataFrame, model: DataFrame) -> DataFrame:
    """dataset, model_id of labels known to be absent: empties(dataset, label); labels outside the model are left out."""
    return empties.join(model, "label").select("dataset", "model_id").distinct()


def select_candidates(candidates: DataFrame, model: DataFrame, supported: DataFrame | None = None, policy: str = "error") -> DataFrame:
    """The first candidate of each evaluation label whose model labels are all supported.

    candidates(eval_set, eval_label, cand_idx, pos, model_label).  Returns eval_set, eval_label,
    cand_idx, model_labels (in order), model_ids, and unsupported_zero: with policy ``zero`` the
    first candidate within the model stands in; ``drop`` leaves the label out; ``error`` raises.
    """
    has = candidates.join(model.withColumnRenamed("label", "model_label"), "model_label", "left")
    if supported is None:
        has = has.withColumn("ok", F.col("model_id").isNotNull())
    else:
        has = has.join(supported.select(F.col("label").alias("model_label"), F.lit(True).alias("on")).distinct(), "model_label", "left").withColumn("ok", F.col("model_id").isNotNull() & F.col("on").isNotNull())
    groups = has.groupBy("eval_set", "eval_label", "cand_idx").agg(
        F.bool_and("ok").alias("full"), F.bool_and(F.col("model_id").isNotNull()).alias("in_model"), F.array_sort(F.collect_list(F.struct("pos", "model_label", "model_id"))).alias("labels")
    )
    rank = F.row_number().over(Window.partitionBy("eval_set", "eval_label").orderBy(F.desc("full"), F.desc("in_model") if policy == "zero" else F.lit(0), "cand_idx"))
    best = groups.withColumn("rank", rank).where("rank = 1")
    if policy == "error":
        best = best.withColumn("full", F.when(F.col("full"), True).otherwise(F.raise_error(F.concat(F.lit("no supported candidate for "), F.col("eval_label"))).cast("boolean")))
    best = best.where("full" if policy != "zero" else "full OR in_model")
    return best.select(
        "eval_set", "eval_label", "cand_idx", F.transform("labels", lambda x: x["model_label"]).alias("model_labels"),
        F.transform("labels", lambda x: x["model_id"]).alias("model_ids"), (~F.col("full")).alias("unsupported_zero"),
    )


def identity_defaults(dataset_labels: DataFrame, candidates: DataFrame, model: DataFrame, strict: bool = False) -> DataFrame:
    """Candidates of a dataset's own labels, explicit evaluation labels taking over what they cover.

    dataset_labels(label, pos) in stored order.  An explicit label is active if it, or a model
    label of one of its candidates, is a dataset label.  It covers the model labels of its first
    candidate within the model (the first explicit label wins) and is listed once, where the first
    covered label stood.  Other labels stand for themselves, without strict only if the model has
    them.  Returns pos, eval_label, explicit.
    """
    full = candidates.join(model.withColumnRenamed("label", "model_label"), "model_label", "left")
    active = full.join(dataset_labels.select(F.col("label").alias("l")), (F.col("l") == F.col("model_label")) | (F.col("l") == F.col("eval_label")), "left_semi").select("eval_label").distinct()
    whole = full.groupBy("eval_label", "cand_idx").agg(F.bool_and(F.col("model_id").isNotNull()).alias("in_model"), F.min("listed").alias("listed")).where("in_model")
    first = whole.groupBy("eval_label").agg(F.min("cand_idx").alias("cand_idx"), F.min("listed").alias("listed"))
    covered = full.select("eval_label", "cand_idx", "model_label").join(first, ["eval_label", "cand_idx"]).join(active, "eval_label", "left_semi").groupBy("model_label").agg(F.min_by("eval_label", "listed").alias("owner"))
    rows = (
        dataset_labels.join(active.select(F.col("eval_label").alias("label"), F.lit(True).alias("own")), "label", "left")
        .join(covered.withColumnRenamed("model_label", "label"), "label", "left").join(model, "label", "left")
    )
    name = F.when(F.col("own"), F.col("label")).when(F.col("owner").isNotNull(), F.col("owner")).when(F.col("model_id").isNotNull() | F.lit(strict), F.col("label"))
    explicit = F.coalesce(F.col("own"), F.col("owner").isNotNull())
    return rows.select("pos", name.alias("eval_label"), explicit.alias("explicit")).where("eval_label IS NOT NULL").groupBy("eval_label").agg(F.min("pos").alias("pos"), F.max("explicit").alias("explicit")).select("pos", "eval_label", "explicit")


def rule_violations(stored: DataFrame, aliases: DataFrame, drops: DataFrame, empties: DataFrame | None = None) -> DataFrame:
    """dataset, issue, detail: what is wrong with alias, drop and known-negative rules."""
    names = stored.select("dataset", "native_label")
    unknown = aliases.join(names, ["dataset", "native_label"], "left_anti").select("dataset", F.lit("alias of an unknown label").alias("issue"), F.col("native_label").alias("detail"))
    dropped = drops.join(names, ["dataset", "native_label"], "left_anti").select("dataset", F.lit("drop of an unknown label").alias("issue"), F.col("native_label").alias("detail"))
    background = aliases.where((F.col("native_label") == BACKGROUND) | (F.col("label") == BACKGROUND)).select("dataset", F.lit("alias of or to background").alias("issue"), F.col("native_label").alias("detail"))
    identity = aliases.where("native_label = label").select("dataset", F.lit("identity alias").alias("issue"), F.col("native_label").alias("detail"))
    both = aliases.join(drops, ["dataset", "native_label"], "left_semi").select("dataset", F.lit("aliased and dropped").alias("issue"), F.col("native_label").alias("detail"))
    ids = stored.groupBy("dataset").agg(F.min("native_id").alias("lo"), F.max("native_id").alias("hi"), F.count("*").alias("n"), F.count_distinct("native_id").alias("d"), F.count_distinct("native_label").alias("names"))
    gaps = ids.where("lo <> 0 OR hi + 1 <> n OR d <> n").select("dataset", F.lit("stored ids are not 0, 1, 2, ...").alias("issue"), F.col("n").cast("string").alias("detail"))
    twice = ids.where("names <> n").select("dataset", F.lit("a stored label stands twice").alias("issue"), F.col("names").cast("string").alias("detail"))
    out = unknown.unionByName(dropped).unionByName(background).unionByName(identity).unionByName(both).unionByName(gaps).unionByName(twice)
    if empties is not None:
        reached = names.unionByName(aliases.select("dataset", F.col("label").alias("native_label")))
        named = empties.withColumnRenamed("label", "native_label").join(reached, ["dataset", "native_label"], "left_semi").select("dataset", F.lit("known negative is stored").alias("issue"), F.col("native_label").alias("detail"))
        out = out.unionByName(named)
    return out
