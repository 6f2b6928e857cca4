"""Which samples are used, in what order and with what weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIE_ORDER = ("train", "val", "test")


def subject_key(subject: str = "subject_id", sample: str = "data_id") -> Column:
    """The subject, or the sample where the subject is null or empty."""
    return F.coalesce(F.nullif(F.col(subject), F.lit("")), F.col(sample))


def filter_records(
    records: DataFrame,
    modality: str,
    dataset_names: list[str] | None = None,
    split: str | None = None,
    require_label: bool = False,
    excluded: DataFrame | None = None,
    num_subjects: int | None = None,
) -> DataFrame:
    """Records by modality, dataset, split, label, subject, in that order.

    records has modality, dataset_name, split, label, subject_id, data_id and pos (record order).
    excluded(subject) are left out by an anti join.  num_subjects keeps the first subjects in
    record order, and at least one (0 keeps one too).  With require_label, records without a label
    go; that nothing but such records matched is for the caller to see (``label_missing``).
    """
    kept = records.where(F.col("modality") == modality)
    if dataset_names is not None:
        kept = kept.where(F.col("dataset_name").isin(dataset_names))
    if split is not None:
        kept = kept.where(F.col("split") == split)
    if require_label:
        kept = kept.where(F.col("label").isNotNull())
    kept = kept.withColumn("subject", subject_key())
    if excluded is not None:
        kept = kept.join(excluded.select("subject").distinct(), "subject", "left_anti")
    if num_subjects is not None:
        if num_subjects < 0:
            raise ValueError("num_subjects must not be negative")
        first = kept.groupBy("subject").agg(F.min("pos").alias("first")).orderBy("first").limit(max(1, num_subjects))
        kept = kept.join(first.select("subject"), "subject", "left_semi")
    return kept


def label_missing(matching: DataFrame) -> DataFrame:
    """One row if records match but none has a label: the case in which requiring labels is an error."""
    return matching.agg(F.count("*").alias("n"), F.count("label").alias("labelled")).where("n > 0 AND labelled = 0")


def pair_by_stem(images: DataFrame, masks: DataFrame, suffixes: tuple[str, ...], name: str = "name") -> DataFrame:
    """Images and masks of one stem (name without the first suffix that it ends with, case aside); unpaired ones go."""
    return stems(images, suffixes, name).withColumnRenamed(name, "image").join(stems(masks, suffixes, name).withColumnRenamed(name, "mask"), "stem")


def stems(files: DataFrame, suffixes: tuple[str, ...], name: str = "name") -> DataFrame:
    """Files that end with one of the suffixes, with their stem."""
    low = F.lower(name)
    cut = reduce(lambda c, s: c.when(low.endswith(s), F.expr(f"left({name}, length({name}) - {len(s)})")), suffixes[1:], F.when(low.endswith(suffixes[0]), F.expr(f"left({name}, length({name}) - {len(suffixes[0])})")))
    return files.select(name, cut.alias("stem")).where("stem IS NOT NULL")


def duplicate_stems(files: DataFrame) -> DataFrame:
    return files.groupBy("stem").count().where("count > 1")


def subject_splits(subjects: DataFrame, percentages: dict[str, int], order: Column | None = None, subject: str = "subject") -> DataFrame:
    """subject, split by largest remainder over a seeded order of distinct subjects.

    Split sizes are floors of the shares; seats left over go by remainder, ties train, val, test.
    order: by default the MD5 of the subject.  Positions come from counts of hash ranges, so no
    task orders all subjects.
    """
    if sum(percentages.values()) != 100:
        raise ValueError("percentages must add up to 100")
    distinct = subjects.select(F.col(subject).cast("string").alias("subject")).distinct()
    order = F.md5(F.col("subject")) if order is None else order
    placed = ordered_position(distinct.withColumn("_o", order), ["_o", "subject"], "_o")
    names = [s for s in TIE_ORDER if s in percentages] + [s for s in percentages if s not in TIE_ORDER]
    n = F.col("n")
    floors = {s: F.floor(n * percentages[s] / 100) for s in names}
    left = n - reduce(lambda a, b: a + b, floors.values())
    ahead = lambda k: reduce(lambda a, b: a + b, [((n * percentages[names[j]] % 100 > n * percentages[names[k]] % 100) | ((n * percentages[names[j]] % 100 == n * percentages[names[k]] % 100) & F.lit(j < k))).cast("int") for j in range(len(names)) if j != k], F.lit(0))
    sizes = [floors[s] + F.when(ahead(k) < left, 1).otherwise(0) for k, s in enumerate(names)]
    bounds = [reduce(lambda a, b: a + b, sizes[: k + 1]) for k in range(len(names))]
    total = distinct.agg(F.count("*").alias("n"))
    split = reduce(lambda c, k: c.when(F.col("place") < bounds[k], names[k]), range(1, len(names)), F.when(F.col("place") < bounds[0], names[0]))
    return placed.join(F.broadcast(total)).select("subject", split.alias("split"))  # total is one row


def ordered_position(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """``place``, the number from 0 of each row in the order ``by``.

    Rows are numbered within the 4096 buckets of the first three characters of a hex column
    ``prefix``, and buckets are offset by running counts (4096 rows).
    """
    bucket = F.substring(prefix, 1, 3)
    df = df.withColumn("_b", bucket)
    counts = df.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*by)) - 1
    return df.withColumn("_in", inside).join(before, "_b").withColumn("place", F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def split_leaks(samples: DataFrame) -> DataFrame:
    """Subjects that stand in several splits."""
    return samples.groupBy("subject").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def split_counts(samples: DataFrame) -> DataFrame:
    """Samples and distinct subjects of each split."""
    return samples.groupBy("split").agg(F.count("*").alias("n_samples"), F.count_distinct("subject").alias("n_subjects"))


def apportion(weights: DataFrame, steps: int) -> DataFrame:
    """source, n: ``steps`` shared out by integer weights; leftovers by remainder, then name."""
    total = weights.agg(F.sum("weight").alias("total"))
    shares = weights.join(F.broadcast(total)).select("source", F.expr(f"(weight * {steps}) div total").alias("base"), F.expr(f"(weight * {steps}) % total").alias("rest"))  # total is one row
    left = F.lit(steps) - F.sum("base").over(Window.partitionBy(F.lit(0)))  # one row a source
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "source"))
    return shares.select("source", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("n"))


def stratified_schedule(counts: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """source, occurrence, position in (0, 1): occurrences spread evenly, with jitter from an MD5 of seed, epoch, source and occurrence.

    The order of the schedule is that of position, then source.
    """
    rows = counts.where("n > 0").select("source", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("occurrence"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), "source", F.col("occurrence").cast("string")))
    jitter = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.select("source", "occurrence", ((F.col("occurrence") + jitter) / F.col("n")).alias("position"))


def interleave(schedule: DataFrame, batches: DataFrame) -> DataFrame:
    """Batches in schedule order, sources starting over when they run out: batches(source, batch, payload...)."""
    sizes = batches.groupBy("source").agg(F.count_distinct("batch").alias("n_batches"))
    return schedule.join(sizes, "source").withColumn("batch", F.col("occurrence") % F.col("n_batches")).join(batches, ["source", "batch"])


def homogeneous_batches(rows: DataFrame, source: str, order: list[str], size: int, drop_last: bool = False) -> DataFrame:
    """``batch``: consecutive chunks within each source; drop_last leaves out incomplete ones."""
    w = Window.partitionBy(source).orderBy(*order)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(source))).where((F.col("batch") + 1) * size <= F.col("_n")).drop("_n")
    return out


def composite_offsets(sources: DataFrame) -> DataFrame:
    """source, start, stop of concatenated sources(source, pos, n): one row a source."""
    stop = F.sum("n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sources.select("source", "pos", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def locate_index(indices: DataFrame, offsets: DataFrame) -> DataFrame:
    """source and local index of global indices (negative ones count from the end); indices outside are left out."""
    end = offsets.agg(F.max("stop").alias("_end"))
    at = indices.join(F.broadcast(end)).withColumn("_i", F.when(F.col("index") < 0, F.col("index") + F.col("_end")).otherwise(F.col("index")))  # end is one row
    return at.join(offsets, (F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("stop"))).select("index", "source", (F.col("_i") - F.col("start")).alias("local"))


def inverse_frequency_weights(classes: DataFrame, crops: DataFrame, tau: float = 1.0, how: str = "mean") -> DataFrame:
    """crop, weight: mean or max over a crop's classes of (N / n_c)^tau, 0 without any, over the mean of all.

    classes(crop, class) may repeat; crops(crop) are all N of them.
    """
    n = crops.agg(F.count("*").alias("n_crops"))
    distinct = classes.select("crop", "class").distinct()
    rarity = distinct.groupBy("class").agg(F.count("*").alias("n_c")).join(F.broadcast(n)).select("class", F.pow(F.col("n_crops") / F.col("n_c"), F.lit(float(tau))).alias("r"))  # n is one row
    raw = distinct.join(rarity, "class").groupBy("crop").agg((F.avg if how == "mean" else F.max)("r").alias("raw"))
    all_raw = crops.join(raw, "crop", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    mean = all_raw.agg(F.avg("raw").alias("mean"))
    return all_raw.join(F.broadcast(mean)).select("crop", F.coalesce(F.try_divide("raw", F.nullif("mean", F.lit(0.0))), F.lit(0.0)).alias("weight"))  # mean is one row


def weighted_draws(items: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """draw, item: with replacement, in proportion to weights(item, weight), by inverse distribution.

    Cumulative weights are offsets of MD5 buckets plus running sums inside them; a draw looks up
    its bucket among at most 4096, then its item within that bucket only.  A null item has a bucket
    of its own after these.
    """
    hashed = items.where("weight > 0").withColumn("_b", F.coalesce(F.substring(F.md5(F.col("item").cast("string")), 1, 3), F.lit("null")))
    inside = F.sum("weight").over(Window.partitionBy("_b").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    buckets = hashed.groupBy("_b").agg(F.sum("weight").alias("_w"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = buckets.select("_b", (F.sum("_w").over(w) - F.col("_w")).alias("_lo"), F.sum("_w").over(w).alias("_hi"))
    total = buckets.agg(F.sum("_w").alias("_total"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    drawn = items.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(total)).withColumn("_x", u * F.col("_total"))  # total is one row
    placed = drawn.join(F.broadcast(bounds), (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))  # at most 4097 rows
    ends = hashed.select("item", "_b", "weight", inside.alias("_end"))
    hit = placed.join(ends, "_b").where((F.col("_x") - F.col("_lo") < F.col("_end")) & (F.col("_x") - F.col("_lo") >= F.col("_end") - F.col("weight")))
    return hit.select("draw", "item")


def active_sources(configured: DataFrame, proportions: DataFrame, omitted_active: bool = False) -> DataFrame:
    """Sources left after zero proportions are taken out.

    By default the proportions are an allow-list: a source that they omit is inactive too.  With
    omitted_active (the loader's rule) only an explicit 0 takes a source out.
    """
    joined = configured.join(proportions, "source", "left")
    return joined.where(F.coalesce(F.col("proportion"), F.lit(1.0 if omitted_active else 0.0)) > 0).select("source")


def unique_stems(names: DataFrame) -> DataFrame:
    """stem, stem_2, stem_3, ... for repeated stems, in the order of ``idx``."""
    k = F.row_number().over(Window.partitionBy("stem").orderBy("idx"))
    return names.withColumn("unique_stem", F.when(k > 1, F.concat_ws("_", "stem", k.cast("string"))).otherwise(F.col("stem")))


def crop_plan(depth: str = "depth", crop: int = 256, overlap: float = 0.0) -> Column:
    """Starts of crops along an axis: array of (crop_index, z_start, z_stop, pad_before, pad_after).

    A short volume is one padded crop.  Else steps are ceil(crop * (1 - overlap)); if the last
    start lies within a step there are two crops, else starts are spread evenly, halves to even.
    """
    d = F.col(depth).cast("long")
    step = max(1, -(-round(crop * (1 - overlap) * 1_000_000) // 1_000_000))
    last = d - crop
    n = F.ceil(last / step)
    pad = F.greatest(F.lit(crop) - d, F.lit(0))
    starts = F.when(d <= crop, F.array(F.lit(0).cast("long"))).when(last < step, F.array(F.lit(0).cast("long"), last)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.rint((i * last).cast("double") / n).cast("long"))
    )
    return F.transform(starts, lambda s, i: F.struct(
        i.cast("int").alias("crop_index"), s.alias("z_start"), F.least(s + crop, d).alias("z_stop"),
        F.floor(pad / 2).alias("pad_before"), (pad - F.floor(pad / 2)).alias("pad_after"),
    ))


def crop_sample_id(sample: str, index: str) -> Column:
    return F.format_string("%s__crop%03d", F.col(sample), F.col(index))


def sweep(axes: list[DataFrame]) -> DataFrame:
    """Cartesian product of small axes, each with a column ``<axis>`` and ``<axis>_ord``; ``config_idx`` in axis order."""
    out = reduce(lambda a, b: a.crossJoin(b), axes)  # axes are lists of a configuration
    ords = [c for c in out.columns if c.endswith("_ord")]
    return out.withColumn("config_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ords)) - 1).drop(*ords)
