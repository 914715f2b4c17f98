"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import NOT_WS, Scratch, buckets

#: Signs that fill junk text; their share of a text lowers its quality weight.
SIGNS = r"[$%&*#|^~<>{}\[\]\\=_@]"


def quality_weight(text: Column) -> Column:
    """1 for text without junk signs, falling to 0.05 as they reach a fifth of it (null and empty text: 1)."""
    full = F.length(F.coalesce(text, F.lit("")))
    signs = full - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SIGNS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * signs / F.greatest(full, F.lit(1)))


def sampling_key(key: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u from MD5 of seed and key: the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return -F.ln((F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)) / weight


def targets(sizes: DataFrame, weights: list[float], cap: float = 3.0) -> DataFrame:
    """target per source, from (source, source_size): the total shared by weight, no target above cap sizes.

    Sources by code point, null last, take the weights in turn. With sources ordered by cap * size / weight, the sources
    that stay capped are a prefix; the first source that its share of the rest fits gives the share of all. There is one
    row per source, so the windows here sort a list of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sized = sizes.withColumn("weight", w)
    ratio = cap * F.col("source_size") / F.col("weight")
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done = sized.withColumn("ratio", ratio).select(
        "source", "source_size", "weight", "ratio",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped_size"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("capped_weight"),
        F.sum("source_size").over(every).alias("all_size"),
        F.sum("weight").over(every).alias("all_weight"),
    )
    level = (F.col("all_size") - cap * F.col("capped_size")) / (F.col("all_weight") - F.col("capped_weight"))
    level = F.when(level <= F.col("ratio"), level)
    return done.withColumn("level", F.min_by(level, F.when(level.isNotNull(), F.col("ratio"))).over(every)).select(
        "source", "source_size", F.least(cap * F.col("source_size"), F.col("weight") * F.col("level")).alias("target")
    )


def _mixed(docs: DataFrame, weights: list[float], cap: float, whole: bool, seed: str, rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Every document with its key, _part (words of the fractional epoch) and taken; and each source's plan."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col("text")
    key = sampling_key(F.col("doc_id"), quality_weight(text), seed)
    rows = scratch.save(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(NOT_WS)), F.lit(0)).cast("long").alias("size"), key.alias("key")),
        "rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes.select("source", "source_size"), weights, cap)
    plan = goal.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    plan = scratch.save(plan, "plan")

    n = buckets(rows.count(), rows_per_bucket)
    cut = F.least(F.lit(n - 1), F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * n)).cast("long")  # grows with the key
    cutted = rows.withColumn("_b", cut)
    sums = cutted.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    sums = sums.select("source", "_b", "_sum", (F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")) - F.col("_sum")).alias("_before"))
    ranges = sums.join(plan, sums["source"].eqNullSafe(plan["source"])).select(
        sums["source"].alias("_source"), F.col("_b").alias("_rb"), "_before", "source_size", "target", "epochs", "budget",
        F.when(F.col("_before") + F.col("_sum") <= F.col("budget"), 1).when(F.col("_before") >= F.col("budget"), 0).alias("_all"),
    )
    placed = cutted.join(ranges, cutted["source"].eqNullSafe(ranges["_source"]) & (cutted["_b"] == ranges["_rb"])).drop("_source", "_rb")
    whole_ranges = placed.where("_all is not null").withColumn("_part", F.col("_all") * F.col("size"))
    inside = Window.partitionBy("source", "_b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.where("_all is null")
    left = F.col("budget") - F.col("_before") - (F.sum("size").over(inside) - F.col("size"))
    part = F.when(F.col("size") <= 2 * left, F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), left))
    ends = ends.withColumn("_left", left).withColumn("_part", F.when(F.col("_left") > 0, part).otherwise(0))
    both = whole_ranges.unionByName(ends.drop("_left"))
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("_part")).cast("long")), plan


def mix(docs: DataFrame, weights: list[float], cap: float = 3.0, whole: bool = False, seed: str = "mix", rows_per_bucket: int = 50_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A source first gives its complete epochs (every document, floor(target / size) times), then a fraction of one: its
    documents in the order of exponential keys scaled by quality weight, until the words that remain are met. The last of
    them is cut to the budget, or with whole=True taken when that comes nearer to the target than leaving it.
    Sources may hold any share of the rows: keys are cut into ranges, range sums find the one range in which a source's
    budget ends, and only that range's rows are sorted.
    Null text: size 0, taken 0. A null source is a source of its own, the last. Repeated rows are separate documents. An
    empty table gives an empty result; other columns are ignored.
    """
    taken, _ = _mixed(docs, weights, cap, whole, seed, rows_per_bucket)
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


#: Sources up to which their plans are broadcast; a plain join beyond.
SOURCES_BROADCAST = 50_000


def mixed_documents(docs: DataFrame, weights: list[float], cap: float = 3.0, seed: str = "mix", rows_per_bucket: int = 50_000) -> DataFrame:
    """The mix itself: every document as often as it is taken, always whole, in docs' columns.

    A source's fractional epoch ends at one key, so each row can tell from its own key how often it is taken: texts are
    not shuffled. Documents without words stay once: they use no budget, so nothing speaks against keeping them.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    taken, plan = _mixed(docs, weights, cap, True, seed, rows_per_bucket)
    ends = taken.where("_part > 0").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("_end"))
    plan = plan.select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs"))
    plan = scratch.save(plan.join(ends, plan["_source"].eqNullSafe(ends["source"]), "left").select("_source", "_epochs", "_end"), "ends")
    few = plan.count() <= SOURCES_BROADCAST
    key = F.struct(sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed).alias("key"), F.col("doc_id"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.coalesce("text", F.lit("")).rlike(NOT_WS).alias("_words"), F.col("source").alias("_of"))
    times = F.when(F.col("_words"), F.col("_epochs") + F.when(F.col("_key") <= F.col("_end"), 1).otherwise(0)).otherwise(1).cast("int")
    joined = rows.join(F.broadcast(plan) if few else plan, rows["_of"].eqNullSafe(plan["_source"])).withColumn("_times", times)
    return joined.where("_times > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")
