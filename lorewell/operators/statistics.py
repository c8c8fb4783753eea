"""Exploratory statistics of interactions and item metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.scalar import epoch_timestamp
from lorewell.operators.quantiles import exact_quantiles, order_statistics

# Weekday names and the bins of interaction counts.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
BINS = ((0, 1, "1"), (1, 2, "2"), (2, 5, "3-5"), (5, 10, "6-10"), (10, 20, "11-20"), (20, 50, "21-50"), (50, 100, "51-100"), (100, None, "100+"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, count), nulls dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"))


def null_counts(df: DataFrame, n: int = 20) -> DataFrame:
    """(column, nulls): the n columns with most nulls."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "column", "nulls").orderBy(F.desc("nulls"), "column").limit(n)


def duplicate_count(df: DataFrame) -> DataFrame:
    """(duplicates): rows after the first of equal ones."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def describe_counts(counts: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, extremes and linearly interpolated percentiles of a count column, no task or driver with more than a histogram.

    The counts are kept: every round of the quantiles reads them."""
    counts = counts.persist()
    c, shares = F.col("count"), (0.5, 0.75, 0.9, 0.95, 0.99)
    found = exact_quantiles(counts, "count", shares)
    quantiles = [F.lit(q).cast("double").alias(f"p{int(p * 100)}") for p, q in zip(shares, found, strict=True)]
    return counts.agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).select("n", "mean", "std", "min", *quantiles, "max")


def density(interactions: DataFrame) -> DataFrame:
    """n_rows, n_users, n_items, density and sparsity."""
    a = interactions.agg(F.count("*").alias("n_rows"), F.count_distinct("u").alias("n_users"), F.count_distinct("i").alias("n_items"))
    d = F.col("n_rows") / (F.col("n_users") * F.col("n_items"))
    return a.select("*", d.alias("density"), (1 - d).alias("sparsity"))


def ratio_at_most(counts: DataFrame, ks=(1, 2, 3, 5, 10)) -> DataFrame:
    """(k, ratio): the share of entities with at most k rows."""
    shares = counts.agg(*[F.avg((F.col("count") <= k).cast("double")).alias(str(k)) for k in ks])
    return shares.unpivot([], [str(k) for k in ks], "k", "ratio").select(F.col("k").cast("int").alias("k"), "ratio")


def binned(counts: DataFrame) -> DataFrame:
    """(ordinal, label, n, share) of right-closed bins; empty bins stay."""
    c = F.col("count")
    inside = [F.sum(((c > lo) if hi is None else (c > lo) & (c <= hi)).cast("long")).alias(label) for lo, hi, label in BINS]
    labels = [label for _, _, label in BINS]
    wide = counts.agg(*inside, F.count("*").alias("total"))
    long = wide.unpivot("total", labels, "label", "n")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return long.select(place.cast("int").alias("ordinal"), "label", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def histogram(counts: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n): equal widths between the extremes, the largest value in the last bin."""
    counts = counts.persist()
    edges = counts.agg(F.min("count").alias("lo"), F.max("count").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    k = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("count") - F.col("lo")) / F.when(width > 0, width)).cast("int") + 1, F.lit(bins)))
    return counts.join(F.broadcast(edges)).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def clipped(counts: DataFrame, upper: int = 10) -> DataFrame:
    return counts.groupBy(F.least(F.col("count"), F.lit(upper)).alias("n_clipped")).agg(F.count("*").alias("pairs"))


#: Keys of one count that are put in order together, and the most parts that a longer list is cut into.
TOGETHER, PARTS = 1_000_000, 256


def cumulative_share(counts: DataFrame, key: str, together: int = TOGETHER) -> DataFrame:
    """(key, count, position, cum_share, cdf), most frequent first.

    The running total is first taken over distinct counts (few), then within equal
    counts.  A count that many numeric keys share is cut at exact quantiles of the key, and
    its parts' sizes are summed ahead, so no task puts more than a part in order."""
    counts = counts.persist()
    levels = counts.groupBy("count").agg(F.count("*").alias("m")).persist()
    numeric = dict(counts.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    part = F.lit(0)
    for row in levels.where(F.col("m") > together).collect() if numeric else ():  # fewer than n / together
        n = min(PARTS, -(-row["m"] // together))
        edges = sorted(set(order_statistics(counts.where(F.col("count") == row["count"]), key, {row["m"] * k // n for k in range(1, n)}).values()))
        part = F.when(F.col("count") == row["count"], sum(((F.col(key) >= x).cast("int") for x in edges), F.lit(0))).otherwise(part)
    parted = counts.withColumn("part", part)
    sizes = parted.groupBy("count", "part").agg(F.count("*").alias("c"))
    ahead = sizes.select("count", "part", F.coalesce(F.sum("c").over(Window.partitionBy("count").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    above = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = levels.select("count", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("m") * F.col("count")).over(above), F.lit(0)).alias("sum_before"), F.sum(F.col("m") * F.col("count")).over(everything).alias("total"), F.sum("m").over(everything).alias("n"))
    own = F.row_number().over(Window.partitionBy("count", "part").orderBy(key))
    placed = parted.withColumn("own", own).join(F.broadcast(ahead), ["count", "part"]).join(F.broadcast(ranked), "count").withColumn("own", F.col("own") + F.col("ahead"))
    position = F.col("before") + F.col("own")
    return placed.select(key, "count", position.alias("position"), ((F.col("sum_before") + F.col("own") * F.col("count")) / F.col("total")).alias("cum_share"), (position / F.col("n")).alias("cdf"))


def share_landmarks(shares: DataFrame, fractions=(0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """(fraction, share): what the first int(n x fraction) keys of a cumulative share hold; none where that is no key."""
    n = shares.agg(F.count("*").alias("n"))
    marked = shares.join(F.broadcast(n)).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return marked.where(F.col("position") == F.floor(F.col("n") * F.col("fraction"))).select("fraction", F.col("cum_share").alias("share"))


def frame_profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_filled) of every column."""
    filled = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in df.columns]).unpivot("n_rows", df.columns, "column", "n_filled")
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return filled.select("column", types[F.col("column")].alias("type"), "n_rows", "n_filled")


def top_coverage(counts: DataFrame, key: str, ns=(10, 50, 100, 500, 1000)) -> DataFrame:
    """(n, coverage): the share of all rows that the n most frequent keys hold, for n up to their number."""
    order, counts = Window.orderBy(F.desc("count"), key), counts.persist()
    top = counts.orderBy(F.desc("count"), key).limit(max(ns)).withColumn("rank", F.row_number().over(order))
    total = counts.agg(F.sum("count").alias("total"), F.count("*").alias("keys"))
    sums = top.agg(*[F.sum(F.when(F.col("rank") <= n, F.col("count"))).alias(str(n)) for n in ns]).join(F.broadcast(total))
    return sums.unpivot(["total", "keys"], [str(n) for n in ns], "n", "s").select(F.col("n").cast("int").alias("n"), (F.col("s") / F.col("total")).alias("coverage"), "keys").where("n <= keys").drop("keys")


def pair_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("u", "i").agg(F.count("*").alias("count"))


def rebuy_rates(interactions: DataFrame) -> DataFrame:
    """Percent of pairs seen more than once, and of rows that repeat a pair."""
    p = pair_counts(interactions)
    return p.agg(F.round(100.0 * F.avg((F.col("count") > 1).cast("double")), 6).alias("pct_pairs_rebought"), F.round(100.0 * F.sum(F.col("count") - 1) / F.sum("count"), 6).alias("pct_rows_rebuy"))


def rebuy_gaps(interactions: DataFrame) -> DataFrame:
    """(u, i, t, gap_days): days since the pair's row before."""
    before = F.lag("t").over(Window.partitionBy("u", "i").orderBy("t"))
    return interactions.withColumn("gap_days", (F.col("t") - before) / 86400.0).where("gap_days IS NOT NULL").select("u", "i", "t", "gap_days")


def with_time(interactions: DataFrame) -> DataFrame:
    return interactions.withColumn("ts", F.timestamp_seconds("t"))


def by_day(interactions: DataFrame) -> DataFrame:
    return with_time(interactions).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("count"))


def by_month(interactions: DataFrame) -> DataFrame:
    return with_time(interactions).groupBy(F.to_date(F.date_trunc("MONTH", "ts")).alias("month")).agg(F.count("*").alias("count"))


def by_weekday(interactions: DataFrame) -> DataFrame:
    """(ordinal, dow, count), Monday first; a missing day has a null count."""
    found = with_time(interactions).groupBy(F.weekday("ts").alias("k")).agg(F.count("*").alias("count"))
    days = interactions.sparkSession.range(7).select((F.col("id") + 1).cast("int").alias("ordinal"), F.element_at(F.array(*map(F.lit, DAYS)), (F.col("id") + 1).cast("int")).alias("dow"))
    return days.join(found, F.col("ordinal") == F.col("k") + 1, "left").select("ordinal", "dow", "count")


def by_hour(interactions: DataFrame) -> DataFrame:
    """(hour, count) of all 24 hours, 0 where there is none."""
    found = with_time(interactions).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("count"))
    hours = interactions.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("count", F.lit(0)).alias("count"))


def weekday_by_hour(interactions: DataFrame) -> DataFrame:
    """(ordinal, dow, h0..h23): counts, 0 where there is none."""
    t = with_time(interactions).select((F.weekday("ts") + 1).alias("k"), F.hour("ts").alias("h"))
    wide = t.groupBy("k").agg(*[F.sum((F.col("h") == h).cast("long")).alias(f"h{h}") for h in range(24)])
    days = interactions.sparkSession.range(7).select((F.col("id") + 1).cast("int").alias("ordinal"), F.element_at(F.array(*map(F.lit, DAYS)), (F.col("id") + 1).cast("int")).alias("dow"))
    return days.join(wide, F.col("ordinal") == F.col("k"), "left").drop("k").na.fill(0)


def sample_matrix(interactions: DataFrame, users: int = 100, items: int = 150) -> DataFrame:
    """(u, i, count): a fixed sample of users (by hash) and their most frequent items; long, as a heat map needs it."""
    some = interactions.select("u").distinct().orderBy(F.md5(F.col("u").cast("string")), "u").limit(users)
    own = interactions.join(F.broadcast(some), "u", "left_semi")
    top = own.groupBy("i").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "i").limit(items).select("i")
    return own.join(F.broadcast(top), "i", "left_semi").groupBy("u", "i").agg(F.count("*").alias("count"))


def metadata_coverage(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """n_items, n_with_metadata, coverage of the items in interactions."""
    known = items.select("i").distinct().withColumn("known", F.lit(1))
    a = interactions.select("i").distinct().join(known, "i", "left").agg(F.count("*").alias("n_items"), F.count("known").alias("n_with_metadata"))
    return a.withColumn("coverage", F.col("n_with_metadata") / F.greatest(F.col("n_items"), F.lit(1)))


def without_metadata(interactions: DataFrame, items: DataFrame) -> DataFrame:
    return interactions.join(items.select("i"), "i", "left_anti")


def warm_cold(targets: DataFrame, train: DataFrame) -> DataFrame:
    """n_targets, n_warm, n_cold: target users with and without training rows."""
    known = train.select("u").distinct().withColumn("warm", F.lit(1))
    return targets.select("u").distinct().join(known, "u", "left").agg(F.count("*").alias("n_targets"), F.count("warm").alias("n_warm"), (F.count("*") - F.count("warm")).alias("n_cold"))


def cold_users(targets: DataFrame, train: DataFrame, n: int = 10) -> DataFrame:
    return targets.select("u").distinct().join(train.select("u"), "u", "left_anti").orderBy("u").limit(n)


def kpis(interactions: DataFrame) -> DataFrame:
    a = interactions.agg(F.count_distinct("u").alias("n_users"), F.count_distinct("i").alias("n_items"), F.count("*").alias("n_rows"))
    return a.withColumn("rows_per_user", F.col("n_rows") / F.col("n_users"))


def gauges(interactions: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Sparsity over the users and items known, the share of items that anyone took, and of users who took any, in percent.

    Known are those of the catalogue (i), of the user table (u) and of the interactions."""
    known = lambda table, c: table.select(c).union(interactions.select(c)).agg(F.count_distinct(c).alias(f"known_{c}"))
    one = density(interactions).join(F.broadcast(known(items, "i"))).join(F.broadcast(known(users, "u")))
    cells = F.col("known_u") * F.col("known_i")
    return one.select((100 * (1 - F.col("n_rows") / cells)).alias("sparsity_pct"), (100 * F.col("n_items") / F.col("known_i")).alias("coverage_pct"), (100 * F.col("n_users") / F.col("known_u")).alias("active_pct"))


def days(interactions: DataFrame) -> DataFrame:
    """(_t_dt, count): rows by day of epoch times whose unit the largest tells; rows without a time are left out."""
    largest = interactions.agg(F.max("t").alias("largest"))
    at = interactions.join(F.broadcast(largest)).select(epoch_timestamp(F.col("t"), F.col("largest")).cast("date").alias("_t_dt"))
    return at.where("_t_dt IS NOT NULL").groupBy("_t_dt").agg(F.count("*").alias("count"))


def time_coverage(interactions: DataFrame) -> DataFrame:
    return interactions.agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def summary(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """One row of figures, and the same as JSON."""
    d = density(interactions).drop("sparsity")
    one = d.join(F.broadcast(time_coverage(interactions))).join(F.broadcast(items.agg(F.count_distinct("i").alias("n_metadata"))))
    return one.withColumn("summary_json", F.to_json(F.struct("n_rows", "n_users", "n_items", "t_min", "t_max", "n_metadata")))


def first_rank(interactions: DataFrame) -> DataFrame:
    """(u, i, t, r): place in the user's history over its length, ties by item."""
    w = Window.partitionBy("u").orderBy("t", "i")
    return interactions.withColumn("r", F.row_number().over(w) / F.count("*").over(Window.partitionBy("u")))


def top_authors(interactions: DataFrame, items: DataFrame, n: int = 15, unknown: str = "Inconnu") -> DataFrame:
    """(Author, count): the authors of most interactions; counted by item first, so only counts meet the metadata."""
    per_item = interactions.groupBy("i").agg(F.count("*").alias("c"))
    authors = per_item.join(items.select("i", "Author"), "i", "left").groupBy(F.coalesce("Author", F.lit(unknown)).alias("Author")).agg(F.sum("c").alias("count"))
    return authors.orderBy(F.desc("count"), "Author").limit(n)
