"""Rating metrics over rated rows: means, shares, weeks, releases, themes, devices, regions, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 20


def rated(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows that count for metrics: valid (where there is is_valid) and rated 1 to 5."""
    valid = df.where(F.col(rating).between(1, 5))
    return valid.where("is_valid") if "is_valid" in df.columns else valid


def core(r: str = "rating") -> list[Column]:
    """n, mean, shares of bad (1-2), mid (3) and good (4-5), and good minus bad."""
    c, n = F.col(r), F.count("*")
    bad, mid, good = F.count_if(c <= 2), F.count_if(c == 3), F.count_if(c >= 4)
    return [n.alias("n"), F.avg(c).alias("mean"), (bad / n).alias("bad"), (mid / n).alias("mid"), (good / n).alias("good"), ((good - bad) / n).alias("nps_like")]


def distribution(df: DataFrame) -> DataFrame:
    """Rows and share per rating, in all."""
    counts = df.groupBy("rating").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("rating", "n", (F.col("n") / F.col("t")).alias("share"))


def shape(df: DataFrame) -> DataFrame:
    """The class of a rating distribution. The thresholds are ours (rule shape_v1): 1 and 5 both at least 25 % and 3 under
    20 % is U; 4-5 at least 60 % leans high; 1-2 at least 60 % leans low; 2-4 at least 60 % is normal; else long tail."""
    s = {k: F.count_if(F.col("rating") == k) / F.count("*") for k in range(1, 6)}
    name = F.when((s[1] >= 0.25) & (s[5] >= 0.25) & (s[3] < 0.2), "U").when(s[4] + s[5] >= 0.6, "high").when(s[1] + s[2] >= 0.6, "low").when(s[2] + s[3] + s[4] >= 0.6, "normal").otherwise("long_tail")
    return df.agg(name.alias("shape"), F.lit("shape_v1").alias("rule_version"))


def weekly(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Metrics per Monday week with the change to the week before and a small-sample flag. With a period, weeks that it
    cuts start at its start and are marked partial. The week-over-week window sees one row per week."""
    monday = F.date_trunc("week", F.col("d")).cast("date")
    week = monday if start is None else F.greatest(monday, start)
    rows = df if start is None else df.where(F.col("d").between(start, end))
    out = rows.groupBy(week.alias("week"), monday.alias("_monday")).agg(*core())
    change = F.col("mean") - F.lag("mean").over(Window.orderBy("week"))
    out = out.withColumn("delta_mean", change).withColumn("small_sample", F.col("n") < SMALL)
    if start is not None:
        out = out.withColumn("is_partial", (F.col("_monday") < start) | (F.date_add("_monday", 6) > end))
    return out.drop("_monday")


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Core metrics per key, small samples flagged."""
    return df.groupBy(*keys).agg(*core()).withColumn("small_sample", F.col("n") < SMALL)


def grouping_sets(df: DataFrame, *dimensions: str) -> DataFrame:
    """One table of overall metrics and metrics along each dimension: dimension, value, n, mean, bad, mid, good."""
    sets = ", ".join(["()"] + [f"({d})" for d in dimensions])
    df.createOrReplaceTempView("_plumbline_sets")
    name = "case " + " ".join(f"when grouping({d}) = 0 then '{d}'" for d in dimensions) + " else 'overall' end"
    value = "coalesce(" + ", ".join(f"cast({d} as string)" for d in dimensions) + ", '')"
    return df.sparkSession.sql(f"select {name} dimension, {value} value, count(*) n, avg(rating) mean, count_if(rating <= 2) / count(*) bad, count_if(rating = 3) / count(*) mid, count_if(rating >= 4) / count(*) good from _plumbline_sets group by grouping sets ({sets})")


def around_releases(df: DataFrame, releases: DataFrame, days: int) -> DataFrame:
    """Metrics (rows, mean, bad, good, good minus bad) of the `days` before and after each release and their differences: a range join with the release side small
    (its rows are checked: at most 10000 are broadcast, beyond that days are the join key)."""
    small = releases.limit(10_001).count() <= 10_000
    if small:
        near = df.join(F.broadcast(releases), (F.col("d") >= F.date_sub("release_date", days)) & (F.col("d") < F.date_add("release_date", days)))
    else:
        spread = releases.withColumn("d", F.explode(F.sequence(F.date_sub("release_date", days), F.date_add("release_date", days - 1))))
        near = df.join(spread, "d")
    after = F.col("d") >= F.col("release_date")
    r = F.col("rating")

    def side(on: Column, name: str) -> list[Column]:
        n = F.count_if(on)
        return [n.alias(f"n_{name}"), F.avg(F.when(on, r)).alias(f"mean_{name}"), F.try_divide(F.count_if(on & (r <= 2)), n).alias(f"bad_{name}"), F.try_divide(F.count_if(on & (r >= 4)), n).alias(f"good_{name}")]

    out = near.groupBy("version", "release_date").agg(*side(~after, "before"), *side(after, "after"))
    out = out.withColumns({f"nps_{k}": F.col(f"good_{k}") - F.col(f"bad_{k}") for k in ("before", "after")})
    return out.withColumns({f"delta_{m}": F.col(f"{m}_after") - F.col(f"{m}_before") for m in ("mean", "bad", "good", "nps")})


def flood(df: DataFrame, releases: DataFrame, days: int = 3) -> DataFrame:
    """Rows, low ratings and mean in the first `days` days after each release, day by day. All releases count: at most
    10000 are broadcast (they are counted first), beyond that days are the join key."""
    within = (F.col("d") >= F.col("release_date")) & (F.col("d") < F.date_add("release_date", days))
    if releases.limit(10_001).count() <= 10_000:
        near = df.join(F.broadcast(releases), within)
    else:
        spread = releases.withColumn("_day", F.explode(F.sequence(F.to_date("release_date"), F.date_add("release_date", max(days, 1) - 1))))
        near = df.withColumn("_day", F.to_date("d")).join(spread, "_day").where(within)
    return near.groupBy("version", F.date_diff("d", "release_date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("rating") <= 2).alias("n_bad"), F.avg("rating").alias("mean"))


def themes(df: DataFrame, k: int | None = None) -> DataFrame:
    """Per theme of df(id, theme, rating), a row for each pair: mentions by distinct comment, share of all distinct
    comments, mean, bad, rank (mentions down, mean up, name). Comments without a theme count in no share."""
    rows = df.where(F.col("theme").isNotNull()).dropDuplicates(["id", "theme"])
    total = df.agg(F.count_distinct("id").alias("t"))
    out = rows.groupBy("theme").agg(F.count("*").alias("mentions"), F.avg("rating").alias("mean"), (F.count_if(F.col("rating") <= 2) / F.count("*")).alias("bad"))
    out = out.crossJoin(F.broadcast(total)).withColumn("share", F.col("mentions") / F.col("t")).drop("t")
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mentions"), "mean", "theme")))
    return out.where(F.col("rank") <= k) if k else out


def reversal(df: DataFrame, releases: DataFrame) -> DataFrame:
    """Per theme: mean before and from its feature's release on, against the mean of all. df(id, theme, rating, d),
    releases(theme, release_date), of any number of rows: Spark broadcasts them only where they are small."""
    joined = df.join(releases, "theme")
    after = F.col("d") >= F.col("release_date")
    out = joined.groupBy("theme").agg(F.avg(F.when(~after, F.col("rating"))).alias("mean_before"), F.avg(F.when(after, F.col("rating"))).alias("mean_after"), F.count_if(~after).alias("n_before"), F.count_if(after).alias("n_after"))
    return out.crossJoin(F.broadcast(df.dropDuplicates(["id"]).agg(F.avg("rating").alias("mean_all"))))


def device_themes(df: DataFrame) -> DataFrame:
    """Device by theme, of df(id, device, theme, rating): count, count over the device's distinct comments, and count times
    (1 - theme mean / 5)."""
    pairs = df.where(F.col("theme").isNotNull()).dropDuplicates(["id", "theme"])
    counts = pairs.groupBy("device", "theme").agg(F.count("*").alias("n"))
    per_device = df.groupBy("device").agg(F.count_distinct("id").alias("_t"))
    per_theme = pairs.groupBy("theme").agg(F.avg("rating").alias("_mean"))
    joined = counts.join(per_device, "device").join(per_theme, "theme")
    return joined.select("device", "theme", "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("n") * (1 - F.col("_mean") / 5)).alias("weighted"))


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """The long form as a matrix with the given columns; missing cells are 0."""
    return df.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)


def regions(df: DataFrame) -> DataFrame:
    """Per region: core metrics, small_sample (n < 20) and noteworthy (n >= 20 and mean off by 0.30 or bad share by 10
    points from all); rank by n down, mean up, name. Empty and null regions are one, 未知."""
    region = F.when(F.coalesce(F.col("region"), F.lit("")) == "", "未知").otherwise(F.col("region"))
    out = df.withColumn("region", region).groupBy("region").agg(*core())
    total = df.agg(F.avg("rating").alias("_m"), (F.count_if(F.col("rating") <= 2) / F.count("*")).alias("_b"))
    off = (F.abs(F.col("mean") - F.col("_m")) >= 0.30) | (F.abs(F.col("bad") - F.col("_b")) >= 0.10)
    out = out.crossJoin(F.broadcast(total)).withColumn("small_sample", F.col("n") < SMALL).withColumn("noteworthy", (F.col("n") >= SMALL) & off).drop("_m", "_b")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "mean", "region")))


def priority(themes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """priority_v1 of themes(theme, mentions, mean, bad, gap_status, audience_class, feasibility, risk_override): five
    components of 0 to 100, the weighted score, grade and rank. Components that cannot be verified are 0 and listed as
    missing; an override lifts the grade to P0 and leaves the score."""
    w = weights or {"V": 0.30, "D": 0.30, "G": 0.15, "U": 0.15, "F": 0.10}
    top = F.max("mentions").over(Window.partitionBy())  # one row per theme
    scale = lambda c, table: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c)), F.lit(0.0))
    parts = {
        "V": F.coalesce(F.try_divide(100.0 * F.col("mentions"), top), F.lit(0.0)),
        "D": F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 * F.col("bad") + 50 * (5 - F.col("mean")) / 4)), F.lit(0.0)),
        "G": scale("gap_status", {"absent": 100.0, "partial": 70.0, "entry": 30.0}),
        "U": scale("audience_class", {"cross": 100.0, "core": 75.0, "single": 50.0, "edge": 25.0}),
        "F": scale("feasibility", {"2w": 100.0, "quarter": 75.0, "next": 50.0, "later": 25.0}),
    }
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNull(), k) for k, c in (("G", "gap_status"), ("U", "audience_class"), ("F", "feasibility")))), lambda x: x.isNotNull()), ",")
    out = themes.select("*", *(v.alias(f"_{k}") for k, v in parts.items()), missing.alias("missing_components"))
    out = out.withColumn("_score", sum((F.lit(w[k]) * F.col(f"_{k}") for k in parts), F.lit(0.0)))
    grade = F.when(F.coalesce(F.col("risk_override"), F.lit(False)) | (F.col("_score") >= 75), "P0").when(F.col("_score") >= 50, "P1").otherwise("P2")
    out = out.withColumn("grade", grade).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_score"), F.desc("_D"), F.desc("mentions"), F.col("theme"))))
    return out.select("theme", "mentions", *(F.round(f"_{k}", 2).alias(k) for k in parts), F.round("_score", 2).alias("score"), "grade", "rank", "missing_components", F.lit("priority_v1").alias("rule_version"))


def theme_correlation(df: DataFrame) -> DataFrame:
    """Per theme: correlation, slope and R2 of its weekly share with the weekly mean. df(id, theme, rating, d)."""
    week = F.date_trunc("week", F.col("d")).cast("date")
    base = df.withColumn("week", week)
    totals = base.dropDuplicates(["id"]).groupBy("week").agg(F.count("*").alias("_n"), F.avg("rating").alias("mean"))
    shares = base.where(F.col("theme").isNotNull()).dropDuplicates(["id", "theme"]).groupBy("week", "theme").agg(F.count("*").alias("_k"))
    joined = shares.join(totals, "week").withColumn("share", F.col("_k") / F.col("_n"))
    return joined.groupBy("theme").agg(F.count("*").alias("weeks"), F.corr("share", "mean").alias("correlation"), F.regr_slope("mean", "share").alias("slope"), F.regr_r2("mean", "share").alias("r2"))


def wish_share(df: DataFrame, is_wish: Column, by: str) -> DataFrame:
    """Per key: the share of wishes among rows of 4 and 5 stars."""
    high = F.col("rating") >= 4
    return df.groupBy(by).agg(F.count_if(high).alias("n_high"), F.count_if(high & is_wish).alias("n_wish"), F.try_divide(F.count_if(high & is_wish), F.count_if(high)).alias("wish_share"))


def lifecycle(df: DataFrame) -> DataFrame:
    """Per theme the phases of its weekly share of distinct comments (rule lifecycle_v1, ours): the first week, the week of
    the largest share (the earliest of equals) and the last one, the weeks up to and after the peak, and how many weeks
    have at least half of the peak's share. df(id, theme, rating, d); a theme's weeks are its own, so none is compared
    across themes."""
    week = F.date_trunc("week", F.col("d")).cast("date")
    base = df.withColumn("week", week)
    totals = base.groupBy("week").agg(F.count_distinct("id").alias("_n"))
    shares = base.where(F.col("theme").isNotNull()).groupBy("week", "theme").agg(F.count_distinct("id").alias("_k"))
    shares = shares.join(totals, "week").withColumn("share", F.col("_k") / F.col("_n"))
    peak = F.max_by(F.struct("week", "share"), F.struct("share", -F.unix_date("week")))
    peaks = shares.groupBy("theme").agg(peak.alias("p")).select("theme", F.col("p.week").alias("peak_week"), F.col("p.share").alias("peak_share"))
    joined = shares.join(peaks, "theme")
    rising, high = F.col("week") <= F.col("peak_week"), F.col("share") >= F.col("peak_share") / 2
    return joined.groupBy("theme", "peak_week", "peak_share").agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count_if(rising).alias("weeks_rising"), F.count_if(~rising).alias("weeks_falling"), F.count_if(high).alias("weeks_high"))


def top_themes(df: DataFrame, k: int) -> list[str]:
    """The names of the k themes with most mentions (as ranked by themes()); k is a report's size."""
    return [r["theme"] for r in themes(df, k).orderBy("rank").select("theme").collect()]


def heat_map(df: DataFrame, devices: list[str], k: int = 10, value: str = "share") -> DataFrame:
    """The k themes with most mentions by the given devices, a cell being count, share or weighted of device_themes()."""
    cells = device_themes(df).where(F.col("theme").isin(top_themes(df, k)))
    return matrix(cells, "theme", "device", "n" if value == "count" else value, devices)


def theme_trend(df: DataFrame, k: int = 5) -> DataFrame:
    """Mentions and mean per Monday week of the k themes with most mentions. df(id, theme, rating, d)."""
    rows = df.where(F.col("theme").isin(top_themes(df, k))).dropDuplicates(["id", "theme"])
    return rows.groupBy(F.date_trunc("week", F.col("d")).cast("date").alias("week"), "theme").agg(F.count("*").alias("mentions"), F.avg("rating").alias("mean"))


def quotes(df: DataFrame, by: str, k: int = 2, longest: int = 80) -> DataFrame:
    """(by, nth, id, text): for each value the k shortest non-empty texts (ties by id), cut to `longest` characters for
    print; the id leads back to the whole text. A text repeated within one value counts once, under its least id."""
    length = F.length(F.trim(F.coalesce(F.col("text"), F.lit(""))))
    own = df.where(length > 0).groupBy(by, "text").agg(F.min("id").alias("id"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.length("text"), "id"))
    return own.withColumn("nth", nth).where(F.col("nth") <= k).select(by, "nth", "id", F.substring("text", 1, longest).alias("text"))


def personas(df: DataFrame, least: int = 10, quotes: int = 2, risk: Column | None = None) -> DataFrame:
    """Segments with at least `least` rows: size, mean, and up to `quotes` ids of the shortest non-empty texts (ties by
    id). df(segment, id, rating, text).

    Where df has them, the most common device and ask (ties: the least name; null and empty do not count). With risk (a
    boolean column), how many rows tell of leaving, and high_risk: at least a tenth of the segment does.
    """
    extra = [] if risk is None else [F.count_if(risk).alias("n_risk"), (F.count_if(risk) >= 0.1 * F.count("*")).alias("high_risk")]
    kept = df.groupBy("segment").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), *extra).where(F.col("n") >= least)
    nth = F.row_number().over(Window.partitionBy("segment").orderBy(F.length("text"), "id"))
    quoted = df.where(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("_nth", nth).where(F.col("_nth") <= quotes)
    out = kept.join(quoted.groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list(F.col("id"))), ",").alias("quote_ids")), "segment", "left")
    for c in ("device", "ask"):
        if c in df.columns:
            counts = df.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy("segment", c).agg(F.count("*").alias("_n"))
            first = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("_n"), c))
            out = out.join(counts.withColumn("_nth", first).where("_nth = 1").select("segment", F.col(c).alias(f"top_{c}")), "segment", "left")
    return out


def funnel(df: DataFrame, by: list[str]) -> DataFrame:
    """Raw, repeated, otherwise invalid and valid rows. df(is_valid, duplicate_of)."""
    repeat = F.col("duplicate_of").isNotNull()
    return df.groupBy(*by).agg(F.count("*").alias("raw"), F.count_if(repeat).alias("duplicates"), F.count_if(~repeat & ~F.col("is_valid")).alias("invalid"), F.count_if(F.col("is_valid")).alias("valid"))


def compare_versions(a: DataFrame, b: DataFrame, version_a: str, version_b: str) -> DataFrame:
    """The same table under two rule versions, one below the other, marked by rule_version."""
    return a.withColumn("rule_version", F.lit(version_a)).unionByName(b.withColumn("rule_version", F.lit(version_b)))


def generalize(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Counts and means of groups of at least k rows; smaller groups are left out so that nobody is singled out."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("rating").alias("mean")).where(F.col("n") >= k)


def shareable(df: DataFrame, regions: dict[str, str], k: int = 5) -> DataFrame:
    """What may leave the project of df(region, device_series, d, rating): wider regions (by the given table, 其他 where it
    has none), device series, Monday weeks, counts and means of at least k rows. No other field goes along: no text, no
    device, no day."""
    table = F.create_map(*(F.lit(x) for kv in regions.items() for x in kv)) if regions else F.create_map(F.lit(""), F.lit("其他"))
    wide = F.coalesce(F.try_element_at(table, F.coalesce(F.col("region"), F.lit(""))), F.lit("其他"))
    coarse = df.select(wide.alias("region"), "device_series", F.date_trunc("week", F.col("d")).cast("date").alias("week"), "rating")
    return generalize(coarse, ["region", "device_series", "week"], k)


def admit(df: DataFrame, gate: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys passed their audit: gate(keys, passed); keys that the gate does not know are not admitted."""
    return df.join(gate.where("passed").select(*keys).distinct(), keys, "left_semi")


def one_channel(df: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Groups that mix channels: evidence of several channels is never summed, so a report needs this to be empty."""
    return df.groupBy(*keys).agg(F.count_distinct(channel).alias("channels")).where("channels > 1")
