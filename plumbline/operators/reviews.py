"""Store reviews: combining, first-wins de-duplication, audits, keyed upserts of partial records, list positions.

Every source numbers its rows (`row_idx`); ties always end in that number, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import blank, displayed_date, post_info, star
from plumbline.operators.ordered import numbered
from plumbline.sources.steps import dealt

IDENTITY = ("published_at", "rating", "text", "region", "device")


def first_wins(df: DataFrame, identity: list[str] | tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each identity in the given order (row_idx last); null and empty are one value."""
    keys = {f"_key{i}": blank(F.col(c)) for i, c in enumerate(identity)}
    by = Window.partitionBy(*keys).orderBy(*order, F.col("row_idx"))
    return dealt(df.withColumns(keys), *keys).withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth", *keys)


def combine(*frames: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The union of review tables over the union of their columns (in order of first sight, missing cells empty), without
    repeats of an identity, newest first by (published_at, list position), numbered as seq.

    Earlier frames win; their row_idx must rise within each frame. Numbers restart for each month of published_at, so no
    single task orders everything; month and seq together give the whole order.
    """
    columns = list(dict.fromkeys(c for f in frames for c in f.columns))
    union = None
    for k, f in enumerate(frames):
        part = f.select(*(blank(F.col(c)).alias(c) if c in f.columns else F.lit("").alias(c) for c in columns if c != "row_idx"), F.struct(F.lit(k).alias("file"), F.col("row_idx").alias("row")).alias("row_idx"))
        union = part if union is None else union.unionByName(part)
    kept = first_wins(union, identity)
    month = F.substring("published_at", 1, 7)
    by = Window.partitionBy(month).orderBy(F.desc("published_at"), F.col("list_pos").try_cast("int").desc_nulls_last(), F.col("row_idx"))
    return kept.withColumn("month", month).withColumn("seq", F.row_number().over(by)).drop("row_idx")


def duplicate_of(df: DataFrame, identity: list[str], id_column: str) -> DataFrame:
    """df with duplicate_of: the id of the first row of the same identity, null for that row itself."""
    by = Window.partitionBy(*(blank(F.col(c)) for c in identity)).orderBy("row_idx")
    first = F.first_value(id_column).over(by)
    return df.withColumn("duplicate_of", F.when(F.row_number().over(by) > 1, first))


def star_histogram(df: DataFrame, key: str = "rating") -> DataFrame:
    """Rows per rating as text, empty where there is none."""
    return df.groupBy(blank(F.col(key)).alias("stars")).agg(F.count("*").alias("n"))


def audit(df: DataFrame, by: list[str], identity: list[str], date: str, position: str, text: str, rating: str, stretch: int = 1 << 16) -> DataFrame:
    """One row per group: rows, first and last date, repeated identities, missing positions between the least and the
    largest, missing text and ratings. A group without positions has no gaps.

    Where the position is part of the identity, rows are dealt out once, by group and stretch of positions, and all is counted
    where they lie; a group's rows are then one for each stretch. (Two counts of distinct values would move each row three
    times.) Rows without a position are dealt out by identity."""
    p = F.col(position)
    blanks = [blank(F.col(c)) for c in identity]
    figures = {"rows": F.count("*"), "date_min": F.min(date), "date_max": F.max(date), "missing_content": F.count_if(blank(F.col(text)) == ""), "missing_rating": F.count_if(F.col(rating).isNull())}
    shown = [*by, "rows", "date_min", "date_max", "duplicate_rows", "gap_count", "missing_content", "missing_rating"]
    if position not in identity:
        repeats = F.count("*") - F.count_distinct(F.struct(*blanks))
        gaps = F.coalesce(F.max(p) - F.min(p) + 1 - F.count_distinct(p), F.lit(0)).cast("long")
        return df.groupBy(*by).agg(*(f.alias(k) for k, f in figures.items()), repeats.alias("duplicate_rows"), gaps.alias("gap_count")).select(*shown)
    held = df.select(*dict.fromkeys([*by, *identity, date, text, rating])).withColumn("_part", F.coalesce(F.floor(p / F.lit(stretch)), F.pmod(F.xxhash64(*blanks), F.lit(1 << 10))))
    more = {"rows": F.sum("rows"), "date_min": F.min("date_min"), "date_max": F.max("date_max"), "missing_content": F.sum("missing_content"), "missing_rating": F.sum("missing_rating")}
    added = [f.alias(k) for k, f in more.items()]
    keys = [b.alias(f"_i{k}") for k, b in enumerate(blanks)]
    each = dealt(held, *by, "_part").groupBy(*by, "_part", p.alias("_p"), *keys).agg(*(f.alias(k) for k, f in figures.items()))
    places = each.groupBy(*by, "_part", "_p").agg(*added, F.count("*").alias("_different"))
    parts = places.groupBy(*by, "_part").agg(*added, F.sum("_different").alias("_different"), F.count("_p").alias("_places"), F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    whole = parts.groupBy(*by).agg(*added, F.sum("_different").alias("_different"), F.sum("_places").alias("_places"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    gaps = F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_places"), F.lit(0)).cast("long")
    return whole.withColumns({"duplicate_rows": F.col("rows") - F.col("_different"), "gap_count": gaps}).select(*shown)


def position_gaps(df: DataFrame, by: list[str], position: str, samples: int = 30, stretch: int = 1 << 20) -> DataFrame:
    """The first `samples` missing positions of each group and their count; groups without a gap have no row.

    Steps between neighbours are looked at in stretches of positions, each by itself, so that a group of any size (one app's
    whole list) is never sorted in one task; the steps from one stretch to the next come from their ends. Of each stretch,
    then of each group, only the first `samples` gaps are gathered, as each has a missing position at least.
    """
    p = F.col(position).cast("long")
    rows = df.where(F.col(position).isNotNull()).select(*by, p.alias("p"), F.floor(p / F.lit(stretch)).alias("_part")).distinct()
    within = Window.partitionBy(*by, "_part")
    inner = rows.withColumn("n", F.lead("p").over(within.orderBy("p")) - F.col("p") - 1)
    ends = rows.groupBy(*by, "_part").agg(F.min("p").alias("_low"), F.max("p").alias("p"))
    between = ends.withColumn("n", F.lead("_low").over(Window.partitionBy(*by).orderBy("_part")) - F.col("p") - 1).drop("_low")
    gaps = inner.unionByName(between).where("n > 0")
    counts = gaps.groupBy(*by).agg(F.sum("n").alias("gap_count"))
    few = gaps.withColumn("_nth", F.row_number().over(within.orderBy("p"))).where(F.col("_nth") <= samples)
    few = few.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("p"))).where(F.col("_nth") <= samples)
    starts = F.expr(f"sequence(p + 1, p + least(n, {samples}))")
    first = few.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list(starts))), 1, samples).alias("first_gaps"))
    return counts.join(first, by)


def overlap(saved: DataFrame, current: DataFrame, key: str = "idx") -> DataFrame:
    """The keys of the current page that were collected before, each once; empty where page and history do not meet."""
    return current.select(key).distinct().join(saved.select(key).distinct(), key, "left_semi")


def audit_file(df: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """One row for a whole review file (columns of the store CSV by internal name, all text): audit()'s figures, the rows per
    rating as a map in key order (empty where there is none) and the first 30 missing positions."""
    one = df.withColumn("_all", F.lit(1)).withColumn("_p", F.when(F.col("list_pos").rlike(r"^[0-9]+\z"), F.col("list_pos")).try_cast("long"))
    rated = one.withColumn("_r", F.nullif(blank(F.col("rating")), F.lit("")))
    out = audit(rated.withColumn("_d", F.nullif(F.substring(blank(F.col("published_at")), 1, 10), F.lit(""))), ["_all"], list(identity), "_d", "_p", "text", "_r")
    stars = star_histogram(one).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stars", "n")))).alias("stars"))
    return out.join(position_gaps(one, ["_all"], "_p").select("_all", "first_gaps"), "_all", "left").drop("_all").crossJoin(F.broadcast(stars))


def upsert(df: DataFrame, key: str, order: str, fields: list[str], longest: str) -> DataFrame:
    """One record per key from partial ones: the newest non-empty value of each field; of `longest` the longest value, the
    newest of equally long ones. A field never filled is empty. Aggregates are partial before the shuffle."""
    newest = [F.coalesce(F.max_by(F.col(f), F.when(blank(F.col(f)) != "", F.col(order))), F.lit("")).alias(f) for f in fields]
    best = F.coalesce(F.max_by(F.col(longest), F.when(blank(F.col(longest)) != "", F.struct(F.length(longest), F.col(order)))), F.lit("")).alias(longest)
    return df.groupBy(key).agg(*newest, best)


def compatible(a: str, b: str) -> Column:
    """Whether two sightings (structs of stars and text, equal post_info given) can be of one review."""
    stars_a, stars_b, text_a, text_b = blank(F.col(f"{a}.stars")), blank(F.col(f"{b}.stars")), blank(F.col(f"{a}.text")), blank(F.col(f"{b}.text"))
    stars = (stars_a == stars_b) | (stars_a == "") | (stars_b == "")
    texts = F.when((text_a != "") & (text_b != ""), text_a.startswith(text_b) | text_b.startswith(text_a)).otherwise((stars_a != "") & (stars_b != ""))
    return stars & texts


def _sightings(df: DataFrame, keys: list[str], saved: bool, lengths: DataFrame, by: list[str]) -> DataFrame:
    """(keys, bucket, idx, n): each sighting in the buckets in which it meets those of the other side that it is compatible
    with. Every compatible pair shares exactly one bucket.

    Texts that are both filled meet under the shorter one: the side that may be longer goes to a bucket for each length that
    the other side's texts of the same post_info have (as many as a text has characters at most). Stars meet under their
    value, or under the side that does not know them. Where a text is empty, stars must be known.
    """
    text, stars = blank(F.col("text")), blank(F.col("stars"))
    rows = df.where(blank(F.col("post_info")) != "").select(*keys, "post_info", text.alias("text"), stars.alias("stars"), F.col("idx").cast("long").alias("idx"))
    rows = rows.join(lengths, [*by, "post_info"], "left")
    size, known = F.length("text"), F.col("stars") != ""
    value = F.concat(F.lit("="), F.col("stars"))
    own, other = ("s", "c") if saved else ("c", "s")
    # saved: own value, or the page's side unknown; page: own value, or the saved side unknown. Both unknown meet once.
    tags = F.when(known, F.array(value, F.lit(f"?{other}"))).otherwise(F.array(F.lit("?c"), F.lit("?s")) if saved else F.array(F.lit("?c")))
    shorter = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: (n <= size) if saved else (n < size))
    cut = F.transform(shorter, lambda n: F.concat(F.lit(other), F.substring("text", F.lit(1), n)))
    texts = F.when(F.col("text") != "", F.concat(cut, F.array(F.concat(F.lit(own), F.col("text")))))
    filled = F.flatten(F.transform(texts, lambda t: F.transform(tags, lambda g: F.concat(g, F.lit("\x1f"), t))))
    bare = F.when(~known, F.array().cast("array<string>"))
    if saved:
        bare = bare.when(F.col("text") == "", F.array(F.concat(F.lit("s-"), value))).otherwise(F.array(F.concat(F.lit("c-"), value)))
    else:
        bare = bare.when(F.col("text") == "", F.array(F.concat(F.lit("s-"), value), F.concat(F.lit("c-"), value))).otherwise(F.array(F.concat(F.lit("s-"), value)))
    both = F.concat(F.coalesce(filled, F.array().cast("array<string>")), bare)
    bucket = F.explode(F.transform(both, lambda x: F.md5(F.concat(F.col("post_info"), F.lit("\x1f"), x))))
    return rows.select(*keys, bucket.alias("bucket"), "idx").groupBy(*keys, "bucket", "idx").agg(F.count("*").alias("n"))
def correlated(saved: tuple[np.ndarray, np.ndarray], page: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, votes, first page number) of all pairs of two lists of (numbers in order, how often each), offset being saved
    less page number. Few pairs are counted as such; many by adding the saved numbers up, shifted by each of the page's."""
    (y, m), (x, n) = saved, page
    if len(x) * len(y) <= 1 << 16:
        offset, at, inverse = np.unique((y - x[:, None]).ravel(), return_index=True, return_inverse=True)
        return offset, np.bincount(inverse, (n[:, None] * m).ravel()).astype(np.int64), x[at // len(y)]
    low, wide = int(y[0] - x[-1]), int(y[-1] - y[0]) + 1
    held = np.zeros(wide, np.int64)
    held[y - y[0]] = m
    there = held > 0
    votes = np.zeros(wide + int(x[-1] - x[0]), np.int64)
    first = np.full(len(votes), x[-1], np.int64)
    for number, often in zip(x[::-1].tolist(), n[::-1].tolist(), strict=True):  # the least number is written last
        at = int(y[0]) - number - low
        votes[at : at + wide] += often * held
        first[at : at + wide][there] = number
    some = np.flatnonzero(votes)
    return some + low, votes[some], first[some]


def index_offset(saved: DataFrame, current: DataFrame, by: list[str] | None = None, pages: list[str] | None = None, block: int = 8192) -> DataFrame:
    """For each `by` (columns of both) and page (columns of current alone) the offset (saved idx - current idx) that most
    compatible pairs agree on, its votes and the pairs in all; no row where no pair is compatible. Sightings without a
    post_info match nothing. Ties go to the offset whose first pair comes first in (current, saved) order.

    Two blocks of a few numbers (at most 64 pairs) give a row for a pair, all rows of a batch at once. Of others no pair becomes a
    row: sightings go to buckets that only compatible ones share, a bucket's numbers are held in blocks of
    `block`, and two blocks give one row for each offset between them, at most twice `block`.
    """
    by, pages = by or [], pages or []

    def lengths(df: DataFrame) -> DataFrame:
        own = df.where((blank(F.col("text")) != "") & (blank(F.col("post_info")) != ""))
        return own.groupBy(*by, "post_info").agg(F.collect_set(F.length("text")).alias("lengths"))

    def blocks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        number = F.array_sort(F.collect_list(F.struct("idx", "n"))).alias(name)
        return df.groupBy(*keys, "bucket", F.floor(F.col("idx") / block).alias(f"_{name}")).agg(number)

    met = _sightings(current, [*by, *pages], False, lengths(saved), by)
    history = _sightings(saved, by, True, lengths(current), by).join(met.select(*by, "bucket").distinct(), [*by, "bucket"], "left_semi")
    pairs = blocks(met, [*by, *pages], "page").join(blocks(history, by, "saved"), [*by, "bucket"]).select(*by, *pages, "saved", "page")
    groups = len(by) + len(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(groups + k) for k in (0, 1)]
            sizes = [side.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for side in sides]
            starts = [side.offsets.to_numpy()[:-1].astype(np.int64) for side in sides]
            number, often = ([side.values.field(f).to_numpy() for side in sides] for f in (0, 1))

            def found(at: np.ndarray, offset: np.ndarray, votes: np.ndarray, first: np.ndarray, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = batch.select(range(groups)).take(pa.array(at))
                return pa.RecordBatch.from_arrays([*rows.columns, pa.array(offset), pa.array(votes), pa.array(first)], names=[*by, *pages, "offset", "votes", "first"])

            many = sizes[0] * sizes[1]
            few = np.flatnonzero((many > 0) & (many <= 64))  # pairs of all these rows at once, at most 64 for each
            for rows in np.array_split(few, -(-len(few) // 10_000)) if len(few) else []:
                at = np.repeat(rows, many[rows])
                k = np.arange(len(at)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows])
                y, x = starts[0][at] + k // sizes[1][at], starts[1][at] + k % sizes[1][at]
                yield found(at, number[0][y] - number[1][x], often[0][y] * often[1][x], number[1][x])
            for i in np.flatnonzero(many > 64).tolist():
                held = [tuple(v[side][starts[side][i] : starts[side][i] + sizes[side][i]] for v in (number, often)) for side in (0, 1)]
                offset, votes, first = correlated(*held)
                yield found(np.full(len(offset), i), offset, votes, first)

    schema = T.StructType([*(pairs.schema[c] for c in (*by, *pages)), *T.StructType.fromDDL("offset long, votes long, first long")])
    votes = pairs.mapInArrow(run, schema).groupBy(*by, *pages, "offset").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"))
    best = F.max_by(F.struct("offset", "votes"), F.struct(F.col("votes"), -F.col("first"), -F.col("offset")))
    return votes.groupBy(*by, *pages).agg(best.alias("b"), F.sum("votes").alias("pairs")).select(*by, *pages, "b.offset", "b.votes", "pairs").where("offset is not null")


def plateaus(df: DataFrame, by: list[str], order: str, signature: str, least: int = 4) -> DataFrame:
    """Runs of at least `least` equal signatures in a row: where each starts, ends and how long it is."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.when(F.lag(signature).over(w).eqNullSafe(F.col(signature)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(w))
    return runs.groupBy(*by, "_run").agg(F.first(signature).alias(signature), F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("run_length")).where(F.col("run_length") >= least).drop("_run")


def lowest_date(df: DataFrame, by: list[str], order: str, date: str) -> DataFrame:
    """df with the lowest date seen so far."""
    return df.withColumn("lowest_date", F.min(date).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def before_boundary(df: DataFrame, by: list[str], date: str, bound: Column) -> DataFrame:
    """Groups (screens) all of whose dates lie before the bound: where a collection may stop."""
    return df.groupBy(*by).agg(F.max(date).alias("newest")).where(F.col("newest") < bound)


def assemble(fields: DataFrame, collected: Column, month: tuple[int, int]) -> DataFrame:
    """Review rows of one month from upserted records (idx, Username, Stars, StarMessage, Text, PostInfo), numbered as seq by
    their place in the list; no user's name goes along, all are the same."""
    date, time = displayed_date(F.col("PostInfo"), collected)
    shown, region, device = post_info(F.col("PostInfo"))
    rows = fields.where("idx >= 0").withColumn("_date", date).where((F.year("_date") == month[0]) & (F.month("_date") == month[1]))
    published = F.concat_ws(" ", F.date_format("_date", "yyyy-MM-dd"), F.nullif(time, F.lit("")))
    out = rows.select(F.col("idx").alias("list_pos"), published.alias("published_at"), shown.alias("displayed_at"), star(F.col("Stars")).alias("rating"), F.col("StarMessage").alias("rating_text"), F.col("Text").alias("text"), region.alias("region"), device.alias("device"), F.lit("匿名用户").alias("user"))
    return numbered(out, "seq", "list_pos").select("seq", *out.columns)
