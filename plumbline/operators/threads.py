"""Comment threads: flattening nested JSON, roots and their context, sentiment, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import ASSISTED_LABELS, DEFAULT, FINAL_LABELS, RuleSet, contextualize, direct_classify, effective_label, thread_label, topics_for
from plumbline.functions.text import blank, clean, cleaned_reply, parse_count, pick, pseudonym, stable_id
from plumbline.operators.issues import issue, passed, report
from plumbline.operators.ordered import last_before
from plumbline.sources.steps import once

# Fixed values.
PLACEHOLDER = "[图片评论]"
COLUMNS = ["post_id", "post_title", "post_url", "post_published_at", "post_stance", "post_stage", "query", "expected_comments", "collected_comments", "collection_status", "thread_id", "root_text", "comment_id", "parent_id", "user_alias", "level", "text", "likes", "time_location", "rule_sentiment", "context_sentiment", "final_sentiment", "intent", "topics", "reason", "confidence", "needs_review"]
LABELS = {"positive": "正向", "negative": "负向", "mixed": "混合", "neutral": "中性", "undecided": "未判定"}
THREAD_LABELS = ("正向", "负向", "正向为主", "负向为主", "正负并存", "中性/未判定")
# End of the fixed values.


def nearest_roots(df: DataFrame, by: str, order: str, is_root: str, id_column: str) -> DataFrame:
    """df with root_id: the id of the most recent root at or before each row; null before the first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("root_id", F.last(F.when(F.col(is_root), F.col(id_column)), ignorenulls=True).over(w))


def flatten(posts: DataFrame, depth: int = 50) -> DataFrame:
    """A row for each comment of posts(row_idx, post variant): post and comment fields, ids, parent, root, level and ord
    (reading order). Lists of replies are the first of replies, sub_comments and children that is one.

    Each level of nesting is one step of a recursive query, so all posts go down together; `depth` bounds the levels and
    deeper input is an error, never cut; of comments there may be any number (limit all). Missing ids come from a hash of author, text and time; a top-level comment that
    is a reply belongs to its stated root, else to the last root before it, else to its parent.
    """
    spark = posts.sparkSession
    posts.createOrReplaceTempView("_plumbline_posts")
    text = lambda *names: "coalesce(" + ", ".join(f"nullif(try_variant_get(c, '$.{n}', 'string'), '')" for n in names) + ", '')"
    nested = "coalesce(" + ", ".join(f"if(schema_of_variant(variant_get(c, '$.{n}')) like 'ARRAY%', variant_get(c, '$.{n}'), null)" for n in ("replies", "sub_comments", "children")) + ")"
    tree = spark.sql(f"""
        with recursive tree(row_idx, c, path, up, depth) max recursion level {depth} as (
          select p.row_idx, e.value, array(cast(e.pos as int)), cast(null as array<int>), 0
          from _plumbline_posts p, lateral variant_explode(variant_get(p.post, '$.comments')) e
          union all
          select t.row_idx, e.value, array_append(t.path, cast(e.pos as int)), t.path, t.depth + 1
          from tree t, lateral variant_explode({nested.replace("(c,", "(t.c,")}) e
        )
        select row_idx, path, up, depth, {text("comment_id", "id")} given_id, {text("parent_id", "parent_comment_id", "reply_to")} given_parent,
          {text("root_comment_id", "root_id")} given_root, {text("user_id", "profile_url", "author")} who, {text("user_name")} user_name,
          {text("text", "content")} raw_text, {text("time_location", "date", "time")} time_location, {text("likes", "like_count")} likes,
          coalesce(try_variant_get(c, '$.is_reply', 'boolean'), false) is_reply, try_variant_get(c, '$.level', 'int') given_level,
          coalesce(size(try_variant_get(c, '$.image_urls', 'array<string>')), 0) n_images
        from tree where schema_of_variant(c) like 'OBJECT%' limit all""")
    rows = tree.withColumn("comment_id", F.when(clean(F.col("given_id")) != "", clean(F.col("given_id"))).otherwise(stable_id(F.col("who"), F.col("raw_text"), F.col("time_location"))))
    top = rows.where("depth = 0")
    reply = F.col("is_reply") | (F.col("given_parent") != "")
    before = Window.partitionBy("row_idx").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    own_root = F.when(~reply, F.coalesce(F.nullif("given_root", F.lit("")), F.col("comment_id")))
    last_root = F.last(own_root, ignorenulls=True).over(before)
    top = top.select("row_idx", F.col("path")[0].alias("_at"), reply.alias("_top_reply"), F.coalesce(F.nullif("given_root", F.lit("")), last_root, F.nullif("given_parent", F.lit("")), F.col("comment_id")).alias("_root"), F.coalesce(F.nullif(F.coalesce("given_level", F.lit(0)), F.lit(0)), F.when(reply, 1).otherwise(0)).alias("_level"))
    parents = rows.select(F.col("row_idx"), F.col("path").alias("up"), F.col("comment_id").alias("_parent"))
    joined = rows.withColumn("_at", F.col("path")[0]).join(top, ["row_idx", "_at"]).join(parents, ["row_idx", "up"], "left")
    return joined.select(
        "row_idx",
        F.row_number().over(Window.partitionBy("row_idx").orderBy("path")).alias("ord"),
        "comment_id",
        F.when(F.col("given_parent") != "", F.col("given_parent")).otherwise(F.coalesce("_parent", F.lit(""))).alias("parent_id"),
        F.coalesce(F.nullif("given_root", F.lit("")), F.col("_root")).alias("thread_id"),
        (F.col("_level") + F.col("depth")).alias("level"),
        "who",
        "user_name",
        "raw_text",
        "time_location",
        "likes",
        "n_images",
    )


def classify(df: DataFrame, text: str, rules: RuleSet = DEFAULT) -> DataFrame:
    """df with direct, what direct_classify says of the text, and _said, the text without a leading reply to someone: a step of
    its own, so that it is made once and not for each pattern."""
    said = df.withColumn("_said", cleaned_reply(F.col(text)))
    return said.withColumn("direct", direct_classify(F.col("_said"), rules, cleaned=True))


def prepare(posts: DataFrame, salt: str = "", rules: RuleSet = DEFAULT) -> DataFrame:
    """The context-review table of posts(row_idx, post variant): one row per kept comment with post fields, thread, root
    text, sentiment by rule and by context, topics, the reason, and whether a person should look: row_idx, ord and COLUMNS.

    Of one comment id in one post id the first stays, even if its text is empty; rows without text and images go after
    that. Posts that share a post id do not share roots.
    """
    v = lambda *names: pick(*(F.try_variant_get("post", f"$.{n}", "string") for n in names))
    head = posts.select(
        "row_idx",
        F.coalesce(F.nullif(clean(v("note_id", "post_id", "id")), F.lit("")), stable_id(v("title"), v("url", "link"))).alias("post_id"),
        clean(v("title")).alias("post_title"),
        clean(v("url", "link")).alias("post_url"),
        clean(v("published_at", "date")).alias("post_published_at"),
        clean(v("stance", "post_stance")).alias("post_stance"),
        clean(v("stage", "phase")).alias("post_stage"),
        clean(v("query")).alias("query"),
        parse_count(v("expected_comments", "expected_total")).alias("expected_comments"),
        parse_count(v("collected_comments", "collected_total")).alias("collected_comments"),
        clean(v("collection_status", "status")).alias("given_status"),
    )
    expected, collected = F.col("expected_comments"), F.col("collected_comments")
    status = F.when(F.col("given_status") != "", F.col("given_status")).when((expected > 0) & (collected < expected), "部分").otherwise("完整")
    rows = flatten(posts).join(head.withColumn("collection_status", status).drop("given_status"), "row_idx")
    first = F.row_number().over(Window.partitionBy("post_id", "comment_id").orderBy("row_idx", "ord"))
    text = F.when((clean(F.col("raw_text")) == "") & (F.col("n_images") > 0), PLACEHOLDER).otherwise(clean(F.col("raw_text")))
    kept = rows.withColumn("_nth", first).where("_nth = 1").withColumn("text", text).where("text <> ''")
    kept = classify(kept, "text", rules).withColumn("is_root", F.col("level") == 0)
    nothing = F.lit(None).cast("string")
    as_root = contextualize(F.col("_said"), F.col("direct"), nothing, F.col("post_stance"), F.lit(True), rules, cleaned=True)
    seen = Window.partitionBy("row_idx", "thread_id").orderBy("ord")
    kept = kept.withColumn("_as_root", as_root)
    root = lambda c: F.last(F.when(F.col("is_root"), c), ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("root_text", F.coalesce(root(F.col("text")), F.lit(""))).withColumn("_root", root(F.col("_as_root.sentiment")))
    result = F.when(F.col("is_root"), F.col("_as_root")).otherwise(contextualize(F.col("_said"), F.col("direct"), F.col("_root"), F.col("post_stance"), F.lit(False), rules, cleaned=True))
    kept = kept.withColumn("r", result).withColumn("final_sentiment", F.when(F.col("r.sentiment") == "待语境", "").otherwise(F.col("r.sentiment")))
    review = (F.col("final_sentiment") == "") | (F.col("r.confidence") == "低") | (F.col("root_text") == "")
    level = F.when(F.col("level") == 0, "一级评论").otherwise(F.concat(F.lit("回复"), F.col("level").cast("string"), F.lit("级")))
    return kept.select(
        "row_idx", "ord", "post_id", "post_title", "post_url", "post_published_at", "post_stance", "post_stage", "query", "expected_comments", "collected_comments", "collection_status", "thread_id", "root_text", "comment_id", "parent_id",
        pseudonym(salt, F.col("who"), F.col("user_name")).alias("user_alias"), level.alias("level"), "text", parse_count(F.col("likes")).alias("likes"), clean(F.col("time_location")).alias("time_location"),
        F.col("direct.sentiment").alias("rule_sentiment"), F.col("r.sentiment").alias("context_sentiment"), "final_sentiment", F.col("r.intent").alias("intent"), F.array_join(topics_for(F.col("text"), rules), "；").alias("topics"), F.col("r.reason").alias("reason"), F.col("r.confidence").alias("confidence"), F.when(review, "yes").otherwise("no").alias("needs_review"),
    )


def validate(df: DataFrame) -> DataFrame:
    """Findings of a context-review table with row_idx; row numbers count the header as 1."""
    again = F.row_number().over(Window.partitionBy(blank(F.col("post_id")), blank(F.col("comment_id"))).orderBy("row_idx")) > 1
    f = lambda c: blank(F.col(c))
    return report(
        df.withColumn("_again", again),
        F.col("row_idx") + 2,
        [
            *(issue(f(c) == "", "error", "missing", c) for c in ("post_id", "thread_id", "comment_id", "text", "context_sentiment")),
            issue(~f("final_sentiment").isin(*FINAL_LABELS), "error", "vocabulary", "final_sentiment"),
            issue(~f("context_sentiment").isin(*ASSISTED_LABELS), "error", "vocabulary", "context_sentiment"),
            issue(F.col("_again"), "error", "duplicate", "comment_id"),
            issue((f("needs_review") == "yes") & (f("final_sentiment") == ""), "warning", "unresolved"),
            issue((f("level") != "一级评论") & (f("root_text") == ""), "warning", "no_root"),
        ],
    )


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", effective_label(F.col("final_sentiment"), F.col("context_sentiment"))).withColumn("n_likes", parse_count(F.col("likes")))


def thread_labels(df: DataFrame, by: list[str], label: str = "label", names: tuple[str, str, str] = ("正向", "负向", "混合")) -> DataFrame:
    """The label of each thread from its comments' labels."""
    counts = df.groupBy(*by).agg(*(F.count_if(F.col(label) == n).alias(k) for k, n in zip(("_p", "_n", "_m"), names, strict=True)), F.count("*").alias("comments"))
    return counts.select(*by, "comments", thread_label(F.col("_p"), F.col("_n"), F.col("_m")).alias("thread_label"))


def topic_stats(df: DataFrame, labels: tuple[str, ...] = ("正向", "负向", "混合", "中性", "未判定")) -> DataFrame:
    """Per topic: comments, likes and comments of each label. df(topics array, label, n_likes)."""
    t = df.select(F.explode("topics").alias("topic"), "label", "n_likes")
    return t.groupBy("topic").agg(F.count("*").alias("comments"), F.sum("n_likes").alias("likes"), *(F.count_if(F.col("label") == x).alias(f"n_{i}") for i, x in enumerate(labels)))


def sentiment_summary(df: DataFrame, names: tuple[str, str, str] = ("正向", "负向", "混合")) -> DataFrame:
    """One row: comments, posts, threads, counts and likes of positive, negative and mixed labels, their shares of all
    directional ones (4 digits, 0 without any) and the ratio of positive to negative (null without negative)."""
    c = lambda n: F.count_if(F.col("label") == n)
    total = c(names[0]) + c(names[1]) + c(names[2])
    out = [F.count("*").alias("comments"), F.count_distinct("post_id").alias("posts"), F.count_distinct("post_id", "thread_id").alias("threads"), total.alias("directional")]
    for k, n in zip(("positive", "negative", "mixed"), names, strict=True):
        out += [c(n).alias(k), F.coalesce(F.sum(F.when(F.col("label") == n, F.col("n_likes"))), F.lit(0)).alias(f"likes_{k}"), F.coalesce(F.round(F.try_divide(c(n), total), 4), F.lit(0.0)).alias(f"share_{k}")]
    return df.agg(*out, F.round(F.try_divide(c(names[0]), c(names[1])), 4).alias("ratio"))


def coverage(df: DataFrame) -> DataFrame:
    """Expected and collected comments, summed over the first row of each post."""
    first = df.groupBy("post_id").agg(F.min_by(F.struct("expected_comments", "collected_comments"), F.col("row_idx")).alias("f"))
    return first.agg(F.sum(parse_count(F.col("f.expected_comments"))).alias("expected_comments"), F.sum(parse_count(F.col("f.collected_comments"))).alias("collected_comments"), F.count("*").alias("posts"))


def top_posts(df: DataFrame, k: int | None = 15) -> DataFrame:
    """The k posts (None: all) with most comments, then most likes, then least id."""
    out = df.groupBy("post_id").agg(F.count("*").alias("comments"), F.sum("n_likes").alias("likes"))
    return out if k is None else out.orderBy(F.desc("comments"), F.desc("likes"), "post_id").limit(k)


def summary(df: DataFrame) -> DataFrame:
    """One row of totals of labelled rows: posts, threads, comments, coverage summed over the first row of each post, counts
    and likes of all five labels, directional comments with their shares (4 digits, 0 without any), the ratio of positive
    to negative (null without negative), rows that need review and undecided ones. df has the columns of prepare()."""
    count = lambda n: F.count_if(F.col("label") == n)
    directional = count(LABELS["positive"]) + count(LABELS["negative"]) + count(LABELS["mixed"])
    totals = [F.count_distinct("post_id").alias("posts"), F.count_distinct("post_id", "thread_id").alias("threads"), F.count("*").alias("comments"), directional.alias("directional")]
    for k, n in LABELS.items():
        totals += [count(n).alias(k), F.coalesce(F.sum(F.when(F.col("label") == n, F.col("n_likes"))), F.lit(0)).alias(f"likes_{k}")]
    totals += [F.coalesce(F.round(F.try_divide(count(LABELS[k]), directional), 4), F.lit(0.0)).alias(f"share_{k}") for k in ("positive", "negative", "mixed")]
    totals += [F.round(F.try_divide(count(LABELS["positive"]), count(LABELS["negative"])), 4).alias("ratio"), F.count_if(F.col("needs_review") == "yes").alias("needs_review"), count(LABELS["undecided"]).alias("unresolved")]
    return df.agg(*totals).crossJoin(F.broadcast(coverage(df).drop("posts")))  # one row each


def summarize(df: DataFrame) -> dict[str, DataFrame]:
    """The summaries of a context-review table (row_idx and the columns of prepare(), as text): totals, topics, threads
    (how many have which label) and posts (all, most comments first). A table with findings that are errors is refused.
    The table is computed once, as all of these read it."""
    df = once(df, "threads")
    issues = validate(df)
    if not passed(issues):
        raise ValueError("the table has errors: " + ", ".join(sorted({f"{r['code']} {r['field']}".strip() for r in issues.where("severity = 'error'").select("code", "field").distinct().collect()})))
    rows = labelled(df)
    with_topics = rows.withColumn("topics", F.filter(F.split(blank(F.col("topics")), "；"), lambda x: x != ""))
    per_thread = thread_labels(rows, ["post_id", "thread_id"], "label", (LABELS["positive"], LABELS["negative"], LABELS["mixed"]))
    heads = rows.groupBy("post_id").agg(F.min_by(F.struct("post_title", "post_url"), "row_idx").alias("h")).select("post_id", "h.post_title", "h.post_url")
    return {
        "totals": summary(rows),
        "topics": topic_stats(with_topics, tuple(LABELS.values())),
        "threads": per_thread.groupBy("thread_label").agg(F.count("*").alias("n")),
        "posts": top_posts(rows, None).join(heads, "post_id"),
    }


def merge_queries(posts: DataFrame) -> DataFrame:
    """One row per post with all queries that found it (queries: sorted, joined) and every other field of its first row."""
    others = [c for c in posts.columns if c not in ("post_id", "query")]
    merged = posts.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_set("query")), "；").alias("queries"), F.min_by(F.struct(*others), "row_idx").alias("_first"))
    return merged.select("post_id", "queries", *(F.col(f"_first.{c}").alias(c) for c in others))


def resume(posts: DataFrame, done: DataFrame) -> DataFrame:
    """Posts not collected before."""
    return posts.join(done.select("post_id").distinct(), "post_id", "left_anti")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, post variant) of a JSON list, or of posts, items or data of a JSON object; entries that are no objects
    are dropped, another payload is an error."""
    from plumbline.sources.readers import json_records

    return json_records(spark, path, ("posts", "items", "data")).withColumnRenamed("record", "post")


def dom_comments(df: DataFrame, key: str, order: str, fields: list[str], is_root: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Comments seen again and again while a page scrolls: one row per key at its first position with its last fields, and
    how often it was seen. Positions are the order of first sight, a whole number. by: columns that name the page; keys and
    nesting of different pages have nothing to do with each other.

    With is_root (a boolean column), the page's nesting too: parent is the key of the last root seen before the comment's
    first position, null for roots and for replies before any root; kind is root or reply. A page of any length is looked at
    in stretches.
    """
    by = by or []
    extra = [] if is_root is None else [F.min_by(F.col(is_root), order).alias("_root")]
    out = df.groupBy(*by, key).agg(F.min(order).alias("position"), *(F.max_by(f, order).alias(f) for f in fields), F.count("*").alias("seen"), *extra)
    if is_root is None:
        return out
    nested = last_before(out, "parent", F.when(F.col("_root"), F.col(key)), "position", by)
    return nested.withColumn("parent", F.when(~F.col("_root"), F.col("parent"))).withColumn("kind", F.when(F.col("_root"), "root").otherwise("reply")).drop("_root")


def envelope(post: dict, comments: DataFrame, fields: dict[str, str], most: int = 100_000) -> dict:
    """The JSON object of one collected post: its own fields, how many comments were expected and seen, its status, and the
    comments with their replies below them, fields renamed as given (column: name). A post with over `most` comments is an
    error, not cut."""
    rows = comments.orderBy("position").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} comments in one post")
    key = comments.columns[0]
    named = lambda r: {name: r[c] for c, name in fields.items()} | {"comment_id": r[key]}
    top: dict = {}
    for r in rows:
        if r["kind"] == "root" or r["parent"] is None:
            top[r[key]] = named(r) | {"is_reply": r["kind"] == "reply", "replies": []}
        else:
            top[r["parent"]]["replies"].append(named(r) | {"parent_id": r["parent"], "is_reply": True})
    expected = int(post.get("expected_comments") or 0)
    status = "部分" if 0 < expected and len(rows) < expected else "完整"
    return post | {"collected_comments": len(rows), "collection_status": status, "comments": list(top.values())}


def completeness(df: DataFrame) -> DataFrame:
    """Per post of df(post_id, expected, collected): the status 完整 or 部分, unknown expectations counting as complete."""
    status = F.when((F.coalesce("expected", F.lit(0)) > 0) & (F.coalesce("collected", F.lit(0)) < F.col("expected")), "部分").otherwise("完整")
    return df.withColumn("collection_status", status)
