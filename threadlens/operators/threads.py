"""Comments as rows, arrays and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.posts import is_self_comment, sentiment_color, thread_node_size
from threadlens.runtime import snapshot

COMMENT_ARRAYS = ["comments_author", "comments_upvote_score", "comments_bodies"]

# A post with more comments than this is stored as several rows, numbered by
# ``part``, so that no single row or task has to hold a whole hot thread. Every row
# carries ``part_start``, the place of its first comment in the thread, and the
# ``comments_num`` of the whole post; what belongs to the post counts in part 0 only.
COMMENTS_PER_ROW = 10_000


def is_first_part(posts: DataFrame) -> Column:
    """True on the row that stands for the post; tables without parts have one row per post."""
    return F.coalesce(F.col("part"), F.lit(0)) == 0 if "part" in posts.columns else F.lit(True)


def part_start(posts: DataFrame) -> Column:
    """The thread place of the row's first comment."""
    return F.coalesce(F.col("part_start"), F.lit(0)) if "part_start" in posts.columns else F.lit(0)


def explode_comments(posts: DataFrame, arrays=COMMENT_ARRAYS) -> DataFrame:
    """One row per comment from parallel arrays; a post without comments keeps one null row.

    Later parts always hold comments, so a post in parts gives the same rows as a post in one row.
    """
    zipped = F.explode_outer(F.arrays_zip(*[F.col(a) for a in arrays])).alias("_c")
    kept = [c for c in posts.columns if c not in (*arrays, "part", "part_start")]
    return posts.select(*kept, zipped).select(*kept, *[F.col(f"_c.{a}").alias(a) for a in arrays])


def with_self_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_self_comment", is_self_comment("post_author", "comments_author"))


def prepare_comments(posts: DataFrame) -> DataFrame:
    return with_self_flag(explode_comments(posts))


def attach_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Comment-level rows from two flat tables, posts without comments kept.

    An inner join, whose hot posts AQE can split, plus the posts that have no comment;
    an outer join could not split its comment side.
    """
    inner = posts.join(comments, "post_id")
    silent = posts.join(comments.select("post_id").distinct(), "post_id", "left_anti")
    return with_self_flag(inner.unionByName(silent, allowMissingColumns=True))


def zip_to_shorter(df: DataFrame, first: str, second: str, name: str = "pairs") -> DataFrame:
    """Positional pairs of two arrays, as many as the shorter one has."""
    pairs = F.arrays_zip(F.col(first), F.col(second))
    return df.withColumn(name, F.slice(pairs, 1, F.least(F.size(first), F.size(second))))


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("comments_num"))


def comment_arrays(comments: DataFrame, per_row: int = COMMENTS_PER_ROW) -> DataFrame:
    """The parallel comment arrays of each post, in thread order.

    ``comment_rank`` is the comment's place in its post, from 0. One row per post and
    ``part`` of ``per_row`` places; the parts in order are the whole list. ``part_start``
    counts the comments before the part, ``comments_num`` those of the whole post.
    """
    fields = {
        "comments_bodies": F.col("body"),
        "comments_lenght": F.length("body"),
        "comments_author": F.col("comments_author"),
        "comments_upvote_score": F.col("comments_upvote_score"),
        "comments_created_utc": F.col("comments_created_utc"),
    }
    present = {
        name: value
        for name, value in fields.items()
        if name in comments.columns or (name in ("comments_bodies", "comments_lenght") and "body" in comments.columns)
    }
    row = F.struct("comment_rank", *[value.alias(name) for name, value in present.items()])
    part = F.floor(F.col("comment_rank") / per_row).cast("int").alias("part")
    grouped = comments.groupBy("post_id", part).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    # one row per post and part from here on
    thread = Window.partitionBy("post_id")
    return grouped.select(
        "post_id",
        "part",
        F.coalesce(F.sum(F.size("_rows")).over(thread.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("part_start"),
        *[F.col(f"_rows.{name}").alias(name) for name in present],
        F.sum(F.size("_rows")).over(thread).cast("int").alias("comments_num"),
    )


def assemble_posts(posts: DataFrame, comments: DataFrame, per_row: int = COMMENTS_PER_ROW) -> DataFrame:
    """Posts with their comment arrays; a post without comments gets empty arrays."""
    arrays = comment_arrays(comments, per_row)
    joined = posts.join(arrays, "post_id", "left").na.fill(0, ["part", "part_start", "comments_num"])
    names = [f.name for f in arrays.schema.fields if f.dataType.typeName() == "array"]
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.array().cast(arrays.schema[n].dataType)) for n in names}
    )


def comment_nodes(posts: DataFrame) -> DataFrame:
    """Node rows of the stored comment map, the post's own stub included."""
    return posts.select("post_id", F.explode("comments_graph").alias("comment_id", "node")).select(
        "post_id", "comment_id", "node.*"
    )


def children_lists(comments: DataFrame, per_row: int = COMMENTS_PER_ROW) -> DataFrame:
    """Ordered children of every comment and post, in parts of ``per_row`` thread places."""
    part = F.floor(F.col("comment_rank") / per_row).cast("int").alias("part")
    grouped = (
        comments.filter(F.col("parent_id").isNotNull())
        .groupBy("post_id", "parent_id", part)
        .agg(F.sort_array(F.collect_list(F.struct("comment_rank", "comment_id"))).alias("_rows"))
    )
    return grouped.select("post_id", "parent_id", "part", F.col("_rows.comment_id").alias("children"))


def comment_tree(comments: DataFrame, per_row: int = COMMENTS_PER_ROW) -> DataFrame:
    """Tree nodes with their children, and a root stub for every post that has comments.

    The stub row has only its id, ``children`` and ``root``; a parent that is itself
    missing gets such a stub too. Nodes repeat per ``part`` of a very long child list.
    """
    lists = children_lists(comments, per_row).withColumnRenamed("parent_id", "comment_id")
    joined = comments.join(lists, ["post_id", "comment_id"], "full")
    is_stub = F.col("comment_rank").isNull()
    return joined.withColumns(
        {
            "part": F.coalesce("part", F.lit(0)),
            "children": F.coalesce("children", F.array().cast("array<string>")),
            "root": F.when(is_stub, True),
        }
    )


def comment_graph(comments: DataFrame, per_row: int = COMMENTS_PER_ROW) -> DataFrame:
    """The stored comment map, keyed by comment id: one row per post and part.

    A node whose children lie in several parts is in each of those rows with the
    children of that part, so no row holds more than a part and no key comes twice.
    """
    tree = comment_tree(comments, per_row)
    own = F.floor(F.coalesce("comment_rank", F.lit(0)) / per_row).cast("int")
    created = F.col("comments_created_utc") if "comments_created_utc" in comments.columns else F.lit(None)
    node = F.struct(
        F.col("comments_author").alias("author"),
        F.when(F.col("root").isNull(), F.col("comment_id")).alias("id"),
        "body",
        created.cast("timestamp").alias("created_utc"),
        "children",
        "parent_id",
        F.col("comments_upvote_score").alias("upvote_score"),
        "root",
    )
    row = F.when(F.size("children") > 0, F.col("part")).otherwise(own)
    entries = F.collect_list(F.struct("comment_id", node))
    return tree.groupBy("post_id", row.alias("part")).agg(F.map_from_entries(entries).alias("comments_graph"))


def thread_nodes(posts: DataFrame) -> DataFrame:
    """Node table of the thread graph from stored comment maps: posts, then comments."""
    post_nodes = posts.select(
        F.col("post_id").alias("id"),
        F.lit("post").alias("type"),
        "subreddit",
        F.col("post_title").alias("title"),
        F.col("post_author").alias("author"),
        F.col("post_text").alias("body"),
    )
    comments = comment_nodes(posts).filter(~F.coalesce(F.col("root"), F.lit(False)))
    nodes = comments.select(
        F.col("comment_id").alias("id"),
        F.lit("comment").alias("type"),
        F.lit(None).cast("string").alias("subreddit"),
        F.lit(None).cast("string").alias("title"),
        "author",
        "body",
    )
    return post_nodes.union(nodes).distinct()


def thread_edges(comments: DataFrame) -> DataFrame:
    """Distinct edges post -> comment and parent -> comment.

    ``comments`` has post_id, comment_id and a bare parent_id. Edges that coincide
    inside a row (a top-level comment) are merged before the shuffle.
    """
    sources = F.array_distinct(F.array_compact(F.array("post_id", "parent_id")))
    return comments.select(F.explode(sources).alias("src"), F.col("comment_id").alias("dst")).distinct()


def thread_edges_from_maps(posts: DataFrame) -> DataFrame:
    comments = comment_nodes(posts).filter(~F.coalesce(F.col("root"), F.lit(False)))
    return thread_edges(comments.select("post_id", "comment_id", "parent_id"))


def reply_levels(comments: DataFrame) -> DataFrame:
    """Reply depth of every comment, 0 for a reply to the post itself.

    Each round doubles the distance every open comment has looked up, so a chain of
    ``n`` replies takes about log2(n) joins; each round writes open rows only. Comments whose chain never reaches the
    post (a missing or circular parent) get a null level.
    """
    top = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("post_id"))
    state = snapshot(
        comments.select(
            "post_id",
            "comment_id",
            F.col("parent_id").alias("up"),
            F.when(top, 0).otherwise(1).cast("long").alias("steps"),
            F.coalesce(top, F.lit(False)).alias("done"),
        ),
        "levels",
    )
    settled = [state.filter("done").select("post_id", "comment_id", "steps")]
    still = state.filter(~F.col("done"))
    open_rows = still.count()
    while open_rows:
        above = settled[-1].select("post_id", F.col("comment_id").alias("up"), F.lit(None).cast("string").alias("_up"), F.col("steps").alias("_steps"), F.lit(True).alias("_done"))
        for earlier in settled[:-1]:
            above = above.unionByName(earlier.select("post_id", F.col("comment_id").alias("up"), F.lit(None).cast("string").alias("_up"), F.col("steps").alias("_steps"), F.lit(True).alias("_done")))
        above = above.unionByName(still.select("post_id", F.col("comment_id").alias("up"), F.col("up").cast("string").alias("_up"), F.col("steps").alias("_steps"), F.lit(False).alias("_done")))
        # An open comment whose parent is missing drops out of the join: it stays unreachable.
        moved = snapshot(
            still.join(above, ["post_id", "up"]).select("post_id", "comment_id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done")),
            "levels",
        )
        settled.append(moved.filter("done").select("post_id", "comment_id", "steps"))
        still = moved.filter(~F.col("done"))
        left = still.count()
        if left == open_rows:
            # Some reachable comment settles in every round, so the rest are circular.
            break
        open_rows = left
    levels = settled[0]
    for found in settled[1:]:
        levels = levels.unionByName(found)
    return comments.join(levels.withColumnRenamed("steps", "level"), ["post_id", "comment_id"], "left")


def breadth_first(levels: DataFrame) -> DataFrame:
    """Comments of each thread level by level, then in thread order."""
    return levels.orderBy("post_id", "level", "comment_rank")


def flat_thread(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts and comments as parent-linked rows, the flat form of a nested thread record."""
    heads = posts.select(
        "post_id",
        F.col("post_id").alias("id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("post_author").alias("author"),
        F.col("post_text").alias("body"),
        F.lit("post").alias("kind"),
    )
    replies = comments.select(
        "post_id",
        F.col("comment_id").alias("id"),
        F.coalesce("parent_id", F.col("post_id")).alias("parent_id"),
        F.col("comments_author").alias("author"),
        "body",
        F.lit("comment").alias("kind"),
    )
    return heads.unionByName(replies)


def attributed_thread(nodes: DataFrame) -> DataFrame:
    """Drawing attributes of thread nodes: label, colour by sentiment, size by votes."""
    is_post = F.col("type") == "post"
    return nodes.withColumns(
        {
            "label": F.col("author"),
            "color": sentiment_color("sentiment"),
            "size": F.when(is_post, thread_node_size("upvote")).otherwise(F.lit(10.0)),
        }
    )
