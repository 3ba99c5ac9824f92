"""Comment arrays, trees and thread graphs over the conversations."""

from pyspark.sql import functions as F

from driver_queries.adapters import MESSAGES, messages, replies, thread_posts
from driver_queries.registry import query
from threadlens.functions.posts import sentiment_color, thread_node_size
from threadlens.operators import threads
from threadlens.runtime import snapshot

SEP = " | "


@query(
    "comment_arrays",
    f"""WITH {MESSAGES} SELECT post_id, (comment_rank // 3)::INT AS part,
      md5(string_agg(body, '{SEP}' ORDER BY comment_rank)) AS bodies,
      string_agg(length(body)::VARCHAR, '{SEP}' ORDER BY comment_rank) AS lengths,
      string_agg(comments_author, '{SEP}' ORDER BY comment_rank) AS authors,
      (sum(count(*)) OVER (PARTITION BY post_id))::INT AS comments_num, (min(comment_rank))::INT AS part_start
    FROM replies GROUP BY 1, 2""",
)
def comment_arrays(spark, sf):
    arrays = threads.comment_arrays(replies(spark, sf), per_row=3)
    return arrays.select(
        "post_id",
        "part",
        F.md5(F.array_join("comments_bodies", SEP)).alias("bodies"),
        F.array_join(F.col("comments_lenght").cast("array<string>"), SEP).alias("lengths"),
        F.array_join("comments_author", SEP).alias("authors"),
        "comments_num",
        "part_start",
    )


@query(
    "comment_counts",
    "SELECT l_orderkey AS post_id, count(*) AS comments_num FROM lineitem GROUP BY 1",
)
def comment_counts(spark, sf):
    from driver_queries.adapters import comments

    return threads.comment_counts(comments(spark, sf))


@query(
    "exploded_comments",
    f"""WITH {MESSAGES} SELECT p.post_id, r.comments_author, r.comments_upvote_score,
      coalesce(p.comments_author = r.comments_author, false) AS is_self_comment
    FROM messages p LEFT JOIN replies r USING (post_id) WHERE p.turn = 0""",
)
def exploded_comments(spark, sf):
    nested = threads.assemble_posts(thread_posts(spark, sf), replies(spark, sf))
    rows = threads.prepare_comments(nested)
    return rows.select("post_id", "comments_author", "comments_upvote_score", "is_self_comment")


@query(
    "zip_to_shorter",
    f"""WITH {MESSAGES} SELECT post_id, comments_author AS author, md5(body) AS body
    FROM (SELECT *, max(comment_rank) OVER (PARTITION BY post_id) AS last FROM replies) WHERE comment_rank < last""",
)
def zip_to_shorter(spark, sf):
    nested = threads.assemble_posts(thread_posts(spark, sf), replies(spark, sf))
    short = nested.withColumn(
        "comments_author", F.slice("comments_author", 1, F.greatest(F.size("comments_author") - 1, F.lit(0)))
    )
    pairs = threads.zip_to_shorter(short, "comments_bodies", "comments_author")
    return pairs.select("post_id", F.explode("pairs").alias("p")).select(
        "post_id", F.col("p.comments_author").alias("author"), F.md5("p.comments_bodies").alias("body")
    )


def in_parts(spark, sf):
    """Threads stored in rows of three comments."""
    return threads.assemble_posts(thread_posts(spark, sf), replies(spark, sf), per_row=3)


@query(
    "post_and_comment_documents",
    f"""WITH {MESSAGES} SELECT post_id || '#' || turn AS text_id, md5(body) AS text FROM messages""",
)
def post_and_comment_documents(spark, sf):
    from threadlens.operators import corpus

    return corpus.post_and_comment_texts(in_parts(spark, sf)).select("text_id", F.md5("text").alias("text"))


@query(
    "authored_documents",
    f"""WITH {MESSAGES} SELECT post_id || '#' || turn AS text_id, comments_author AS author, md5(body) AS text,
      CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS kind FROM messages""",
)
def authored_documents(spark, sf):
    from threadlens.operators import corpus

    return corpus.authored_texts(in_parts(spark, sf)).select("text_id", "author", F.md5("text").alias("text"), "kind")


@query(
    "limited_arrays",
    f"""WITH {MESSAGES} SELECT post_id, comment_rank AS place, md5(body) AS body FROM replies WHERE comment_rank < 4""",
)
def limited_arrays(spark, sf):
    from threadlens.operators.selection import limit_comment_arrays

    cut = limit_comment_arrays(in_parts(spark, sf), 4, ["comments_bodies"])
    rows = cut.select("post_id", "part_start", F.posexplode("comments_bodies").alias("at", "body"))
    return rows.select("post_id", (F.col("part_start") + F.col("at")).cast("long").alias("place"), F.md5("body").alias("body"))


@query(
    "community_documents",
    f"""WITH {MESSAGES}, c AS (SELECT post_id, sum(length(regexp_replace(lower(body), '[^a-z]', '', 'g'))) AS letters FROM messages GROUP BY 1)
    SELECT post_id, letters::BIGINT AS letters FROM c""",
)
def community_documents(spark, sf):
    """Tokens of a post by part: their letters are those of the whole thread."""
    from threadlens.operators.topics import community_tokens

    rows = community_tokens(in_parts(spark, sf))
    letters = F.length(F.regexp_replace(F.array_join("tokens", ""), "[^a-z]", "")).cast("long")
    return rows.groupBy("post_id").agg(F.sum(letters).alias("letters"))


@query(
    "children_lists",
    f"""WITH {MESSAGES} SELECT post_id, parent_id, (comment_rank // 4)::INT AS part,
      string_agg(comment_id, '{SEP}' ORDER BY comment_rank) AS children FROM replies GROUP BY 1, 2, 3""",
)
def children_lists(spark, sf):
    lists = threads.children_lists(replies(spark, sf), per_row=4)
    return lists.withColumn("children", F.array_join("children", SEP))


@query(
    "comment_tree",
    f"""WITH {MESSAGES}, lists AS (
      SELECT parent_id, string_agg(comment_id, '{SEP}' ORDER BY comment_rank) AS children FROM replies GROUP BY 1)
    SELECT m.post_id, m.comment_id, m.parent_id, CASE WHEN turn > 0 THEN m.comments_author END AS author,
      coalesce(children, '') AS children, CASE WHEN turn = 0 THEN true END AS root
    FROM messages m LEFT JOIN lists l ON l.parent_id = m.comment_id WHERE turn > 0 OR children IS NOT NULL""",
)
def comment_tree(spark, sf):
    tree = threads.comment_tree(replies(spark, sf))
    return tree.select(
        "post_id",
        "comment_id",
        "parent_id",
        F.col("comments_author").alias("author"),
        F.array_join("children", SEP).alias("children"),
        "root",
    )


EDGES = """edges AS (SELECT post_id AS src, comment_id AS dst FROM replies
  UNION SELECT parent_id, comment_id FROM replies)"""


@query("thread_edges", f"WITH {MESSAGES}, {EDGES} SELECT src, dst FROM edges")
def thread_edges(spark, sf):
    return threads.thread_edges(replies(spark, sf))


def stored_maps(spark, sf, per_row=threads.COMMENTS_PER_ROW):
    """Posts with their comment map, as a collector stores them; very long threads in parts."""
    return thread_posts(spark, sf).join(threads.comment_graph(replies(spark, sf), per_row), "post_id", "left")


@query(
    "stored_maps",
    f"""WITH {MESSAGES}, kids AS (SELECT parent_id AS comment_id, string_agg(comment_id, '{SEP}' ORDER BY comment_id) AS children
      FROM replies GROUP BY 1)
    SELECT p.post_id, m.comment_id, md5(CASE WHEN m.turn > 0 THEN m.body END) AS body, coalesce(k.children, '') AS children, m.turn = 0 AS root
    FROM messages m JOIN messages p ON p.post_id = m.post_id AND p.turn = 0 LEFT JOIN kids k ON k.comment_id = m.comment_id
    WHERE m.turn > 0 OR k.children IS NOT NULL""",
)
def stored_map_facts(spark, sf):
    """Every node of maps stored in parts of three places, its children put together again."""
    nodes = threads.comment_nodes(stored_maps(spark, sf, per_row=3))
    whole = nodes.groupBy("post_id", "comment_id").agg(
        F.md5(F.max("body")).alias("body"), F.sort_array(F.flatten(F.collect_list("children"))).alias("children"), F.coalesce(F.bool_or("root"), F.lit(False)).alias("root")
    )
    return whole.withColumn("children", F.array_join("children", SEP))


@query("thread_edges_from_maps", f"WITH {MESSAGES}, {EDGES} SELECT src, dst FROM edges")
def thread_edges_from_maps(spark, sf):
    return threads.thread_edges_from_maps(stored_maps(spark, sf))


@query(
    "thread_nodes",
    f"""WITH {MESSAGES} SELECT comment_id AS id, CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS type,
      comments_author AS author, md5(body) AS body FROM messages""",
)
def thread_nodes(spark, sf):
    nodes = threads.thread_nodes(stored_maps(spark, sf))
    return nodes.select("id", "type", "author", F.md5("body").alias("body"))


LEVELS = """RECURSIVE levels AS (
  SELECT post_id, comment_id, 0 AS level FROM replies WHERE parent_id = post_id
  UNION ALL SELECT r.post_id, r.comment_id, level + 1 FROM replies r JOIN levels l ON r.parent_id = l.comment_id)"""


@query(
    "thread_levels",
    f"WITH RECURSIVE {MESSAGES}, {LEVELS.replace('RECURSIVE ', '')} SELECT post_id, comment_id, level::BIGINT AS level FROM levels",
)
def thread_levels(spark, sf):
    return threads.reply_levels(replies(spark, sf)).select("post_id", "comment_id", "level")


@query(
    "thread_breadth_first",
    f"""WITH RECURSIVE {MESSAGES}, {LEVELS.replace('RECURSIVE ', '')}
    SELECT post_id, comment_id, row_number() OVER (PARTITION BY post_id ORDER BY level, comment_rank) AS place
    FROM levels JOIN replies USING (post_id, comment_id)""",
)
def thread_breadth_first(spark, sf):
    from threadlens.operators.ranking import rank_rows

    levels = threads.breadth_first(threads.reply_levels(replies(spark, sf)))
    ranked = rank_rows(levels, [F.col("level"), F.col("comment_rank")], ["post_id"], "place")
    return ranked.select("post_id", "comment_id", "place")


@query(
    "chain_levels",
    """WITH RECURSIVE links AS (
      SELECT user_id::VARCHAR AS post_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
    SELECT post_id, id AS comment_id, place - 1 AS level FROM links""",
)
def chain_levels(spark, sf):
    """Every user's events as one long chain of replies: hundreds of levels deep."""
    from driver_queries.adapters import table
    from threadlens.operators.ranking import rank_rows

    events = table(spark, sf, "events").select("user_id", "event_id")
    placed = snapshot(rank_rows(events, [F.col("event_id")], ["user_id"], "place"), "places")
    before = placed.select("user_id", (F.col("place") + 1).alias("place"), F.col("event_id").alias("before"))
    chain = placed.join(before, ["user_id", "place"], "left").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("post_id"),
        F.col("event_id").cast("string").alias("comment_id"),
        F.col("before").cast("string").alias("parent_id"),
    )
    levels = threads.reply_levels(snapshot(chain, "chain"))
    return levels.select(
        F.substring("post_id", 2, 20).alias("post_id"), F.col("comment_id").cast("long").alias("comment_id"), "level"
    )


@query(
    "flat_threads",
    f"""WITH {MESSAGES} SELECT post_id, comment_id AS id, parent_id, comments_author AS author,
      CASE WHEN turn = 0 THEN 'post' ELSE 'comment' END AS kind FROM messages""",
)
def flat_threads(spark, sf):
    flat = threads.flat_thread(thread_posts(spark, sf), replies(spark, sf))
    return flat.select("post_id", "id", "parent_id", "author", "kind")


@query(
    "thread_attributes",
    f"""WITH {MESSAGES}, s AS (SELECT *, CASE length(body) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unknown' END AS sentiment FROM messages)
    SELECT comment_id AS id, CASE sentiment WHEN 'positive' THEN '#1B9E77' WHEN 'negative' THEN '#ec7215' ELSE '#97c2fc' END AS color,
      round(CASE WHEN turn = 0 THEN 10 + 20 * ln(greatest(comments_upvote_score, 1)) ELSE 10 END, 6) AS size FROM s""",
)
def thread_attributes(spark, sf):
    kind = F.when(F.col("turn") == 0, "post").otherwise("comment")
    sentiment = F.element_at(
        F.array(F.lit("positive"), F.lit("negative"), F.lit("unknown")), F.length("body") % 3 + 1
    )
    nodes = messages(spark, sf).select(
        F.col("comment_id").alias("id"),
        kind.alias("type"),
        F.col("comments_author").alias("author"),
        sentiment.alias("sentiment"),
        F.col("comments_upvote_score").alias("upvote"),
    )
    return threads.attributed_thread(nodes).select("id", "color", F.round("size", 6).alias("size"))


@query(
    "node_sizes",
    "SELECT o_orderkey, round(10 + 20 * ln(greatest(o_totalprice, 1)), 6) AS size, '#97c2fc' AS color FROM orders",
)
def node_sizes(spark, sf):
    from driver_queries.adapters import table

    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.round(thread_node_size("o_totalprice"), 6).alias("size"),
        sentiment_color(F.lit("unknown")).alias("color"),
    )
