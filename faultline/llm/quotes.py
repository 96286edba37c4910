"""Quotation linking: conversations in reply order, without quoted text.

All of it is DataFrame work. Messages get a global number in the order of
(conversation, turn), and everything after that goes by this number.

* A line's quote level is the number of ``>`` in front of it. Lines of one level
  that follow each other without a blank line are a passage. Its words, in lower
  case with single spaces, are hashed, so wrapping and spacing do not matter.
* What a message wrote itself is indexed by paragraph, by line and as a whole. A
  quoted passage belongs to the earliest message of its conversation with the
  same hash, if that is earlier than the quoting one. Origins are the least
  number per hash, combined before the shuffle: no pairs are made.
* A passage that is no such unit, as part of a paragraph was quoted or lines were
  wrapped anew, belongs to the earliest message whose own words hold all of its
  words in a run, if it has ``MIN_RUN`` words. For that, every run of as many words
  as one of the conversation's unlinked passages has is hashed in the same way.
* A message answers the origin of its outermost linked passages, the latest one
  if there are several. Without a linked passage it answers the message before.
* Reply order is depth first, answers by turn. Messages that each answer the one
  before form a run, and a run is never interrupted. Only runs are ordered: their
  tour (enter, runs below, leave) is a linked list, ranked by pointer doubling in
  as many rounds as the logarithm of the longest conversation's runs.

No window is over a conversation, so one with a third of all messages is spread
like any other.

Defined cases. A null text stays null and has no passages. Null conversations are
one conversation; null turns come first. Rows with equal turns are in order of
role and text; equal rows count separately. ``reply_to`` is the turn of the
message answered, null for a first message. Blank passages are not linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.sequence import INDEX, add_row_index
from faultline.sources.scratch import stored

# --- fixed values: what stands in front of a quoted line
PREFIX = "^[ ]{0,3}(?:>[ ]?)+"
BLANK = "[ \\t\\x0b\\f\\r]+"

# Words of a passage that may lie inside of what a message wrote: fewer say little.
MIN_RUN = 4

# Messages whose running values one task works out.
BLOCK = 100_000


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, BLANK, " ")))


def _with_passages(messages: DataFrame) -> DataFrame:
    """``messages`` with ``_lines`` (level, raw, body) and ``_passages`` (level, body)."""

    def line(raw: Column) -> Column:
        mark = F.regexp_extract(raw, PREFIX, 0)
        level = F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))
        body = _normal(F.substring(raw, F.length(mark) + 1, F.length(raw)))
        return F.struct(level.alias("level"), raw.alias("raw"), body.alias("body"))

    lined = messages.withColumn("_lines", F.transform(F.split("text", "\n", -1), line))

    def at(i: Column) -> Column:
        return F.get("_lines", i)

    def starts_passage(i: Column) -> Column:
        before = at(i - 1)
        return (
            (i == 0)
            | (at(i)["level"] != before["level"])
            | (at(i)["body"] == "")
            | (before["body"] == "")
        )

    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    started = lined.withColumn("_starts", F.filter(every, starts_passage))

    def passage(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
        bodies = F.transform(F.slice("_lines", start + 1, end - start), lambda x: x["body"])
        return F.struct(
            at(start)["level"].alias("level"), F.array_join(bodies, " ").alias("body")
        )

    passages = F.filter(F.transform("_starts", passage), lambda p: p["body"] != "")
    return started.withColumn("_passages", passages).drop("_starts")


def _origins(messages: DataFrame) -> DataFrame:
    """(conv, hash, origin): the earliest message that wrote each unit itself."""

    def own(name: str) -> Column:
        kept = F.filter(name, lambda x: (x["level"] == 0) & (x["body"] != ""))
        return F.transform(kept, lambda x: x["body"])

    units = F.array_distinct(
        F.concat(own("_passages"), own("_lines"), F.array(F.array_join(own("_passages"), " ")))
    )
    hashed = messages.select("conv", "m", F.explode(units).alias("unit")).filter("unit != ''")
    return hashed.groupBy("conv", F.md5("unit").alias("hash")).agg(F.min("m").alias("origin"))


def _run_origins(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv, hash, origin): the earliest message whose own words hold a run of
    words, of the lengths that ``passages`` (conv, n) have in its conversation."""
    lengths = passages.select(F.col("conv").alias("_c"), "n").distinct()
    own = F.transform(
        F.filter("_passages", lambda x: (x["level"] == 0) & (x["body"] != "")), lambda x: x["body"]
    )
    words = messages.select("conv", "m", F.split(F.array_join(own, " "), " ").alias("words"))
    sized = words.join(lengths, F.col("conv").eqNullSafe(F.col("_c"))).filter(F.size("words") >= F.col("n"))
    firsts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    runs = F.transform(firsts, lambda i: F.md5(F.array_join(F.slice("words", i, F.col("n")), " ")))
    hashed = sized.select("conv", "m", F.explode(F.array_distinct(runs)).alias("hash"))
    return hashed.groupBy("conv", "hash").agg(F.min("m").alias("origin"))


def _links(messages: DataFrame) -> DataFrame:
    """(m, n_linked, parent) of messages with a linked passage."""
    quoted = F.filter("_passages", lambda p: p["level"] > 0)
    quotes = messages.select("conv", "m", F.posexplode(quoted).alias("place", "q")).select(
        "conv",
        "m",
        "place",
        F.col("q.level").alias("level"),
        F.md5("q.body").alias("hash"),
        F.size(F.split("q.body", " ")).alias("n"),
    )
    conversations = quotes.select("conv").distinct()
    quoting = messages.join(
        conversations.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")), "semi"
    )

    def linked(passages: DataFrame, origins: DataFrame) -> DataFrame:
        named = origins.withColumnsRenamed({"conv": "_c", "hash": "_h"})
        same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h"))
        return passages.join(named, same).filter("origin < m").select("m", "place", "level", "origin")

    whole = stored(linked(quotes, _origins(quoting)), "links")
    rest = quotes.filter(F.col("n") >= MIN_RUN).join(whole, ["m", "place"], "left_anti")
    rest = stored(rest.select("conv", "m", "place", "level", "hash", "n"), "unlinked")
    found = whole.unionAll(linked(rest, _run_origins(quoting, rest)))
    best = F.max(F.struct((-F.col("level")).alias("l"), "origin"))["origin"]
    return found.groupBy("m").agg(F.count("*").alias("n_linked"), best.alias("parent"))


def _running_heads(heads: DataFrame, messages: DataFrame) -> DataFrame:
    """(m, run): for each message the last head up to it."""
    marked = messages.select("m").join(heads.select("m", F.col("m").alias("head")), "m", "left")
    marked = marked.withColumn("_block", F.floor(F.col("m") / BLOCK))
    inside = Window.partitionBy("_block").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    # one row per block: a hundred-thousandth of the messages
    last = marked.groupBy("_block").agg(F.max("head").alias("_last"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_block", F.max("_last").over(earlier).alias("_carried"))
    run = F.coalesce(F.max("head").over(inside), F.col("_carried"))
    return marked.join(carried, "_block").select("m", run.alias("run"))


def _offsets(runs: DataFrame) -> DataFrame:
    """(run, offset): messages of the conversation that come before each run.

    ``runs`` has run, length, hook (the message answered) and up (its run); the
    last two are null for a conversation's first run.
    """
    order = runs.filter("up IS NOT NULL").withColumn("_deep", -F.col("hook"))
    siblings = stored(
        add_row_index(order, ["up", "_deep", "run"], keep=["up", "run"], ties="promised"), "siblings"
    )
    following = siblings.select(
        (F.col(INDEX) - 1).alias(INDEX), F.col("up").alias("_up"), F.col("run").alias("_next")
    )
    chained = siblings.join(following, INDEX, "left").select(
        "run",
        "up",
        F.when(F.col("_up") == F.col("up"), F.col("_next")).alias("sibling"),
    )
    first = siblings.groupBy("up").agg(F.min(F.struct(INDEX, "run"))["run"].alias("child"))
    tree = (
        runs.select("run", "length")
        .join(chained, "run", "left")
        .join(first.withColumnRenamed("up", "run"), "run", "left")
    )
    # a run is entered (even) and left (odd)
    entered = tree.select(
        (F.col("run") * 2).alias("e"),
        F.coalesce(F.col("child") * 2, F.col("run") * 2 + 1).alias("next"),
        F.col("length").alias("weight"),
    )
    left = tree.select(
        (F.col("run") * 2 + 1).alias("e"),
        F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("next"),
        F.lit(0).cast("bigint").alias("weight"),
    )
    tour = stored(entered.unionAll(left), "tour")
    while tour.filter("next IS NOT NULL").limit(1).count():
        ahead = tour.select(
            F.col("e").alias("next"), F.col("next").alias("_next"), F.col("weight").alias("_weight")
        )
        tour = stored(
            tour.join(ahead, "next", "left").select(
                "e",
                F.col("_next").alias("next"),
                (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"),
            ),
            "tour",
        )
    # what is left of the conversation from each run on
    return tour.filter("e % 2 = 0").select((F.col("e") / 2).cast("bigint").alias("run"), "weight")


def reply_ordered(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conversation, turn, role, text, n_quotes, n_linked, reply_to, position).

    ``text`` is without its quoted lines; ``position`` counts from 0 in reply
    order within the conversation.
    """
    rows = df.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    numbered = add_row_index(rows, ["conv", "turn", "role", "text"], ties="scan").withColumnRenamed(INDEX, "m")
    messages = stored(_with_passages(numbered), "messages")

    links = _links(messages)
    starts = messages.groupBy("conv").agg(F.min("m").alias("start"), F.count("*").alias("total"))
    starts = starts.withColumnRenamed("conv", "_c")
    narrow = messages.select(
        "conv",
        "turn",
        "m",
        F.coalesce(F.array_size(F.filter("_passages", lambda p: p["level"] > 0)), F.lit(0)).alias(
            "n_quotes"
        ),
    )
    placed = narrow.join(starts, F.col("conv").eqNullSafe(F.col("_c"))).join(links, "m", "left")
    before = F.when(F.col("m") > F.col("start"), F.col("m") - 1)
    placed = stored(
        placed.select(
            "m",
            "turn",
            "start",
            "total",
            "n_quotes",
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            F.coalesce(F.col("parent"), before).alias("parent"),
        ),
        "placed",
    )
    heads = placed.filter("parent IS NULL OR parent != m - 1").select("m", "parent")
    runs_of = stored(_running_heads(heads, placed), "runs")
    lengths = runs_of.groupBy("run").agg(F.count("*").alias("length"))
    up = runs_of.select(F.col("m").alias("parent"), F.col("run").alias("up"))
    runs = heads.join(up, "parent", "left").join(
        lengths.withColumnRenamed("run", "m"), "m"
    ).select(F.col("m").alias("run"), "length", F.col("parent").alias("hook"), "up")
    remaining = _offsets(stored(runs, "runs"))

    turns = placed.select(F.col("m").alias("parent"), F.col("turn").alias("reply_to"))
    ordered = (
        placed.join(runs_of, "m")
        .join(remaining, "run")
        .join(turns, "parent", "left")
        .select(
            "m",
            "n_quotes",
            "n_linked",
            "reply_to",
            (F.col("total") - F.col("weight") + F.col("m") - F.col("run")).alias("position"),
        )
    )
    kept = F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["raw"])
    return messages.join(ordered, "m").select(
        F.col("conv").alias(conversation),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        F.array_join(kept, "\n").alias(text),
        F.col("n_quotes").cast("bigint").alias("n_quotes"),
        "n_linked",
        "reply_to",
        "position",
    )


# The same rules in plain SQL, with a recursive walk; text order as in the reply
# order above. Turns tell the messages of a conversation apart.
ORACLE = r"""
WITH RECURSIVE messages AS (
  SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST,
    turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS m FROM conversations),
lines AS (
  SELECT conv_id, m, raw, i, length(mark) - length(replace(mark, '>', '')) AS level,
         lower(trim(regexp_replace(substr(raw, length(mark) + 1), '[ \t\x0b\f\r]+', ' ', 'g'))) AS body
  FROM (SELECT *, regexp_extract(raw, '^[ ]{0,3}(?:>[ ]?)+') AS mark
        FROM (SELECT conv_id, m, unnest(string_split(text, chr(10))) AS raw,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i
              FROM messages WHERE text IS NOT NULL))),
marked AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level OR body = '' OR lag(body) OVER w = ''
                 THEN 1 ELSE 0 END AS starts
  FROM lines WINDOW w AS (PARTITION BY m ORDER BY i)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY m ORDER BY i) AS p FROM marked),
passages AS (
  SELECT conv_id, m, p, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS body
  FROM numbered GROUP BY conv_id, m, p HAVING string_agg(body, ' ' ORDER BY i) <> ''),
units AS (
  SELECT conv_id, m, body FROM passages WHERE level = 0
  UNION ALL SELECT conv_id, m, body FROM lines WHERE level = 0 AND body <> ''
  UNION ALL SELECT conv_id, m, string_agg(body, ' ' ORDER BY p) FROM passages
            WHERE level = 0 GROUP BY conv_id, m),
origins AS (SELECT conv_id, body, min(m) AS origin FROM units GROUP BY conv_id, body),
units_linked AS (
  SELECT q.m, q.p, q.level, o.origin
  FROM passages q JOIN origins o
    ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.body = o.body AND o.origin < q.m
  WHERE q.level > 0),
wholes AS (
  SELECT conv_id, m, string_agg(body, ' ' ORDER BY p) AS body
  FROM passages WHERE level = 0 GROUP BY conv_id, m),
rest AS (
  SELECT * FROM passages
  WHERE level > 0 AND len(string_split(body, ' ')) >= 4
    AND (m, p) NOT IN (SELECT m, p FROM units_linked)),
runs_linked AS (
  SELECT q.m, q.p, any_value(q.level) AS level, min(o.m) AS origin
  FROM rest q JOIN wholes o
    ON q.conv_id IS NOT DISTINCT FROM o.conv_id
   AND contains(' ' || o.body || ' ', ' ' || q.body || ' ')
  GROUP BY q.m, q.p),
linked AS (
  SELECT m, level, origin FROM units_linked
  UNION ALL SELECT m, level, origin FROM runs_linked WHERE origin < m),
best AS (
  SELECT m, count(*) AS n_linked, arg_max(origin, (-level, origin)) AS parent
  FROM linked GROUP BY m),
parents AS (
  SELECT x.*, coalesce(b.n_linked, 0) AS n_linked,
         coalesce(b.parent, lag(x.m) OVER (PARTITION BY x.conv_id ORDER BY x.m)) AS parent
  FROM messages x LEFT JOIN best b ON x.m = b.m),
walk AS (
  SELECT m, conv_id, [m] AS path FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT c.m, c.conv_id, list_append(w.path, c.m) FROM walk w JOIN parents c ON c.parent = w.m),
clean AS (
  SELECT m, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0) AS text
  FROM lines GROUP BY m),
quoted AS (SELECT m, count(*) AS n_quotes FROM passages WHERE level > 0 GROUP BY m)
SELECT x.conv_id, x.turn, x.role,
       CASE WHEN x.text IS NOT NULL THEN coalesce(t.text, '') END AS text,
       coalesce(q.n_quotes, 0) AS n_quotes, x.n_linked, y.turn AS reply_to,
       row_number() OVER (PARTITION BY x.conv_id ORDER BY w.path) - 1 AS position
FROM parents x JOIN walk w ON x.m = w.m LEFT JOIN parents y ON y.m = x.parent
LEFT JOIN clean t ON t.m = x.m LEFT JOIN quoted q ON q.m = x.m
"""
