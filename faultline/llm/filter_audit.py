"""Filter interaction audit: what each filter removes in every order of all filters.

Five filters look at whole texts; a document's failures are five bits, its mask.
Whatever the order of the filters, who removes a document follows from its mask
alone, so documents are first counted by (part, mask, good, toxic) and the orders
are worked out on those few counts, which add up.

The filter on identical texts needs the whole table. A counting Bloom sketch goes
before it: each text adds one to ``PROBES`` cells of one block, chosen by its
SHA-256. The counters are summed in the tasks (a sparse sketch of each task's
texts) and merged by block. A text with a cell counted once is unique for sure.
The blocks' cells that were counted twice or more, one bit for each cell, are sent
to the tasks that read the texts, and only the texts whose cells are all set,
the possible repeats, are shuffled. They are grouped by the full text for its
least id, copies combined before the shuffle, and the ids come back to the masks
by digest; two texts under one digest would fail by name.

What is sent is bounded: ``MAX_BLOCKS`` blocks of 64 bytes, about 110 MB as a
hash table, full for 33 million documents. Beyond that the blocks fill up and
more unique texts are shuffled, at worst all of them once; results stay exact.

Defined cases. A null text is empty; empty texts are equal to one another. Only a
strictly smaller id makes a document a copy: rows that share the least id all
stay, and a null id is neither smaller nor larger than any. Each row counts. A
null part is the empty string. A document is good or toxic if any of its label
rows says so; null labels say nothing. An empty table gives no rows. Columns that
are not named are never read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.sources.scratch import stored

FILTERS = "ABCDE"

# Filter conditions: words at least, percent of distinct words at least, percent
# of capitals at most, and the symbols that a text must not hold.
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10
SYMBOLS = "[#$%&*|]"

CELLS = 512  # of one block
PROBES = 4  # cells of one text
BLOCK_TEXTS = 32
MAX_BLOCKS = 1 << 20


def failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text``, which is not null, fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * n_words,
        100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)]
    return sum(bits[1:], bits[0])


def _cells(digest: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a text and its cells there, each once."""
    drawn = F.xxhash64(digest, F.lit(1))
    bits = CELLS.bit_length() - 1
    cells = [F.shiftright(drawn, bits * i).bitwiseAND(CELLS - 1).cast("int") for i in range(PROBES)]
    return F.pmod(F.xxhash64(digest), F.lit(blocks)), F.array_distinct(F.array(*cells))


def repeated_cells(digests: DataFrame, blocks: int) -> DataFrame:
    """(_block, _set): the cells counted twice or more, as bits of 64-bit words."""
    block, cells = _cells(F.col("_digest"), blocks)
    counters = digests.select(block.alias("_block"), F.explode(cells).alias("_cell"))
    twice = counters.groupBy("_block", "_cell").agg(F.count("*").alias("_n")).filter("_n > 1")
    bit = F.expr("shiftleft(1L, _cell % 64)")
    words = [
        F.coalesce(F.bit_or(F.when(F.expr(f"_cell div 64 = {i}"), bit)), F.lit(0).cast("long"))
        for i in range(CELLS // 64)
    ]
    return twice.groupBy("_block").agg(F.array(*words).alias("_set"))


def possible_repeats(texts: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``texts`` that the sketch does not clear, found without a shuffle."""
    block, own = _cells(F.col("_digest"), blocks)
    probed = texts.withColumns({"_block": block, "_cells": own})
    # at most MAX_BLOCKS rows of one length
    probed = probed.join(F.broadcast(cells), "_block")
    is_set = F.forall(
        "_cells",
        lambda c: F.get("_set", F.floor(c / 64).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), c % 64)
        )
        != 0,
    )
    return probed.filter(is_set).select(*texts.columns)


def first_ids(possible: DataFrame) -> DataFrame:
    """(_digest, _first) of every text that stands in several rows."""
    exact = possible.groupBy("_digest", "_text").agg(
        F.min("_key").alias("_first"), F.count("*").alias("_rows")
    )
    clash = F.raise_error(F.concat(F.lit("two texts have the digest "), F.col("_digest")))
    by_digest = exact.groupBy("_digest").agg(
        F.min("_first").alias("_first"), F.sum("_rows").alias("_rows"), F.count("*").alias("_texts")
    )
    one = F.when(F.col("_texts") == 1, F.col("_first")).otherwise(clash.cast("long"))
    return by_digest.filter("_rows > 1").select("_digest", one.alias("_first"))


def _orders(counts: DataFrame) -> DataFrame:
    """One row per count, order and step: the filter's bit and those before it."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    bit_at = f"shiftleft(1, ascii(substring(filter_order, {{}}, 1)) - {ord(FILTERS[0])})"
    n = len(FILTERS)
    before = " + ".join(f"IF(step > {i}, {bit_at.format(i)}, 0)" for i in range(1, n))
    return (
        counts.withColumn("filter_order", F.explode(every))
        .withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, n + 1)])))
        .withColumn("_bit", F.expr(bit_at.format("step")))
        .withColumn("_before", F.expr(before))
    )


def interactions(counts: DataFrame) -> DataFrame:
    """Counts by (part, _mask, _good, _toxic) -> one row per part, order and step."""
    rows = _orders(counts)
    mask, bit, before = F.col("_mask"), F.col("_bit"), F.col("_before")
    fails, reached = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) == 0

    def total(condition: Column, n: Column = F.col("_n")) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    removed = fails & reached
    # of all orders, a text's failed filters come first equally often
    share = F.floor(F.col("_n") * 120 / F.bit_count(mask)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"),
        total(removed).alias("removed"),
        total(fails & ~reached).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(removed & F.col("_good")).alias("good_lost"),
        total(removed & F.col("_toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def filter_audit(
    df: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    part: str = "lang",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """What each filter does at each step of each order, by ``part``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(F.col(key).alias("_key"), whole.alias("_text"), F.col(part).alias("part"))
    texts = texts.withColumn("_digest", F.sha2("_text", 256))
    facts = stored(
        texts.select(
            "_key",
            "_digest",
            F.coalesce("part", F.lit("")).alias("part"),
            failures(F.col("_text")).alias("_mask"),
        ),
        "masks",
    )
    blocks = max(1, min(-(-facts.count() // BLOCK_TEXTS), max_blocks))
    cells = stored(repeated_cells(facts, blocks), "sketch")
    possible = possible_repeats(texts.drop("part"), cells, blocks)
    firsts = first_ids(possible)

    said = labels.groupBy(F.col(key).alias("_labelled")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
    )
    is_copy = F.coalesce(F.col("_key") > F.col("_first"), F.lit(False))
    bit = 1 << FILTERS.index("E")
    flagged = (
        facts.join(firsts, "_digest", "left")
        .join(said, F.col("_key") == F.col("_labelled"), "left")
        .select(
            "part",
            (F.col("_mask") + F.when(is_copy, bit).otherwise(0)).alias("_mask"),
            F.coalesce("_good", F.lit(False)).alias("_good"),
            F.coalesce("_toxic", F.lit(False)).alias("_toxic"),
        )
    )
    counts = flagged.groupBy("part", "_mask", "_good", "_toxic").agg(F.count("*").alias("_n"))
    return interactions(counts)


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))

# The same from the texts themselves, document by document.
ORACLE = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM texts),
masks AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < {MIN_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words)
                THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > {MAX_CAPITALS} * length(text)
                THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM words),
said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, mask, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM masks LEFT JOIN said USING (doc_id)),
counted AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM marked GROUP BY ALL),
orders(filter_order) AS (VALUES {_ORDERS}),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum([CASE WHEN i < step THEN 1 << (ascii(filter_order[i]) - 65) ELSE 0 END
                   FOR i IN [1, 2, 3, 4, 5]])::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
audited AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND good THEN n ELSE 0 END)
           AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 AND toxic THEN n ELSE 0 END)
           AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audited
"""
