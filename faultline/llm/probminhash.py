"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles, weighted by how often each
occurs. The probability Jaccard similarity

    J_P(x, y) = sum over d of 1 / sum over d' of max(x_d'/x_d, y_d'/y_d)

is what ProbMinHash estimates: every shingle sends points at the times of a
Poisson process whose rate is its weight, each point lands in a random component
of the signature, and a component keeps the shingle that came first. A shingle
stops as soon as its next point is later than all first arrivals of its text.
Without repeated shingles J_P is the plain Jaccard similarity.

Steps, each over narrow tables:

1. Texts with equal words are one node. Only nodes get signatures into bands.
2. Nodes that share a band's value share a bucket. In each bucket all members are
   compared with one centre, the member that shares its other buckets with the
   most nodes, and not with each other.
3. Compared means: the exact J_P of the whole texts is at least ``SIMILARITY``.
   Links join into classes.
4. What a bucket still holds of other classes than its most frequent one is
   compared with all members of other classes in the bucket, so that no link
   between classes is lost: by signatures of 512 components in blocks of bounded
   size, and then by the texts where these come near ``SIMILARITY``. Pairs that
   do not come near are never rows.

Defined cases. Words are compared with A-Z in lower case. Texts of under five
words have no shingles and are only alike if their words are equal. Null texts
and texts without words are alike to none. A class is named by its least key;
rows that repeat a key and text are in one class. Null keys come first, so a
class that holds one has a null name.
"""

from __future__ import annotations

from contextlib import contextmanager
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.tokens import byte_texts, carried, mixed, shingles, text_slices
from faultline.sources.scratch import stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
BAND_ROWS = 6
MARKS = 512  # components of the long signatures
REST_BLOCK = 256
OTHER_BLOCK = 4096


def weighted_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), one entry for each distinct shingle of a text."""
    found, counts = shingles(texts, SHINGLE)
    text_of = np.repeat(np.arange(len(texts)), counts)
    frame = pd.DataFrame({"text": text_of, "shingle": found})
    weights = frame.groupby(["text", "shingle"], sort=False).size()
    return (
        weights.index.get_level_values(0).to_numpy(np.int64),
        weights.index.get_level_values(1).to_numpy(np.uint64),
        weights.to_numpy(np.float64),
    )


def signatures(
    text_of: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_texts: int, size: int
) -> np.ndarray:
    """ProbMinHash signatures: for each text and component the first element."""
    first = np.full(n_texts * size, np.inf)
    winner = np.zeros(n_texts * size, np.uint64)
    latest = np.full(n_texts, np.inf)
    time = np.zeros(len(elements))
    alive, draw = np.arange(len(elements)), 0
    while len(alive):
        draw += 1
        element, text = elements[alive], text_of[alive]
        bits = mixed(element + np.uint64(draw * 0x9E3779B97F4A7C15 % 2**64))
        uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        now = time[alive] - np.log(uniform) / weights[alive]
        time[alive] = now
        early = now < latest[text]
        alive, element, text, now = alive[early], element[early], text[early], now[early]
        component = mixed(bits[early] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(size)
        slot = text * size + component.astype(np.int64)
        np.minimum.at(first, slot, now)
        won = now == first[slot]
        winner[slot[won]] = element[won]
        seen = np.unique(text)
        latest[seen] = first.reshape(n_texts, size)[seen].max(axis=1)
    return winner.reshape(n_texts, size)


def band_values(texts: list[bytes], bands: int = BANDS, rows: int = BAND_ROWS) -> list[list[int]]:
    """The bucket of each band of each text; none for a text without shingles."""
    text_of, elements, weights = weighted_shingles(texts)
    some = np.zeros(len(texts), bool)
    some[text_of] = True
    signature = signatures(text_of, elements, weights, len(texts), bands * rows)
    folded = np.zeros((len(texts), bands), np.uint64)
    for j in range(rows):
        folded = mixed(folded * np.uint64(0x9E3779B97F4A7C15) + signature[:, j::rows])
    folded = mixed(folded + np.arange(bands, dtype=np.uint64)).view(np.int64)
    return [folded[i].tolist() if some[i] else [] for i in range(len(texts))]


SKETCH_TYPE = "struct<node:binary,buckets:array<bigint>>"


def sketch_column(text: Column) -> Column:
    """``node`` (digest of the words, null without any) and the text's buckets."""

    def sketch(column: pa.Array) -> pa.Array:
        texts = byte_texts(column)
        nodes, buckets = [], []
        for a, b in text_slices(texts):
            buckets += band_values(texts[a:b])
            for text in texts[a:b]:
                words = b" ".join(text.lower().split())
                nodes.append(md5(words).digest() if words else None)
        kinds = [pa.array(nodes, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(kinds, ["node", "buckets"])

    return F.arrow_udf(sketch, SKETCH_TYPE).asNondeterministic()(text)


def probability_jaccard(
    x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]
) -> float:
    """Exact J_P of two weighted sets, each (sorted distinct elements, weights)."""
    common, in_x, in_y = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_x = x[1].sum() - x[1][in_x].sum()
    only_y = y[1].sum() - y[1][in_y].sum()
    a, b = x[1][in_x], y[1][in_y]
    order = np.argsort(b / a, kind="stable")
    a, b, ratio = a[order], b[order], (b / a)[order]
    # elements up to a ratio weigh by x, those beyond it by y
    upto = np.searchsorted(ratio, ratio, side="right")
    by_x = np.concatenate([[0.0], np.cumsum(a)])[upto] + only_x
    total_y = b.sum()
    by_y = total_y - np.concatenate([[0.0], np.cumsum(b)])[upto] + only_y
    return float((1.0 / (by_x / a + by_y / b)).sum())


def similarity_column(one: Column, other: Column) -> Column:
    """Exact J_P of two texts."""

    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        def sets(column):
            # a centre stands beside many texts: work each one out once
            coded = column.dictionary_encode()
            texts = byte_texts(coded.dictionary)
            found = []
            for a, b in text_slices(texts):
                text_of, element, weight = weighted_shingles(texts[a:b])
                order = np.lexsort((element, text_of))
                ends = np.searchsorted(text_of[order], np.arange(b - a + 1))
                found += [
                    (element[order[i:j]], weight[order[i:j]])
                    for i, j in zip(ends[:-1], ends[1:], strict=True)
                ]
            return [found[i] for i in coded.indices.to_pylist()]

        return pa.array(
            [probability_jaccard(x, y) for x, y in zip(sets(left), sets(right), strict=True)],
            pa.float64(),
        )

    return F.arrow_udf(compare, "double").asNondeterministic()(one, other)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows per Arrow batch for the jobs inside, as pairs of texts are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``node``, ``other``) that are similar enough."""
    near = texts.select(F.col("node"), F.col("_text").alias("_near"))
    far = texts.select(F.col("node").alias("other"), F.col("_text").alias("_far"))
    both = pairs.join(near, "node").join(far, "other")
    scored = both.select("node", "other", similarity_column(F.col("_near"), F.col("_far")).alias("s"))
    with batches_of(pairs.sparkSession, 500):
        # sums of fractions may end just below a limit they reach
        alike = F.round("s", 9) >= SIMILARITY
        return stored(scored.filter(alike).select("node", "other"), "links")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``_key``, ``_hash`` (of the text), ``class_key`` and ``class_hash``.

    One row for each row of ``df``. (``class_key``, ``class_hash``) is the least
    key and hash of the class.
    """
    sketched = df.select(
        F.col(key).alias("_key"),
        F.xxhash64(text).alias("_hash"),
        sketch_column(F.col(text)).alias("_sketch"),
    ).select("_key", "_hash", "_sketch.*")
    rows = stored(sketched, "sketches")

    place = F.struct(F.col("_key").isNotNull().alias("some"), "_key", "_hash")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(place).alias("_first"), F.min("buckets").alias("buckets")
    )
    nodes = stored(nodes, "nodes")
    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(entries.join(sizes, "bucket"), "members")

    # the first place of each node that shares a bucket, with its text
    wanted = members.select("node").distinct().join(nodes, "node").select(
        "node", F.col("_first._key").alias("_k"), F.col("_first._hash").alias("_h")
    )
    own = df.select(F.col(key).alias("_own"), F.col(text).alias("_text"))
    texts = own.join(
        wanted,
        F.col("_own").eqNullSafe(F.col("_k")) & (F.xxhash64("_text") == F.col("_h")),
    )
    # rows that repeat a key and text
    texts = stored(texts.select("node", "_text").dropDuplicates(["node"]), "texts")

    shared = members.groupBy("node").agg(F.sum("n").alias("_shared"))
    ranked = members.join(shared, "node")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("_shared", "node"))["node"].alias("other"))
    stars = members.join(centres, "bucket").filter("node != other").select("node", "other").distinct()
    links = _verified(stars, texts)

    labels = stored(components(links, "node", "other"), "labels")
    placed = stored(_labelled(members, labels), "placed")
    left = _across(placed, nodes, texts).join(stars.unionAll(stars.select("other", "node")), ["node", "other"], "anti")
    # the labels so far are links as well, and already as short as can be
    more = labels.select("node", F.col("label").alias("other")).unionAll(_verified(left, texts))
    labels = components(more, "node", "other")
    labelled = stored(_labelled(nodes.select("node", "_first"), labels), "labelled")
    names = labelled.groupBy("label").agg(F.min("_first").alias("_name"))
    named = labelled.join(names, "label").select("node", "_name")
    return rows.join(named, "node", "left").select(
        "_key",
        "_hash",
        F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("_name._key")).alias("class_key"),
        F.coalesce("_name._hash", "_hash").alias("class_hash"),
    )


def mark_column(text: Column) -> Column:
    """A long signature of each text, 16 bits for each of ``MARKS`` components."""

    def mark(column: pa.Array) -> pa.Array:
        texts, out = byte_texts(column), []
        for a, b in text_slices(texts):
            text_of, elements, weights = weighted_shingles(texts[a:b])
            found = signatures(text_of, elements, weights, b - a, MARKS).astype(np.uint16)
            out += [row.tobytes() for row in found]
        return pa.array(out, pa.binary())

    return F.arrow_udf(mark, "binary").asNondeterministic()(text)


def _across(placed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of one bucket in different classes that may be similar.

    Members of a bucket's most frequent class are compared with all others, but
    not with each other. Long signatures are compared in blocks inside the tasks,
    and only pairs within four standard deviations of ``SIMILARITY`` come out, each
    in the first of the buckets that both share.
    """
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy("bucket").agg(
        F.max(F.struct("_n", "label"))["label"].alias("_largest"),
        F.max("_n").alias("_most"),
        F.sum("_n").alias("_all"),
        F.count("*").alias("_classes"),
    )
    several = largest.filter("_classes > 1").select(
        "bucket",
        "_largest",
        F.ceil((F.col("_all") - F.col("_most")) / REST_BLOCK).cast("int").alias("_a"),
        F.ceil(F.col("_all") / OTHER_BLOCK).cast("int").alias("_b"),
    )
    inside = stored(placed.select("bucket", "node", "label").join(several, "bucket"), "inside")
    marked = inside.select("node").distinct().join(texts, "node")
    marks = marked.select("node", mark_column(F.col("_text")).alias("mark"))
    marks = marks.join(nodes.select("node", "buckets"), "node")
    rows = inside.join(stored(marks, "marks"), "node")
    is_rest = F.col("label") != F.col("_largest")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    own = ["bucket", "node", "label", "mark", "buckets", is_rest.alias("is_rest")]
    rest = rows.filter(is_rest).select(
        *own, F.lit(True).alias("left"), block(F.col("_a")).alias("a"), F.explode(spread(F.col("_b"))).alias("b")
    )
    others = rows.select(
        *own, F.lit(False).alias("left"), F.explode(spread(F.col("_a"))).alias("a"), block(F.col("_b")).alias("b")
    )
    least = int(MARKS * SIMILARITY - 4 * (MARKS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("left").to_numpy()
        nodes = np.array(group.column("node").to_pylist() + [None], dtype=object)[:-1]
        labels = pd.factorize(np.array(group.column("label").to_pylist() + [None], dtype=object))[0]
        resting = group.column("is_rest").to_numpy()
        marks = np.frombuffer(b"".join(group.column("mark").to_pylist()), np.uint16)
        marks = marks.reshape(len(side), MARKS)
        buckets = np.array(group.column("buckets").to_pylist(), np.int64).reshape(len(side), -1)
        here = group.column("bucket")[0].as_py()
        right = np.flatnonzero(~side)
        found: tuple[list, list] = ([], [])
        for i in np.flatnonzero(side):
            agree = (marks[right] == marks[i]).sum(axis=1) >= least
            for j in right[agree & (labels[right] != labels[i])]:
                first = buckets[i][np.argmax(buckets[i] == buckets[j])]
                # two that both rest meet twice
                if first == here and (not resting[j] or nodes[i] < nodes[j]):
                    found[0].append(nodes[i])
                    found[1].append(nodes[j])
        return pa.table([pa.array(x, pa.binary()) for x in found], ["node", "other"])

    pairs = rest.unionAll(others).groupBy("bucket", "a", "b").applyInArrow(
        compare, "node binary, other binary"
    )
    return pairs.distinct()


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with the first row of each class, by key and hash of the text.

    Rows that have no words all stay.
    """
    classes = near_duplicates(df, text, key)
    kept = classes.filter(
        F.col("_key").eqNullSafe(F.col("class_key")) & (F.col("_hash") == F.col("class_hash"))
    )
    # equal rows have equal places; one of them stays
    kept = kept.select("_key", "_hash").distinct()
    here = carried(df, _own=key, _text=text).withColumn("_own_hash", F.xxhash64("_text"))
    empty = F.coalesce(F.trim(F.translate("_text", "\t\n\x0b\x0c\r", "     ")), F.lit("")) == ""
    joined = here.join(
        kept,
        F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_own_hash") == F.col("_hash")),
    )
    single = joined.filter(~empty).dropDuplicates(["_own", "_own_hash"])
    return single.unionAll(joined.filter(empty)).select("_row.*")
