"""Scores of texts under a bigram language model learned from most of them.

The model smooths bigrams towards unigrams with a Dirichlet prior:

    p(w | u) = (n(u w) + MU * p(w)) / (n(u) + MU),  p(w) = (c(w) + 1) / (N + V + 1)

so that the logarithm of a text falls into terms of (word, word before) and terms
of the word before alone. All of them can be worked out where the counts of one
word are: every occurrence of a word goes to the shard its hash belongs to, with
the word before it and its text's place. Each shard counts its training part,
builds an Elias-Fano trie of its bigrams (``ngram_trie``), looks all its bigrams
up in it, and sends partial sums back to the texts. No model and no vocabulary
is ever in one task or on the driver.

A word with more than ``HOT`` occurrences is dealt out by the word before it, and
a bigram with as many by its batch. Their counts are sent to all tasks: there
cannot be more of them than occurrences / ``HOT``.

Words before are told apart by 48 bits of hash, words by 64.

Defined cases. A null or empty text is its end token alone. A null key belongs to
the training part. Every row is scored by itself, so repeated keys or rows give
repeated results, and each counts in training. Without training texts every
probability is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import ngram_trie
from faultline.llm.tokens import byte_texts, hashes_of, mixed, text_slices, words_of

MU = 100.0
SHARD_TOKENS = 2_500_000
HOT = 2_500_000
SLICE_BYTES = 10 << 20  # texts dealt out together

# Keys of the end and the start of a text: no word is white space.
END, START = (hashes_of([b" "])[0], hashes_of([b"\t"])[0])
U = np.uint64


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens, of the token before each, and their texts."""
    words = words_of([t.lower() for t in texts])
    counts = words.counts
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.empty(len(text_of), U)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[ends] = END
    if len(words.codes):
        tokens[inner] = hashes_of(words.distinct)[words.codes]
    before = np.empty(len(tokens), U)
    before[1:] = tokens[:-1]
    before[ends - counts] = START
    before >>= U(64 - ngram_trie.CONTEXT_BITS)
    return tokens, before, text_of


def _summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts).groupby(["t", "b"], sort=False).sum().reset_index()


def _rows(df: DataFrame, text: str, key: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))
    return df.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text"))


def _counted(rows: DataFrame, hot: np.ndarray | None) -> DataFrame:
    """(token, before, n, trained) combined per batch.

    Without ``hot``, of all tokens (``before`` is 0); else of the bigrams whose
    words are both in ``hot``.
    """

    def word_counts(texts: list[bytes], trained: np.ndarray) -> pd.DataFrame:
        words = words_of([t.lower() for t in texts])
        size = len(words.distinct)
        learned = np.repeat(trained, words.counts)
        found = {
            "t": np.append(hashes_of(words.distinct), END),
            "b": np.zeros(size + 1, U),
            "n": np.append(np.bincount(words.codes, minlength=size), len(texts)),
            "k": np.append(np.bincount(words.codes[learned], minlength=size), trained.sum()),
        }
        return pd.DataFrame(found)

    def pair_counts(texts: list[bytes], trained: np.ndarray) -> pd.DataFrame:
        tokens, before, text_of = _tokens(texts)
        # a bigram is as rare as the rarer of its words
        some = np.isin(tokens, hot) & np.isin(before, before_hot)
        found = {"t": tokens[some], "b": before[some], "n": 1, "k": trained[text_of[some]] * 1}
        return _summed([pd.DataFrame(found)])

    shift = U(64 - ngram_trie.CONTEXT_BITS)
    before_hot = None if hot is None else np.append(hot, START) >> shift

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            trained = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            of = word_counts if hot is None else pair_counts
            parts = [of(texts[a:b], trained[a:b]) for a, b in text_slices(texts)]
            if not parts:
                continue
            sums = _summed(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sums["t"].to_numpy(U).view(np.int64)),
                    pa.array(sums["b"].to_numpy(U).view(np.int64)),
                    pa.array(sums["n"].to_numpy(np.int64)),
                    pa.array(sums["k"].to_numpy(np.int64)),
                ],
                ["token", "before", "n", "trained"],
            )

    schema = "token bigint, before bigint, n bigint, trained bigint"
    counts = rows.select("held_out", "text").mapInArrow(count, schema)
    grouped = counts.groupBy("token", "before")
    return grouped.agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _totals(counts: DataFrame, hot: int) -> tuple[int, int, int, list]:
    """All tokens, training tokens, distinct training tokens, and the hot ones."""
    listed = F.collect_list(F.when(F.col("n") >= hot, F.struct("token", "before", "trained")))
    row = counts.agg(
        F.sum("n"), F.sum("trained"), F.count_if(F.col("trained") > 0), listed
    ).first()
    return row[0] or 0, row[1] or 0, row[2], row[3]


def _small(values: np.ndarray) -> bytes:
    """The numbers in as few bytes as the largest needs."""
    most = int(values.max(initial=0))
    kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32
    return values.astype(kind).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    kind = {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // max(n, 1)]
    return np.frombuffer(raw, kind).astype(np.int64)


_BLOB = ("words", "sizes", "before_low", "before_high", "texts", "times", "trained")


def _dealt(rows: DataFrame, shards: int, hot_words: np.ndarray, hot_pairs: np.ndarray) -> DataFrame:
    """A header row per text, and a row of packed occurrences per batch and shard."""
    key_type = rows.schema["key"].dataType
    schema = (
        f"shard bigint, batch bigint, place int, key {key_type.simpleString()}, held_out boolean, "
        "n_tokens bigint, " + ", ".join(f"{c} binary" for c in _BLOB)
    )

    def packed(texts: list[bytes], held: np.ndarray, name: int) -> list[tuple]:
        """(shard, blobs) of the occurrences in some texts."""
        tokens, before, text_of = _tokens(texts)
        # sorting by a word's mixed hash puts its shard's words together
        part = mixed(tokens)
        times = None
        special = np.isin(tokens, hot_words)
        if special.any():
            # repeated bigrams of one text count as one entry
            frame = pd.DataFrame({"t": tokens, "b": before, "x": text_of})[special]
            sums = frame.groupby(["t", "b", "x"], sort=False).size().reset_index(name="n")
            own, previous = sums["t"].to_numpy(U), sums["b"].to_numpy(U)
            pair = mixed(own ^ mixed(previous))
            pair = np.where(np.isin(pair, hot_pairs), mixed(pair + U(name)), pair)
            plain = ~special
            times = np.concatenate([np.ones(plain.sum(), np.int64), sums["n"].to_numpy()])
            tokens = np.concatenate([tokens[plain], own])
            before = np.concatenate([before[plain], previous])
            text_of = np.concatenate([text_of[plain], sums["x"].to_numpy()])
            part = np.concatenate([part[plain], pair])
        order = np.argsort(part)
        shard = ((part[order] >> U(32)) * U(shards) >> U(32)).astype(np.int64)
        del part
        tokens, before, text_of = tokens[order], before[order], text_of[order]
        times = np.ones(len(tokens), np.uint8) if times is None else times[order]
        edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        trained, out = np.packbits(~held).tobytes(), []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = tokens[a:b]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            blobs = (
                own[first].tobytes(),
                _small(np.diff(np.append(first, b - a))),
                (before[a:b] & U(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                (before[a:b] >> U(32)).astype(np.uint16).tobytes(),
                _small(text_of[a:b]),
                _small(times[a:b]),
                trained,
            )
            out.append((int(shard[a]), *blobs))
        return out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in text_slices(texts, SLICE_BYTES):
                name = (TaskContext.get().partitionId() << 32) + number
                number, n = number + 1, b - a
                counts = [len(t.split()) + 1 for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, -1 - name)),
                        pa.array(np.full(n, name)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        batch.column("key")[a:b],
                        batch.column("held_out")[a:b],
                        pa.array(counts, pa.int64()),
                        *[pa.nulls(n, pa.binary())] * len(_BLOB),
                    ],
                    names=names,
                )
                out = packed(texts[a:b], held[a:b], name)
                m = len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array(np.full(m, name)),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, batch.column("key").type),
                        pa.nulls(m, pa.bool_()),
                        pa.nulls(m, pa.int64()),
                        *[pa.array([x[i] for x in out], pa.binary()) for i in range(1, 8)],
                    ],
                    names=names,
                )

    names = ["shard", "batch", "place", "key", "held_out", "n_tokens", *_BLOB]
    return rows.mapInArrow(deal, schema)


def _occurrences(group: pa.Table):
    """(word, before, text, times, trained) of a shard, and (batch, places) of its
    texts in their order."""
    parts, names, at = [], [], 0
    for row in group.to_pylist():
        words = np.frombuffer(row["words"], U)
        sizes = _wide(row["sizes"], len(words))
        n = int(sizes.sum())
        before = np.frombuffer(row["before_low"], np.uint32).astype(U)
        before |= np.frombuffer(row["before_high"], np.uint16).astype(U) << U(32)
        texts = _wide(row["texts"], n)
        trained = np.unpackbits(np.frombuffer(row["trained"], np.uint8)).astype(bool)
        seen, local = np.unique(texts, return_inverse=True)
        names.append((row["batch"], seen))
        times = _wide(row["times"], n).astype(np.int32)
        parts.append(
            (np.repeat(words, sizes), before, (at + local).astype(np.int32), times, trained[texts])
        )
        at += len(seen)
    return [np.concatenate(x) for x in zip(*parts, strict=True)], names


def _score_shard(group, mu, n_train, n_words, hot_words, hot_pairs):
    """(batch, places, known, base, score) for each batch of texts in one shard."""
    (word, before, text, times, trained), names = _occurrences(group)
    trained_times = np.where(trained, times, 0)

    words, word_of = np.unique(word, return_inverse=True)
    counts = np.bincount(word_of, weights=trained_times).astype(np.int64)
    for token, _, n in hot_words:
        counts[words == U(token % 2**64)] = n
    word_of = word_of.astype(np.int32)
    pair_key = mixed(word ^ mixed(before))
    del word
    order = np.argsort(pair_key)
    new = np.append(True, np.diff(pair_key[order]) != 0)
    pair_of = np.empty(len(order), np.int32)
    pair_of[order] = np.cumsum(new, dtype=np.int32) - 1
    first = order[new]
    pairs = pair_key[first]
    del order, new, pair_key
    if (before[first][pair_of] != before).any() or (word_of[first][pair_of] != word_of).any():
        raise RuntimeError("two bigrams have one hash")
    before, word_at = before[first], word_of[first]
    pair_counts = np.bincount(pair_of, weights=trained_times).astype(np.int64)
    del trained_times
    for token, previous, n in hot_pairs:
        key = mixed(np.array([token % 2**64], U) ^ mixed(np.array([previous], U)))[0]
        pair_counts[pairs == key] = n

    # the trie of what is in training
    known = counts > 0
    rank_of = np.cumsum(known) - 1
    learned = np.flatnonzero(pair_counts > 0)
    owner, previous = rank_of[word_at[learned]], before[learned]
    order = np.lexsort((previous, owner))
    learned, owner, previous = learned[order], owner[order], previous[order]
    whole = n_train + n_words + 1
    prior = mu * (counts + 1) / whole
    logs = np.log10(pair_counts[learned] + prior[word_at[learned]])
    trie = ngram_trie.mapped(ngram_trie.build(words[known], owner, previous, logs))

    rank, found = ngram_trie.lookup(trie, words[word_at], before)
    pair_log = np.log10(prior[word_at])
    hit = found >= 0
    pair_log[hit] = ngram_trie.log_of(trie, found[hit])
    as_context = np.where(words == END, 0.0, np.log10(counts + mu))

    n_texts = sum(len(places) for _, places in names)
    sums = lambda x: np.bincount(text, weights=times * x, minlength=n_texts)
    results = (
        sums((rank >= 0)[pair_of]),
        sums(np.log10(counts + 1)[word_of]),
        sums(pair_log[pair_of] - as_context[word_of]),
    )
    out, at = [], 0
    for batch, places in names:
        out.append((batch, places, *(x[at : at + len(places)] for x in results)))
        at += len(places)
    return out


def lm_scores(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    mu: float = MU,
    shard_tokens: int = SHARD_TOKENS,
    hot: int = HOT,
) -> DataFrame:
    """(``key``, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    rows = _rows(df, text, key)
    total, n_train, n_words, words = _totals(_counted(rows, None), hot)
    hot_words = [(r["token"], 0, r["trained"]) for r in words]
    hot_tokens = np.array([t % 2**64 for t, _, _ in hot_words], U)
    hot_pairs = []
    if hot_words:
        _, _, _, found = _totals(_counted(rows, hot_tokens), hot)
        hot_pairs = [(r["token"], r["before"], r["trained"]) for r in found]
    pair_keys = mixed(
        np.array([t % 2**64 for t, _, _ in hot_pairs], U)
        ^ mixed(np.array([b for _, b, _ in hot_pairs], U))
    )
    n_texts = F.count_if(~F.col("held_out"))
    trained_texts = rows.agg(n_texts).first()[0]
    shards = max(1, -(-total // shard_tokens))
    key_type = rows.schema["key"].dataType.simpleString()

    header = ["batch", "place", "key", "held_out", "n_tokens"]
    sums = ["places", "known", "base", "score"]

    def score(group: pa.Table) -> pa.Table:
        """Headers as they are; partial sums packed, a row per batch of texts."""
        shard = group.column("shard")[0].as_py()
        if shard < 0:
            n = group.num_rows
            blank = [pa.nulls(n, pa.binary())] * len(sums)
            kept = [group.column(c) for c in header]
            return pa.Table.from_arrays([pa.array(np.full(n, shard)), *kept, *blank], names)
        found = _score_shard(group, mu, n_train, n_words, hot_words, hot_pairs)
        n = len(found)
        blank = [pa.nulls(n, group.column(c).type) for c in header[1:]]
        blobs = [[x[0] for x in found], [_small(x[1]) for x in found]]
        blobs.append([_small(x[2].astype(np.int64)) for x in found])
        blobs += [[x[i].tobytes() for x in found] for i in (3, 4)]
        columns = [pa.array(b, pa.binary()) for b in blobs[1:]]
        first = [pa.array(np.full(n, shard)), pa.array(blobs[0], pa.int64())]
        return pa.Table.from_arrays([*first, *blank, *columns], names)

    def merge(group: pa.Table) -> pa.Table:
        """The texts of one batch with the sums of all shards, in their order."""
        group = group.sort_by([("shard", "ascending"), ("place", "ascending")])
        blobs = group.filter(pa.compute.is_valid(group.column("places")))
        texts = group.filter(pa.compute.is_valid(group.column("place")))
        totals = np.zeros((3, texts.num_rows))
        for row in blobs.select(sums).to_pylist():
            n = len(row["base"]) // 8
            at = _wide(row["places"], n)
            totals[0, at] += _wide(row["known"], n)
            totals[1, at] += np.frombuffer(row["base"], np.float64)
            totals[2, at] += np.frombuffer(row["score"], np.float64)
        return pa.Table.from_arrays(
            [
                *[texts.column(c) for c in header[2:]],
                pa.array(np.rint(totals[0]).astype(np.int64)),
                pa.array(totals[1]),
                pa.array(totals[2]),
            ],
            ["key", "held_out", "n_tokens", "n_known", "base", "score"],
        )

    names = ["shard", *header, *sums]
    partial = (
        f"shard bigint, batch bigint, place int, key {key_type}, held_out boolean, n_tokens bigint, "
        + ", ".join(f"{c} binary" for c in sums)
    )
    whole_rows = (
        f"key {key_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, "
        "score double"
    )
    dealt = _dealt(rows, shards, hot_tokens, pair_keys)
    parts = dealt.groupBy("shard").applyInArrow(score, partial)
    scored = parts.groupBy("batch").applyInArrow(merge, whole_rows)
    start = float(np.log10(trained_texts + mu))
    whole = float(np.log10(n_train + n_words + 1))
    return scored.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        F.round(F.col("base") - F.col("n_tokens") * whole, 8).alias("base_score"),
        F.round(F.col("score") - start, 8).alias("score"),
    )
