"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry_point
from faultline.llm import recompression
from faultline.llm.tokens import words_of

SCHEMA = "doc_id long, text string, _key int, kept string, n_words string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size):
    """(key, n_words, n_removed, kept words joined) of each row."""
    least = {}
    for key, text in rows:
        own = words(text)
        for i in range(len(own) - size + 1):
            at = tuple(own[i : i + size])
            if key is not None:
                least[at] = min(key, least.get(at, key))
    out = []
    for key, text in rows:
        own, gone = words(text), set()
        for i in range(len(own) - size + 1):
            if key is not None and least[tuple(own[i : i + size])] < key:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((key, len(own), len(gone), kept))
    return out


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def corpus(seed, n, kinds):
    """Texts of a few words, made of passages that they share."""
    draw = random.Random(seed)
    shared = [[f"w{draw.randrange(kinds)}" for _ in range(draw.randrange(5, 90))] for _ in range(6)]
    rows = []
    for key in range(n):
        own = []
        for _ in range(draw.randrange(6)):
            passage = draw.choice(shared)
            low = draw.randrange(len(passage))
            own += passage[low : low + draw.randrange(90)]
            own += [f"w{draw.randrange(kinds)}"] * draw.choice([0, 1, 2, 30])
        rows.append((draw.randrange(n), " ".join(own)))
    return rows


@pytest.mark.parametrize("size,kinds", [(1, 3), (2, 2), (7, 2), (7, 40), (50, 2), (50, 1000)])
def test_counts_by_brute_force(spark, size, kinds):
    rows = corpus(size * kinds, 60, kinds)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = recompression.removal_counts(df, size=size).collect()
    expected = [
        (k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in brute(rows, size)
    ]
    assert plain(got) == plain(expected)


def test_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    run = "la " * 5000
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, passage), (8, passage), (8, "other " + passage),
        (9, "é " + passage.replace(" ", "\x0b\n") + " tail"), (None, passage), (None, passage),
        (10, run), (11, run + passage), (4, "one"), (12, "one"),
        (13, "la " * 49), (14, passage + " " + passage[:-1] + "x"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = recompression.removal_counts(df).collect()
    expected = brute(rows, 50)
    assert plain((r.doc_id, r.n_words, r.n_removed) for r in got) == plain(x[:3] for x in expected)
    cleaned = recompression.substring_dedup(df)
    assert cleaned.columns == df.columns
    texts = [(k, kept if gone else text) for (k, _, gone, kept), (_, text) in zip(expected, rows)]
    assert plain((r.doc_id, r.text) for r in cleaned.collect()) == plain(texts)
    assert recompression.removal_counts(df.limit(0)).count() == 0
    assert recompression.substring_dedup(df.limit(0)).count() == 0


def test_query_by_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in documents.collect()]
    got = entry_point.queries()["op11_substring_dedup"](spark, sf_dir).collect()
    expected = [
        (k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in brute(rows, 50)
    ]
    assert plain(got) == plain(expected)
    assert sum(r.n_removed for r in got)


def test_equal_windows_have_equal_anchors():
    draw = random.Random(1)
    inner = [b"w%d" % draw.randrange(30) for _ in range(80)]
    texts = [
        b" ".join([b"w%d" % draw.randrange(30) for _ in range(n)] + inner + [b"w%d" % n] * n)
        for n in (0, 3, 40)
    ]
    found = recompression.occurrences(words_of(texts))
    names = np.repeat(found.name, found.n)
    starts = np.concatenate([np.arange(f, f + n) for f, n in zip(found.first, found.n)])
    at = dict(zip(starts.tolist(), names.tolist()))
    first = words_of(texts).starts
    for i in range(31):
        assert len({at[s + n + i] for s, n in zip(first.tolist(), (0, 3, 40))}) == 1


def test_blocks_of_windows_change_nothing(monkeypatch):
    texts = [t.encode() for _, t in corpus(3, 30, 20)]
    whole = recompression.occurrences(words_of(texts))
    monkeypatch.setattr(recompression, "BLOCK", 17)
    for a, b in zip(whole, recompression.occurrences(words_of(texts)), strict=True):
        assert (a == b).all()
