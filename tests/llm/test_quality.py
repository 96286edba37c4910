"""The quality rules against a plain version in numpy, on whole tables."""

import collections
import math
import random
import re
import statistics

import numpy as np
import pytest

from faultline.llm import quality

P = len(quality.FEATURES)
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "n_lines": len(lines),
    }


def plain_vector(c):
    if not c["n_words"]:
        return None
    words, lines = float(c["n_words"]), float(c["n_lines"])
    values = [
        c["word_chars"] / words,
        math.log(words / lines),
        math.sqrt(c["n_symbols"] / words),
        math.sqrt(c["n_dup_lines"] / lines),
        math.sqrt(c["n_repeat_words"] / words),
    ]
    return [math.floor(v * quality.GRID + 0.5) for v in values]


def plain_distances(x, centre, factor):
    apart = x - centre
    return sum((apart[:, j:] @ factor[j:, j]) ** 2 for j in range(P))


def plain_fit(centre, scatter, scale):
    unit = scatter / np.outer(scale, scale)
    shrunk = (1 - quality.SHRINK) * unit + quality.SHRINK * np.eye(P)
    factor = np.linalg.cholesky(np.linalg.inv(shrunk)) / scale[:, None]
    return np.linalg.slogdet(shrunk)[1], centre, factor


def plain_step(x, fit, scale):
    """The next fit, and the median distance (by its bin) under the given one."""
    d2 = plain_distances(x, fit[1], fit[2])
    logs = [math.log(d + 2.0**-20) / math.log(2) for d in d2]
    bins = np.array([math.ceil(v * quality.BINS_PER_OCTAVE) for v in logs])
    ordered = np.sort(bins)
    # whole bins, up to the one that reaches the share
    last = ordered[math.ceil(quality.SHARE * len(x)) - 1]
    inner = x[bins <= last]
    centre = inner.mean(axis=0)
    scatter = inner.T @ inner / len(inner) - np.outer(centre, centre)
    half = ordered[math.ceil(len(x) / 2) - 1]
    return plain_fit(centre, scatter, scale), 2.0 ** ((half - 0.5) / quality.BINS_PER_OCTAVE)


def plain_mcd(x, steps=3):
    x = np.array(x, float)
    centre = np.median(x, axis=0)
    scale = np.median(abs(x - centre), axis=0) * 1.4826
    scale = np.maximum(scale, np.array(quality.FLOORS) * quality.GRID)
    z = (x - centre) / scale
    norm = np.sqrt((z**2).sum(axis=1) + 1e-9)[:, None]
    shapes = [np.eye(P)]
    for values in (np.tanh(z), z / norm):
        grid = np.floor(values * quality.GRID + 0.5)
        m = grid.T @ grid
        size = np.sqrt(np.maximum(np.diag(m), 1.0))
        m = m / np.outer(size, size)
        np.fill_diagonal(m, 1.0)
        shapes.append(m)
    fits = [plain_fit(centre, s * np.outer(scale, scale), scale) for s in shapes]
    fits = [plain_step(x, f, scale)[0] for f in fits]
    fit = min((plain_step(x, f, scale)[0] for f in fits), key=lambda f: round(f[0], 9))
    for _ in range(steps):
        fit = plain_step(x, fit, scale)[0]
    return fit[1], fit[2], plain_step(x, fit, scale)[1]


def chi_square(share):
    z = statistics.NormalDist().inv_cdf(share)
    return P * (1 - 2 / (9 * P) + z * math.sqrt(2 / (9 * P))) ** 3


def plain_verdicts(rows, min_rows):
    """(counts, base_failed, distance, kept) by key, for (key, text, lang, source)."""
    counts = {k: plain_counts(t or "") for k, t, _, _ in rows}
    vectors = {k: plain_vector(c) for k, c in counts.items()}
    pools = collections.defaultdict(list)
    for k, _, lang, source in rows:
        if vectors[k]:
            for key in ((lang, source), (lang,), ()):
                pools[key].append(vectors[k])
    fits, out = {}, {}
    for k, _, lang, source in rows:
        c = counts[k]
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        if not vectors[k]:
            out[k] = (c, failed, None, False)
            continue
        large = [q for q in ((lang, source), (lang,)) if len(pools[q]) >= min_rows]
        key = (large or [()])[0]
        if key not in fits:
            fits[key] = plain_mcd(pools[key])
        centre, factor, median = fits[key]
        d = plain_distances(np.array([vectors[k]], float), centre, factor)[0]
        d /= max(median / chi_square(0.5), 1.0)
        out[k] = (c, failed, d, not failed and d <= chi_square(quality.QUANTILE))
    return out, set(fits)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(DOCUMENTS).select("doc_id", "text", "lang", "source")


@pytest.mark.parametrize("min_rows", [30, 200])
def test_equal_to_the_plain_version(spark, documents, min_rows):
    rows = [tuple(r) for r in documents.collect()]
    expected, levels = plain_verdicts(rows, min_rows)
    assert len({len(k) for k in levels}) > 1
    got = quality.quality_verdicts(documents, min_rows=min_rows).collect()
    assert len(got) == len(rows) == len(expected)
    for r in got:
        counts, failed, distance, kept = expected[r.doc_id]
        assert {c: r[c] for c in quality.COUNTS} == counts
        assert (r.base_failed, r.kept) == (failed, kept)
        assert r.distance == (distance and pytest.approx(distance, rel=1e-6, abs=2e-6))
    assert any(not r.kept and not r.base_failed for r in got)


def test_many_groups_take_the_salted_join(spark, documents, monkeypatch):
    sent = quality.quality_verdicts(documents, min_rows=30).collect()
    monkeypatch.setattr(quality, "SENT", 0)
    monkeypatch.setattr(quality, "SALTS", 3)
    salted = quality.quality_verdicts(documents.repartition(5), min_rows=30).collect()
    assert sorted(map(repr, salted)) == sorted(map(repr, sent))


def _table(spark, n, odd):
    """``n`` texts of random words, and ``odd`` as the last."""
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "light", "paper") for b in "abcdefghij"]
    draw = random.Random(5)
    rows = []
    for i in range(n):
        lines = [draw.choices(vocabulary, k=draw.randint(8, 12)) for _ in range(draw.randint(4, 7))]
        rows.append((i, "\n".join(map(" ".join, lines)), "en", f"s{i % 7}"))
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame([*rows, (n, odd, None, "s1")], schema)


ODD = [
    " ".join(f"#{i}$%&|" for i in range(60)),
    "\n".join(random.Random(6).choices("abcdefghijkl", k=80)),
    " ".join(f"w{i}" + "x" * 60 for i in range(50)),
]


@pytest.mark.parametrize("odd", ODD, ids=["symbols", "lines", "long words"])
def test_small_tables_have_outliers(spark, odd):
    rows = quality.quality_verdicts(_table(spark, 149, odd)).collect()
    assert not any(r.base_failed for r in rows)
    assert [r.doc_id for r in rows if not r.kept] == [149]


def test_duplicate_lines_alone_can_reject():
    alone = 1 / quality.FLOORS[quality.FEATURES.index("dup_lines")] ** 2 / quality.SHRINK
    assert alone > quality.chi_square(quality.QUANTILE, P)


def test_empty_table(spark, documents):
    assert quality.quality_verdicts(documents.limit(0)).collect() == []
