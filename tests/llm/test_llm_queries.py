"""The registered queries against SQL or a brute-force version, on whole tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry_point
from faultline.llm import lm_score, personal_data, pieces, probminhash, quotes, secret_scan
from faultline.llm.queries import PIECE_MODEL

QUERIES = entry_point.queries()
ORACLES = {k: v for k, v in entry_point.oracle_sql().items() if k.startswith("op")}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in "documents pages benchmark conversations labels embeddings".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({ORACLES[name]})")
    assert plain(df.select(*sorted(df.columns)).collect()) == plain(expected.fetchall())


def test_secrets_by_plain_patterns(spark, sf_dir, texts):
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    for row in QUERIES["op2_secrets"](spark, sf_dir).collect():
        t = texts[row.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


def test_personal_data_by_plain_patterns(spark, sf_dir, texts):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def brute(t):
        yield from ((0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(p) <= 255 for p in m[0].split(".")):
                yield 1, m
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            if 16 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0])):
                yield 2, m
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 8 <= len(digits(m[0])) <= 15:
                yield 3, m

    for row in QUERIES["op8_personal_data"](spark, sf_dir).collect():
        spans = [f"{personal_data.KINDS[k]}:{m.start()}:{m.end()}" for k, m in brute(texts[row.doc_id])]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_near_duplicates_by_all_pairs(spark, sf_dir, texts):
    words = {k: t.encode().lower().split() for k, t in texts.items()}
    sets = {k: collections.Counter(zip(*(w[i:] for i in range(5)))) for k, w in words.items()}

    def similarity(x, y):
        both = x.keys() | y.keys()
        return sum(
            1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in both) for d in x.keys() & y.keys()
        )

    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = words[a] and words[a] == words[b]
            close = len(sets[a] & sets[b]) > 0.3 * min(len(sets[a]), len(sets[b])) and sets[a]
            if same or (close and round(similarity(sets[a], sets[b]), 9) >= 0.8):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    got = {r.doc_id: r.class_id for r in QUERIES["op5_near_duplicates"](spark, sf_dir).collect()}
    assert got == {k: root(k) for k in ids}


def test_quality_counts_by_hand(spark, sf_dir, texts):
    for row in QUERIES["op7_quality"](spark, sf_dir).collect():
        t = texts[row.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        covered = {i + j for v in windows.values() if len(v) > 1 for i in v for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_repeat_words == len(covered)
        assert row.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (row.base_failed and row.kept)


def test_pieces_vary_and_come_back(spark, sf_dir, texts):
    tables = pieces.Tables(pieces.read_pieces(PIECE_MODEL))
    for row in QUERIES["op9_pieces"](spark, sf_dir).collect():
        assert row.lossless and pieces.decoded(row.ids, tables) == texts[row.doc_id]


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 5000, "hot": 50}])
def test_lm_scores_by_counting(spark, sf_dir, texts, options):
    rows = {k: [w.decode() for w in t.encode().lower().split()] for k, t in texts.items()}
    single, pairs, n_texts = collections.Counter(), collections.Counter(), 0
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in rows}
    for k, w in rows.items():
        if not held[k]:
            single.update([*w, "\n"])
            pairs.update(zip(["\t", *w], [*w, "\n"]))
            n_texts += 1
    n, v, mu = sum(single.values()), len(single), lm_score.MU
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in lm_score.lm_scores(df, **options).collect():
        tokens = [*rows[row.doc_id], "\n"]
        base = [math.log10((single[w] + 1) / (n + v + 1)) for w in tokens]
        own = sum(
            math.log10((pairs[u, w] + mu * 10**b) / ((n_texts if u == "\t" else single[u]) + mu))
            for u, w, b in zip(["\t", *tokens], tokens, base)
        )
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[row.doc_id], len(tokens), n)
        assert row.n_known == sum(single[w] > 0 for w in tokens)
        assert row.base_score == pytest.approx(sum(base), abs=1e-6)
        assert row.score == pytest.approx(own, abs=1e-3 * len(tokens))


def test_replies_follow_their_quotes(spark):
    rows = [
        (1, 0, "a", "First thought.\n\nSecond thought."),
        (1, 1, "b", "> First thought.\nI agree."),
        (1, 2, "c", "> second   THOUGHT.\nI do not."),
        (1, 3, "a", "> > First thought.\n> I agree.\nThanks."),
        (1, 4, "d", "> said nowhere\nHm."),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.reply_ordered(df.withColumn("m", df.turn)).collect()}
    assert [got[t].reply_to for t in range(5)] == [None, 0, 0, 1, 3]
    assert [got[t].position for t in range(5)] == [0, 1, 4, 2, 3]
    assert got[3].text == "Thanks." and (got[3].n_quotes, got[3].n_linked) == (2, 2)
    assert got[None].text is None and got[None].position == 0
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    rows = QUERIES["pipeline"](spark, sf_dir).collect()
    kept = {r.doc_id for r in QUERIES["op7_quality"](spark, sf_dir).collect() if r.kept}
    assert {r.doc_id for r in rows} <= kept and len(rows) > len(kept) / 2
    assert all(r.lossless for r in rows)
    assert probminhash.SIMILARITY == 0.8
