"""Nulls, empty and very long texts, repeated rows, empty tables, clashing names."""

import base64
import gzip
import urllib.parse

import pytest
from pyspark.sql import functions as F

from faultline.llm import (
    containment,
    linechunks,
    lm_score,
    personal_data,
    pieces,
    probminhash,
    quality,
    queries,
    secret_scan,
    warc,
)
from faultline.llm.queries import PIECE_MODEL

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_words long, _kept boolean, "
    "_key string, _row int"
)
PROSE = " ".join(f"word{i % 97}x{i % 89}" for i in range(400))
ROWS = [
    (1, PROSE),
    (1, PROSE),
    (2, PROSE + " tail"),
    (3, ""),
    (4, None),
    (None, "one two"),
    (5, "x" * 200_000),
    (6, "one\ntwo three four five six\nseven eight nine ten\n" * 30),
    (7, "\n\n \t"),
    (8, "é▁日本語 🎉\n> \r\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(k, t, None, "s", 0, True, "k", 1) for k, t in ROWS], SCHEMA
    ).repartition(3)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_pieces(PIECE_MODEL)


def counted(df):
    return df.agg(F.count("*")).first()[0]


def row_local(df, vocabulary):
    yield secret_scan.secret_spans(df)
    yield personal_data.personal_spans(df)
    yield lm_score.lm_scores(df)
    yield quality.quality_verdicts(df)
    yield linechunks.line_dedup(df)
    yield probminhash.near_duplicates(df)
    yield df.select(
        pieces.round_trip_column(F.col("text"), F.col("doc_id"), vocabulary).alias("p")
    )


def test_one_row_for_each(odd, vocabulary):
    for df in row_local(odd, vocabulary):
        assert counted(df) == len(ROWS)
    for df in row_local(odd.limit(0), vocabulary):
        assert counted(df) == 0


def test_filters_keep_the_columns(odd, spark):
    items = spark.createDataFrame([(1, PROSE[:300]), (2, "short"), (3, None)], "item_id long, text string")
    for df in (
        quality.quality_filter(odd),
        linechunks.line_dedup(odd),
        probminhash.near_dedup(odd),
        containment.decontaminated(odd, items),
    ):
        assert df.columns == odd.columns and df.schema["text"] == odd.schema["text"]
        df.collect()
    left = containment.decontaminated(odd, items).select("doc_id").collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 3, 4, 5, 6, 7, 8]
    assert counted(containment.decontaminated(odd, items.limit(0))) == len(ROWS)


def test_one_of_each_class_stays(odd):
    left = sorted(r.doc_id or 0 for r in probminhash.near_dedup(odd).collect())
    assert left == [0, 1, 3, 4, 5, 6, 7, 8]


def test_long_lines_go_alone(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    short = " ".join(f"s{i}" for i in range(49))
    rows = [(i, f"{short}\nown a{i}\n{passage}\nown b{i}\n") for i in range(3)] + [(3, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linechunks.line_dedup(df, counts=True).collect()}
    assert got[0].text == rows[0][1] and got[3].text == ""
    assert all(got[i].text == f"{short}\nown a{i}\nown b{i}\n" for i in (1, 2))
    assert all((got[i].n_removed_chunks, got[i].n_removed_lines) == (1, 1) for i in (1, 2, 3))


@pytest.mark.parametrize("junk", ["one line of ten words that stands here forty times", None])
def test_runs_of_junk_leave_one_copy(spark, junk):
    lines = [junk or f"junk line {i} of ten words in all, no more" for i in range(40)]
    rows = [(d, f"own {d}\n" + "\n".join(lines) + f"\nend {d}") for d in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linechunks.line_dedup(df, passages=True).collect()}
    assert all(got[d] == f"own {d}\nend {d}" for d in range(1, 50))
    assert got[0].startswith("own 0\n" + lines[0]) and got[0].endswith("end 0")


@pytest.mark.parametrize("n_lines", range(2, 11))
def test_repeated_passages_go_whole(spark, n_lines):
    def line(tag, n):
        return " ".join(f"{tag}w{i}" for i in range(n))

    rows, width = [], 50 // n_lines + 1
    for trial in range(40):
        passage = [line(f"p{trial}l{i}", width) for i in range(n_lines)]
        for copy in range(2):
            own = [line(f"o{trial}c{copy}n{i}", 9) for i in range(4)]
            rows.append((2 * trial + copy, "\n".join([*own[:2], *passage, *own[2:]])))
    # fifty words are no passage; a copy that starts a text and one that ends it
    rows.append((900, "\n".join([line("x", 25), line("y", 25)])))
    rows.append((901, "\n".join([line("z", 5), line("x", 25), line("y", 25), line("v", 5)])))
    rows.append((902, rows[0][1].split("\n", 2)[2] + "\n" + rows[2][1].rsplit("\n", 2)[0]))
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = {r.doc_id: r.text.split("\n") for r in linechunks.line_dedup(df, passages=True).collect()}
    for trial in range(40):
        lines = rows[2 * trial + 1][1].split("\n")
        assert got[2 * trial] == rows[2 * trial][1].split("\n")
        assert got[2 * trial + 1] == lines[:2] + lines[-2:]
    assert got[900] == rows[-3][1].split("\n") and got[901] == rows[-2][1].split("\n")
    assert got[902] == [""]


def test_windows_from_both_sides():
    windows = linechunks.passage_windows
    assert windows([20, 20, 20]) == [(0, 3)]
    assert windows([25, 25]) == [] and windows([60]) == []
    assert windows([30, 30, 5, 0, 30]) == [(0, 2), (0, 3), (0, 4), (1, 4)]


def test_similarity_at_the_limit(spark):
    # 40 of 50 shingles in common: exactly 0.8
    words = [f"w{i}" for i in range(60)]
    texts = [words[:49], [*words[:44], *words[50:55]], words[5:49]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r._key: r.class_key for r in probminhash.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_pieces_of_odd_texts(odd, vocabulary):
    trip = pieces.round_trip_column(F.col("text"), F.col("doc_id"), vocabulary, rate=0.3)
    got = odd.select("text", trip.alias("p")).collect()
    assert all(r.p.lossless for r in got)
    assert all((r.p.ids is None) == (r.text is None) for r in got)


def test_without_dropout_as_the_library(vocabulary):
    import numpy as np
    import sentencepiece

    tables = pieces.Tables(vocabulary)
    texts = [t for _, t in ROWS if t and "▁" not in t] + ["a  b", " lead", "trail "]
    ids, counts = pieces.encoded(texts, np.zeros(len(texts), np.uint64), tables, 0, 0.0, 4)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    expected = library.encode(texts)
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


def test_every_occurrence_draws_for_itself(vocabulary):
    import numpy as np

    tables, n = pieces.Tables(vocabulary), 4000
    text = " ".join(["international words stay"] * n) + " onceonly " + "y" * 300
    row_keys = np.array([17, 18], np.uint64)
    ids, counts = pieces.encoded([text, text], row_keys, tables, 5, 0.1)
    again, _ = pieces.encoded([text, text], row_keys, tables, 5, 0.1)
    assert ids.tolist() == again.tolist()
    assert pieces.decoded(ids[: counts[0]].tolist(), tables) == text
    # the same draws, each occurrence run by itself
    flat = tables.chunk.findall(" " + text)
    hashes = pieces.hashes_of([x.encode() for x in flat], 5)
    expected, cuts = [], []
    for key in row_keys:
        places = np.arange(len(flat), dtype=np.uint64)
        keys = pieces.mixed(hashes + pieces.mixed(key + places))
        own, sizes = pieces.segmented([x.replace(" ", pieces.SPACE) for x in flat], keys, tables, 0.1)
        expected += own.tolist()
        cuts += [tuple(x.tolist()) for x in np.split(own, np.cumsum(sizes)[:-1])]
    assert ids.tolist() == expected
    # a word of one merge keeps it in nine of ten occurrences, longer ones vary freely
    words = [c for c, x in zip(cuts, flat * 2) if x == " international"]
    assert len(set(words)) > 20
    short, sizes = pieces.encoded([" ".join(["a"] * 20_000)], row_keys[:1], tables, 0, 0.1)
    assert 0.09 < sizes[0] / 20_000 - 1 < 0.11


@pytest.mark.parametrize("wrap", ["percent", "unicode", "base64", "gzip", "nested"])
def test_wrapped_secrets(wrap):
    plain = "see password=hunter2secret ok"
    code = base64.b64encode(plain.encode()).decode()
    packed = base64.b64encode(gzip.compress(plain.encode())).decode()
    text = {
        "percent": urllib.parse.quote(plain),
        "unicode": plain.replace("password", "".join(f"\\u{ord(c):04x}" for c in "password")),
        "base64": f"x {code} y",
        "gzip": f"x {packed} y",
        "nested": urllib.parse.quote(base64.b64encode(code.encode()).decode()),
    }[wrap]
    spans, _ = secret_scan.unwrapped(text)
    assert len(spans) == 1 and 0 <= spans[0][0] < spans[0][2] <= len(text)


def test_checksums_and_context():
    assert personal_data.mod97("GB82WEST12345698765432")
    _, spans, scores = personal_data.find_personal_data("iban GB82 WEST 1234 5698 7654 32 AND")
    assert [s[0] for s in spans if s[0] == 4] == [4] and max(scores) == 1.0
    assert personal_data.find_personal_data("078-05-1120")[1] == []
    assert personal_data.find_personal_data("my ssn 078-05-1120")[1] == [(6, 7, 18)]


def test_archives_are_the_same_bytes(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://x/{i}", f"page {i % 7} " * 50) for i in range(60)]
        + [(None, None, None), (3, "a b\n", ""), (None, None, "page 1 " * 50)],
        "page_id long, url string, html string",
    )
    files = []
    for n, parts in enumerate((2, 5)):
        root = str(tmp_path / str(n))
        warc.write_archives(pages.repartition(parts), root, shard_bytes=4000, roll_bytes=2000)
        files.append({p.name: p.read_bytes() for p in (tmp_path / str(n)).glob("*.gz")})
        assert not (tmp_path / str(n) / "_temporary").exists()
    assert files[0] == files[1] and len(files[0]) > 3
    back = warc.read_archives(spark, root).collect()
    assert len(back) == 63
    first = [r for r in back if r.record_type == "response" and r.key is not None]
    assert {r.key for r in first} >= {str(i) for i in range(53, 60)}
    # the empty page without a key revisits the other empty one
    revisited = {r.refers_to for r in back if r.record_type == "revisit"}
    assert revisited == {"3", *(str(i) for i in range(53, 60))}


def test_archive_query_takes_any_rows(spark, tmp_path):
    schema = "page_id long, url string, html string, key int, sha1 string"
    rows = [(None, None, None, 1, "x"), (None, "u", "only here", 1, "x"), (3, "a", "", 1, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op4_warc(spark, str(tmp_path)).collect()
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got])) == sorted(
        map(str, [(None, 0, "revisit", 3), (None, 9, "response", None), (3, 0, "response", None)])
    )
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(str(empty / "pages.parquet"))
    assert queries.op4_warc(spark, str(empty)).count() == 0


@pytest.mark.parametrize("n", [5, 6])
def test_short_items_in_many_long_texts(n):
    short = [" ".join(f"item{k}x{i}" for i in range(n)) for k in range(2000)]
    items = containment.sketched(list(range(2000)) + [None], [x.encode() for x in [*short, "a b"]])
    texts = []
    for d in range(6000):
        words = [f"d{d}w{i}" for i in range(100)]
        texts.append(" ".join([*words[: d % 90], short[d % 2000], *words[d % 90 :]]).encode())
    # all but the last word
    texts.append((short[0].rsplit(" ", 1)[0] + " end").encode())
    assert containment.contained(texts, items) == [(d, d % 2000, n - 4) for d in range(6000)]
