"""Quotations that were trimmed, wrapped anew and nested, against the SQL."""

import random

import duckdb
import pytest

from faultline.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def parents(spark, texts):
    rows = [(1, i, "r", t) for i, t in enumerate(texts)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r.turn: (r.n_linked, r.reply_to) for r in got}


def test_trimmed_and_rewrapped_quotes(spark):
    texts = [
        "The first line of it.\nThe second line of it.\nThe third line of it.",
        "Something else altogether here. And more of the same in one long line.",
        "> The first line of it.\n> The second line of it.\nYes.",
        "> And more of the same\n> in one long line.\nNo.",
        "> the second   line\n> of it. the third\n> line of it.\nPerhaps.",
        "> first line of\nThree words do not tell enough.",
        "> words nobody wrote before me\nOdd.",
    ]
    got = parents(spark, texts)
    assert got == {
        0: (0, None), 1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (1, 0), 5: (0, 4), 6: (0, 5),
    }


def generated(seed, n):
    """Conversations whose messages quote earlier ones in all sorts of ways."""
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        texts = []
        for turn in range(draw.randrange(1, 9)):
            out = []
            if texts:
                for _ in range(draw.randrange(3)):
                    lines = draw.choice(texts).split("\n")
                    if draw.random() < 0.5:
                        low = draw.randrange(len(lines))
                        lines = lines[low : low + draw.randrange(1, 4)]
                    if draw.random() < 0.4:
                        words = " ".join(lines).split()
                        low = draw.randrange(len(words)) if words else 0
                        words = words[low : low + draw.randrange(1, 12)]
                        lines = [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]
                    out += ["> " * draw.choice([1, 1, 2]) + x for x in lines]
                    if draw.random() < 0.5:
                        out.append("")
            for _ in range(draw.randrange(4)):
                out.append(" ".join(draw.choice(["yes", "a", "word", "it", "so", "Then"]) + str(draw.randrange(6)) for _ in range(draw.randrange(12))))
            texts.append("\n".join(out))
        # copies of a text, and turns out of order
        if draw.random() < 0.3:
            texts.append(texts[0])
        order = list(enumerate(texts))
        draw.shuffle(order)
        rows += [(conv if conv else None, turn, "r", t) for turn, t in order]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_conversations_equal_the_sql(spark, seed):
    rows = generated(seed, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    connection = duckdb.connect()
    connection.register("given", df.toPandas())
    connection.execute("CREATE TABLE conversations AS SELECT * FROM given")
    columns = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "position"]
    expected = connection.execute(f"SELECT {', '.join(columns)} FROM ({quotes.ORACLE})").fetchall()
    plain = lambda found: sorted(
        repr(tuple(None if x != x else (int(x) if isinstance(x, float) else x) for x in r)) for r in found
    )
    got = quotes.reply_ordered(df).select(*columns).collect()
    assert plain(got) == plain(expected)
    assert sum(r.n_linked for r in got) > 50


def test_equal_turns_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, 0, "a", long)] * 2 + [(1, 1, "b", "> " + " ".join(f"w{i}" for i in range(700, 720)))]
    rows += [(1, 1, "b", "other"), (None, None, None, None)] * 2
    got = quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    linked = [r for r in got if r.n_quotes]
    assert [(r.n_linked, r.reply_to) for r in linked] == [(1, 0)]
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(5))
