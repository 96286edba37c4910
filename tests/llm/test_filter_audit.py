"""The filter audit against every order applied one document at a time."""

import re
from itertools import permutations

import pytest

from faultline.llm import filter_audit

DOCUMENTS = "doc_id long, text string, lang string, _key int, part string, _digest int"
LABELS = "doc_id long, quality int, toxic int, text string"
PLAIN = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, PLAIN, "en"),
    (2, PLAIN, "en"),
    (2, PLAIN, "en"),
    (3, PLAIN.upper(), "en"),
    (4, "again " * 200, "en"),
    (5, "again " * 200, None),
    (6, None, None),
    (7, "", "fr"),
    (8, "short # text", "fr"),
    (None, PLAIN, "fr"),
    (None, PLAIN, "fr"),
    (9, "É " * 100_000 + "\x0b\x0c\r A$", "fr"),
    (0, "only one", ""),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, None, 0), (3, 0, 1), (6, 1, None), (99, 1, 1), (None, 1, 1)]


def brute(rows, marks):
    low = {}
    for key, text, _ in rows:
        if key is not None:
            low[text or ""] = min(key, low.get(text or "", key))
    checked = []
    for key, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)),
            key is not None and key > low[t],
        ]
        good = key is not None and any(k == key and q == 1 for k, q, _ in marks)
        toxic = key is not None and any(k == key and x == 1 for k, _, x in marks)
        checked.append((lang or "", dict(zip("ABCDE", fails)), good, toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in checked}:
            left = [x for x in checked if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, order, step] = (
                    len(left),
                    len(now),
                    sum(x[1][f] for x in gone),
                    sum(x[0] == part and x[1][f] and sum(x[1].values()) == 1 for x in checked),
                    sum(x[2] for x in now),
                    sum(x[3] for x in now),
                )
                gone += now
    shapley = {}
    for (part, order, step), row in out.items():
        at = part, order[step - 1]
        shapley[at] = shapley.get(at, 0) + row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, marks, **options):
    documents = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCUMENTS)
    labels = spark.createDataFrame([(*m, "y") for m in marks], LABELS)
    got = filter_audit.filter_audit(documents, labels, **options).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


@pytest.mark.parametrize("max_blocks", [1, 1 << 20])
def test_audit_by_hand(spark, max_blocks):
    assert audited(spark, ROWS, MARKS, max_blocks=max_blocks) == brute(ROWS, MARKS)


def test_full_sketch_stays_exact(spark):
    rows = [(i, f"text {i % 700}", "en") for i in range(1000)]
    assert audited(spark, rows, [], max_blocks=1) == brute(rows, [])


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, ROWS[:1], []) == brute(ROWS[:1], [])


def test_sketch_clears_most_unique_texts(spark):
    texts = spark.range(5000).selectExpr(
        "id AS _key", "concat('t', id - IF(id % 10 = 0 AND id > 0, 1, 0)) AS _text"
    )
    texts = texts.selectExpr("*", "sha2(_text, 256) AS _digest")
    cells = filter_audit.repeated_cells(texts, 157)
    left = filter_audit.possible_repeats(texts, cells, 157)
    repeated = texts.join(texts.groupBy("_text").count().filter("count > 1"), "_text")
    assert repeated.join(left, "_key", "left_anti").count() == 0
    assert left.count() < repeated.count() + 100
