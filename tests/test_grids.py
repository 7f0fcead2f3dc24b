"""Tables of placed words, upright and turned, with two header rows."""

import random

from haneul.operators import grids


def page(rng, labels, years, measures, turn):
    words, want, width, height = [], [], 900, 600
    for j, y in enumerate(years):
        words.append((str(y), 200 + 160 * j - 12, 40, 200 + 160 * j + 12, 50))
        for k, m in enumerate(measures):
            right = 180 + 160 * j + 70 * k
            words.append((m, right - 6 * len(m), 60, right, 70))
    for i, label in enumerate(labels):
        for n, part in enumerate(label.split()):
            words.append((part, 10 + 40 * n, 90 + 15 * i + rng.choice([0, 1, 2]), 10 + 40 * n + 6 * len(part), 100 + 15 * i))
        for j, y in enumerate(years):
            for k, m in enumerate(measures):
                value = rng.choice([None, 0.5, -3.25, 1234.5, 7.0, 120.0])
                if value is not None:
                    text = f"{abs(value):,}" if value >= 0 else f"△{abs(value):,}"
                    right = 180 + 160 * j + 70 * k
                    words.append((text, right - 6 * len(text), 90 + 15 * i, right, 100 + 15 * i))
                    want.append((label, [str(y), m], value))
    if turn == "left":
        words = [(s, t, width - x1, b, width - x0) for s, x0, t, x1, b in words]
    if turn == "right":
        words = [(s, height - b, x0, height - t, x1) for s, x0, t, x1, b in words]
    rng.shuffle(words)
    return words, want


def test_grids_come_back_whole():
    rng = random.Random(6)
    for n in range(60):
        labels = [f"{c} growth rate"[: rng.randrange(1, 13)].strip() for c in "abcdefgh"[: rng.randrange(3, 9)]]
        words, want = page(rng, labels, range(2020, 2020 + rng.randrange(2, 5)), ["level", "chg"][: rng.randrange(1, 3)], ["", "left", "right"][n % 3])
        assert sorted((label, headers, value) for _, label, _, headers, value in grids.cells(words)) == sorted(want), n


def test_figures():
    assert [grids.figure(x) for x in ("1,234.5", "△3.2", "-7", "12%", "a1", "", "2024년", "△")] == [1234.5, -3.2, -7.0, 12.0, None, None, None, None]


def test_pages_without_a_table(spark):
    rows = [("p", "only", 1.0, 1.0, 5.0, 3.0), ("q", None, 1.0, 1.0, 2.0, 2.0), ("r", "5", None, 1.0, 2.0, 2.0), ("s", "5", 50.0, 1.0, 55.0, 3.0), ("s", "x", 1.0, 1.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "page string, text string, x0 double, top double, x1 double, bottom double")
    assert [tuple(r) for r in grids.recovered(df).collect()] == [("s", 0, "x", 0, [], 5.0)]
    assert grids.recovered(df.limit(0)).count() == 0
