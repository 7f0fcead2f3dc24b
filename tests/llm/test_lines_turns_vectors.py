"""Line dedup, conversation repair and whitening against brute force, with the edge cases of their docstrings."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from haneul.llm import line_dedup, queries, repair, whitening

SPACES = " \t\n\x0b\x0c\r"


# -- lines


def _line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def _dedup(rows, min_chars=40, min_docs=5):
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[_line_key(line)].add(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not ((k := _line_key(x)) in last and last[k] != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _line_rows():
    rng = random.Random(5)
    said = [f"  The {c} shared line that É and Ş stand in, number {i}.\t" for i, c in enumerate("ABCDEFGH")]
    vary = lambda x: rng.choice([x, x.upper().replace("É", "É"), x.strip(), "\x0b" + x, x.lower()])
    rows = [(i, "\n".join(rng.choice([vary(rng.choice(said)), f"own line {i} {rng.random()}", "", "short"]) for _ in range(rng.randrange(6)))) for i in range(250)]
    line = "A line that the rows without an id hold too, and five others."
    rows += [(None, line), (None, line + "\nmore"), *((600 + i, line) for i in range(4)), (700, None), (701, ""), (702, "\n\n")]
    rows += [(300, said[0] + "\n" + said[0])] * 3 + [(300, said[0] + "\nanother text of one id")]
    rows += [(400 + i, "\n".join([said[1]] * 5000 + [f"x{i}"] + [" " * 60])) for i in range(2)]
    rows += [(500 + i, "kelvin K sign and İ make keys of their own, k and i do not" if i % 2 else "kelvin k sign and i make keys of their own, k and i do not..") for i in range(9)]
    return rows


def test_lines_equal_brute_force(spark):
    rows = _line_rows()
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, line string, n_lines long").repartition(5)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str)
    assert found == sorted(_dedup(rows), key=str)
    assert sum(r[2] for r in found) > 5_000


def test_lines_keep_null_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()] == [(None, None, 1, 0), (1, None, 1, 0)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_run_without_python(spark, sf):
    plan = queries.op13_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- turns


def _damaged(rows):
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else x
        fault = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if fault:
            row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text)
            yield from [row] * (2 if fault == 3 else 1)


def _repair(turns):
    """The expected summary and text of one conversation's turns, by one pass over states that carries all it made."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, counts, best = set(), collections.Counter(), {0: (0, "", ())}
    ins = {0: [(2, "user")], 1: [(2, "user")], 3: [(2, "user")], 2: [(3, "assistant")]}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for p, (c, a, o) in list(out.items()):
                for q, role in ins[p]:
                    new = (c + 3, a + "I", (*o, f"{role}:"))
                    out[q] = min(out.get(q, new), new)
        return out

    for _, _, role, text in turns:
        bare, again = text.strip(SPACES), (role, text) in seen
        seen.add((role, text))
        fault = "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else None
        counts[fault] += 1
        now = {}
        for p, (c, a, o) in inserted(best).items():
            ways = [(p, c + 4, a + "D", o)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (p, role[:1]) in moves:
                    ways.append((moves[p, role[:1]], c + extra, a + "K", (*o, f"{role}:{text}")))
                ways += [(q, c + 3 + extra, a + "R", (*o, f"{r}:{text}")) for q, r in ins[p]]
            for q, *rest in ways:
                now[q] = min(now.get(q, tuple(rest)), tuple(rest))
        best = now
    cost, audit, out = min(v for q, v in inserted(best).items() if q in (0, 3))
    numbers = [t[1] for t in turns if t[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _check_repair(spark, rows, partitions=7):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, at int").repartition(partitions)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digest(df, repair.damage(df)).collect()}
    by = collections.defaultdict(list)
    for r in _damaged(rows):
        by[r[0]].append(r)
    assert got == {c: _repair(by[c]) for c in {r[0] for r in rows}}
    return got


def test_turns_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["Yes.", "no", "Well?", "", " \t", "A long reply!\n", "cut off", "End. ", None, "Yes."]
    roles = ["user", "assistant", "system", "tool", "", "User", None, "student", "user", "assistant"]
    rows = [(c, t if rng.random() > 0.1 else rng.choice([None, 0, t + 3]), rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", f"{t}.") for t in range(5)] + [(None, None, None, None)]
    rows += [(-c, c, "user", "dropped.") for c in range(1, 60)]
    got = _check_repair(spark, rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for v in got.values())


def test_long_conversations_are_folded_level_by_level(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "same."])) for t in range(5_000)]
    rows += [(2, t, "user", f"{t}.") for t in range(64)] + [(3, t, "user", f"{t}.") for t in range(65)] + [(4, 1, "user", "all equal.")] * 3_000 + [(5, None, "assistant", f"{t}.") for t in range(200)]
    _check_repair(spark, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = repair.ordered(df).where("conv_id = 4").groupBy("range").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1  # equal rows are no hot key


def test_repaired_turns_have_the_form(spark, sf):
    summary, turns = repair.repair(repair.damage(queries.table(spark, sf, "conversations")))
    by = collections.defaultdict(str)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r["at"])):
        by[r.conv_id] += r.role[0]
    import re

    assert by and all(re.fullmatch("s?(ua)+", v) for v in by.values())
    assert {r.conv_id for r in summary.collect()} >= set(by)


def test_no_turns(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair_digest(df, repair.damage(df)).collect() == []


# -- vectors


def _whole(rows):
    width = max((len(v) for v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)), default=0)
    return [i for i, v in enumerate(rows) if v is not None and len(v) == width and width and all(x is not None and np.isfinite(x) for x in v)]


def _check_whitening(spark, rows, components=8, kind="float"):
    df = spark.createDataFrame([(i, v, f"n{i}") for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>, whitened string").repartition(3)
    model = whitening.fit(df, components=components)
    got = {r.vec_id: r for r in whitening.transform(df, model).collect()}
    kept = _whole(rows)
    assert sorted(got) == kept
    if not kept:
        return model
    x = np.floor(1024 * np.array([rows[i] for i in kept], np.float64 if kind == "double" else np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    for i, row in zip(kept, n * x - s):
        assert got[i].deviation == (want if (want := sum(int(v) ** 2 for v in row)) < 1 << 63 else None)
    centred = (n * x - s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = len(model.eigenvalues)
    assert k == min(components, int((e > 1e-12 * e[0]).sum())) or e[0] <= 0 == k
    if not k:
        return model
    np.testing.assert_allclose(model.eigenvalues, e[:k], rtol=1e-9, atol=1e-12 * e[0])
    np.testing.assert_allclose(np.abs((model.directions * u[:, :k]).sum(0)), 1, atol=1e-9)
    np.testing.assert_allclose(model.trace, e.sum(), rtol=1e-9)
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    have = np.array([got[i].whitened for i in kept])
    np.testing.assert_allclose(np.abs(have), np.abs(want), atol=1e-5)
    assert whitening.identity_error(df, model) < 1e-9
    assert model.residuals.max() <= 1e-12 * e[0]
    return model


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(7)
    rows = [[float(v) for v in r] for r in rng.standard_normal((400, 40)) * np.linspace(2, 0.5, 40)]
    rows += rows[:150] + [None, [], [None] * 40, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [1.0] * 39]
    _check_whitening(spark, rows)


def test_whitening_of_wide_vectors_iterates(spark):
    rng = np.random.default_rng(8)
    rows = [[float(v) for v in r] for r in rng.standard_normal((300, 120)) * np.linspace(3, 1, 120)]
    assert _check_whitening(spark, rows, 3, "double").passes > 5


@pytest.mark.parametrize("rows", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 9, [[float(i), 2.0 * i, 0.5] for i in range(20)], [[1e30, 0.0], [0.0, 1.0], [-1e30, 1.0]]])
def test_whitening_of_few_or_flat_vectors(spark, rows):
    if rows and rows[0] and rows[0][0] == 1e30:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        found = whitening.transform(df, whitening.fit(df)).orderBy("vec_id").collect()
        assert [r.deviation is None for r in found] == [True, False, True] and len(found[0].whitened) == 1
        return
    _check_whitening(spark, rows)


def test_whitening_query(spark, sf):
    rows = queries.op11_whitening(spark, sf).collect()
    n = queries.table(spark, sf, "embeddings").count()
    assert len(rows) == 8 * n and {r.n for r in rows} == {n} and {r.component for r in rows} == set(range(1, 9))
    assert max(r.identity_error for r in rows) <= 1e-4 and len({r.explained for r in rows}) == 8


def test_batches_of_groups_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(c, 0, k, 4 * rng.randrange(4) + rng.randrange(4), k == 0) for c in range(300) for k in range(rng.randrange(1, 9))]
    table = pa.table(dict(zip(("conv_id", "grp", "k", "kind", "begins"), map(list, zip(*rows)))))
    whole = pa.Table.from_batches(repair._fold(True)(iter(table.to_batches())))
    monkeypatch.setattr(repair, "BATCH", 50)
    parts = list(repair._fold(True)(iter(table.to_batches(max_chunksize=7))))
    assert len(parts) > 10 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
