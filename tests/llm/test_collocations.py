"""Collocations against counts of every phrase, and the suffix arrays against sorted suffixes."""

import collections
import re

import duckdb
import numpy as np
import pytest

from tracewell.llm import collocations, queries

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, longest=4):
    f = collections.defaultdict(collections.Counter)
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def mined(rows, least, top, percent):
    out = []
    for lang, g in phrases(rows).items():
        n = sum(v for p, v in g.items() if len(p) == 1)
        own = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in own.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * own[q := p[i : i + m]]}
        best = []
        for p, a in own.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(11)
    vocab = [f"w{i}é"[: 2 + i % 3] for i in range(25)]
    rows = [(None, None), ("en", ""), ("en", " \t "), ("en", ".,;:"), (None, "Le Chat. LE chat\tle  chat"), ("und", "le chat!le chat"), ("x", "a " * 3000), ("y", "日本 語 x 日本 語 x"), ("en", "\x0bÄ ä\x0c")]
    for _ in range(60):
        words = rng.choice(vocab, int(rng.integers(1, 60)), p=np.arange(25, 0, -1) / 325)
        rows.append((str(rng.choice(["en", "de"])), "".join(w + str(rng.choice([" ", "  ", "\t", ". ", "\n", " new york city "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.1])) for w in words)))
    return rows + rows[-5:]


@pytest.mark.parametrize(("least", "top", "percent"), [(2, 2000, 80), (3, 7, 50), (30, 2000, 80), (1, 100, 101)])
def test_against_counts(spark, least, top, percent):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(3)
    got = collocations.mine(df, least=least, top=top, percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, least, top, percent)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "BITS", 15)
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), least=2)
    assert sorted(map(tuple, got.collect())) == mined(rows, 2, 2000, 80)


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", ".")], "lang string, text string")).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 80))
        ids, last = rng.integers(0, 4, n), rng.random(n) < 0.2
        last[-1] = True
        for depth in (1, 2, 4):
            left = collocations.lengths_left(ids, last, depth)
            suffixes = []
            for i in range(n):
                s = []
                for j in range(i, n):
                    if not ids[j] or len(s) == depth:
                        break
                    s.append(int(ids[j]))
                    if last[j]:
                        break
                suffixes.append(tuple(s))
            assert left.tolist() == [len(s) for s in suffixes]
            order, shared = collocations.suffix_array(ids, left, depth)
            rows = [suffixes[i] for i in order]
            assert rows == sorted(rows)
            assert shared[1:].tolist() == [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(rows, rows[1:], strict=False)]
            for k in range(1, depth + 1):
                at, many = collocations.lcp_counts(order, shared, left, k)
                assert {suffixes[i][:k]: int(m) for i, m in zip(at, many, strict=True)} == collections.Counter(s[:k] for s in suffixes if len(s) >= k)


def test_sql_on_the_same_rows(spark, tmp_path):
    rows = corpus() * 6
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.OP13_SQL).fetchall()
    assert len(want) > 20 and sorted(want) == sorted(map(tuple, queries.op13_collocations(spark, str(tmp_path)).collect())) == mined(rows, 30, 2000, 80)
