import random
from fractions import Fraction

import numpy as np
import pytest
from brute import jaccard_join

from millrace.llm import jaccard_join as J


def check(spark, rows, n, least):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in J.join(df, n=n, least=least, links=True).collect())
    want = sorted((str(rows[k][0]), s, str(c), x) for k, (s, c, x) in jaccard_join(rows, n, least).items())
    assert got == want


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(200)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: -rng.randrange(1, 6)]
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 30, 90, 250]))
            if rng.random() < 0.5:
                w[0:0] = passage
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("n,least,seed", [(3, Fraction(9, 10), 1), (5, Fraction(4, 5), 2)])
def test_all_links_are_found(spark, n, least, seed):
    check(spark, texts(seed, 160), n, least)


@pytest.mark.parametrize("sets,seed", [(4, 5), (2, 6), (3, 7), (1, 8)])
def test_tiles(spark, monkeypatch, sets, seed):
    """The same result when fields spread over many tiles."""
    monkeypatch.setattr(J, "BLOCK_SETS", sets)
    monkeypatch.setattr(J, "MAP_SETS", sets + 1)
    check(spark, texts(seed, 120), 3, Fraction(4, 5))


def chains(n, step, length=40):
    """Texts of which each links with the next only, in no order."""
    words = [f"w{k}" for k in range(n * step + length)]
    out = [(k, " ".join(words[k * step : k * step + length])) for k in range(n)]
    random.Random(3).shuffle(out)
    return out


def test_chains_cross_blocks(spark, monkeypatch):
    """Links that no head of a group has are found crosswise."""
    monkeypatch.setattr(J, "BLOCK_SETS", 5)
    monkeypatch.setattr(J, "MAP_SETS", 9)
    rows = chains(60, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in J.join(df, n=1, least=Fraction(9, 10)).collect()} == {0}
    check(spark, rows + [(1000 + i, t + " other") for i, t in chains(30, 4)], 2, Fraction(4, 5))


def test_a_large_near_group_takes_few_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 16)
    monkeypatch.setattr(J, "MAP_SETS", 16)
    met = []
    for name in ("tiles", "maps"):

        def counted(self, chosen, *rest, real=getattr(J.Fields, name)):
            met.append(chosen.selectExpr("sum(size(tiles))").first()[0])
            return real(self, chosen, *rest)

        monkeypatch.setattr(J.Fields, name, counted)
    base = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 :]])) for i in range(600)]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, least=Fraction(4, 5)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(met) < 3 * len(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(spark, rows, 3, Fraction(9, 10))
    kept = J.keep(odd)
    assert kept.columns == odd.columns and J.join(none).count() == 0 == J.join(none, links=True).count() and J.keep(none).count() == 0
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert got.count("5") == 2  # rows that repeat an id and text are one row to this operator
    assert "7" in got and "6" not in got and got.count("None") == 1


@pytest.mark.parametrize("marks", [0.0, 0.5, 1.0])
def test_signatures_lose_no_pair(marks):
    """Sets at the threshold share a signature whatever shingles count as common."""
    rng = np.random.default_rng(4)
    common = rng.random(1 << J.CELL_BITS) < marks
    for least in (Fraction(9, 10), Fraction(4, 5)):
        classes = J.Classes(least)
        for size in (1, 2, 5, 9, 14, 40, 150, 600):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            for differ in range(size):
                b = np.unique(np.concatenate([a[differ:], rng.integers(0, 1 << 63, differ // 2, dtype=np.uint64)]))
                if Fraction(len(np.intersect1d(a, b)), len(np.union1d(a, b))) < least:
                    break
                keys, owners = J.signatures([a, b], classes, common)
                assert set(keys[owners == 0]) & set(keys[owners == 1])


def test_tiles_are_exact():
    rng = np.random.default_rng(1)
    arrays = sorted((np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(60)), key=len)
    near = lambda a, b: 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b))
    links = J.counted(arrays, [0] * 60, [1] * 60, Fraction(1, 2))
    assert links == [sum(near(a, b) for j, b in enumerate(arrays) if j != i) for i, a in enumerate(arrays)]
    sides = [1 + k % 2 for k in range(60)]
    links = J.counted(arrays, sides, [1] * 60, Fraction(1, 2))
    assert links == [sum(near(a, b) for j, b in enumerate(arrays) if sides[j] != sides[i]) for i, a in enumerate(arrays)]
    names = [bytes([k]) for k in range(60)]
    new = J.grouped(J.Tile(arrays, [0] * 60, Fraction(1, 2)), names)
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if near(arrays[i], arrays[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert new == [names[r] for r in root]


def test_bitmaps_keep_every_link():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    arrays = sorted((np.unique(np.concatenate([base[: rng.integers(200, 900)], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(50)), key=len)
    group = lambda sets, least: J.grouped(J.MapTile([len(a) for a in sets], [J.bitmap(a) for a in sets], [0] * len(sets), least), list(range(len(sets))))
    roots = group(arrays, Fraction(9, 10))
    for i, a in enumerate(arrays):
        for j, b in enumerate(arrays):
            if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)):
                assert roots[i] == roots[j]
    strangers = sorted((np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(30)), key=len)
    assert group(strangers, Fraction(4, 5)) == list(range(30))


def test_components_of_hot_and_long_shapes(spark):
    from millrace.llm.components import components

    star = [(1, k) for k in range(2, 400)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 800 + k) for k in range(50)] + [(7000, 7000)]
    random.Random(1).shuffle(star)
    got = dict(map(tuple, components(spark.createDataFrame(star, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 400)} | {500 + k: 500 for k in range(61)} | {k: 800 for k in [*range(800, 850), 900]}
