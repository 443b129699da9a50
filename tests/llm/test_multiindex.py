import numpy as np

from marginalia.llm import multiindex
from marginalia.llm.multiindex import Grid, MultiIndex, unit


def brute(rows, cosine):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: {j for j, b in good.items() if j != i and len(b) == len(a) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine} for i, a in good.items()}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


def rows(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(40):
        base = rng.normal(size=16)
        copies = [base + rng.normal(size=16) * 0.08 for _ in range(rng.integers(1, 9))]
        out += [c.astype("f4").tolist() for c in copies] + [copies[0].astype("f4").tolist()] * int(rng.integers(0, 3))
    out += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.1], [3.0]]
    order = rng.permutation(len(out))
    return [(int(i) * 2, out[k]) for i, k in enumerate(order)]


def result(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS n")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in MultiIndex(df).run().collect()}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    monkeypatch.setattr(multiindex, "CELL_ROWS", 8)
    data = rows(1)
    want, got = brute(data, 0.95), result(spark, data)
    assert got.keys() == want.keys()
    true, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert found >= 0.97 * true
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    grid = Grid(unit(rng.normal(size=(300, 10)), 10), 6)
    x = unit(rng.normal(size=(5, 10)), 10)
    one, two = grid.distances(x)
    for i in range(5):
        total = (one[i][:, None] + two[i][None, :]).ravel()
        assert grid.visits(x, 9)[i].tolist() == np.argsort(total, kind="stable")[:9].tolist()
        assert [grid.place(one[i], two[i], c) for c in grid.visits(x, 9)[i].tolist()] == list(range(9))


def test_few_links_in_a_fine_grid_are_all_found(spark, monkeypatch):
    """One vector in 50 has a partner just beyond the bound; the nearest eight cells miss some."""
    monkeypatch.setattr(multiindex, "FIT_ROWS", 512)  # as in a large table, codes are fitted on a part
    monkeypatch.setattr(multiindex, "CELL_ROWS", 0.4)
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(6000, 64)), 64)
    away = rng.normal(size=(60, 64))
    away = unit(away - (away * x[:60]).sum(1, keepdims=True) * x[:60], 64)
    x[-60:] = 0.951 * x[:60] + np.sqrt(1 - 0.951**2) * away
    x = x.astype("f4").astype(float)
    near = unit(x, 64) @ unit(x, 64).T >= 0.95
    np.fill_diagonal(near, False)
    got = result(spark, list(enumerate(x.tolist())))
    assert near.sum() >= 120 and [got[i][0] for i in range(6000)] == near.sum(axis=1).tolist()


def test_bound_of_the_half_distances():
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(400, 10)), 10)
    grid = Grid(x, 8)
    one, two = grid.least(x)
    a, b = np.divmod(grid.cells(x), grid.shape[1])
    assert (one[:, a] + two[:, b] <= 2 - 2 * x @ x.T + 1e-9).all() and (one[:, a] + two[:, b]).max() > 0.1
