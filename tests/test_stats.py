import math

from revlens.operators import stats


def test_information_of_a_matrix(spark):
    cells = [(0, 8, 3.0), (0, 7, 1.0), (1, 2, 2.0), (3, 9, 1.0), (4, 0, 5.0), (5, 6, 4.0)]
    (row,) = stats.information(spark.createDataFrame(cells, "bin int, col int, weight double"), 2, 7).collect()
    joint = {(True, True): 4 / 16, (True, False): 2 / 16, (False, True): 1 / 16, (False, False): 9 / 16}
    low, bad = {True: 6 / 16, False: 10 / 16}, {True: 5 / 16, False: 11 / 16}
    mutual = sum(p * math.log2(p / (low[x] * bad[y])) for (x, y), p in joint.items())
    entropy = lambda m: -sum(p * math.log2(p) for p in m.values())
    want = (mutual, entropy(bad), entropy(low), mutual / entropy(low))
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(row, want, strict=True))


def test_one_sided_matrices_have_no_information(spark):
    (row,) = stats.information(spark.createDataFrame([(3, 1, 2.0), (4, 2, 1.0)], "bin int, col int, weight double"), 2, 7).collect()
    assert row.mutual_information == 0 and row.entropy_bad == 0 and row.entropy_low == 0 and row.constraint_coefficient is None
