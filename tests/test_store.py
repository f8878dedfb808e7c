from functools import reduce
from itertools import permutations
from operator import add

from revlens.operators import store


def test_sums_at_the_least_value_do_not_depend_on_order(spark):
    orders = list(permutations([2.49, 13.41, 12.94, 11.16]))
    assert len({reduce(add, o) > 40 for o in orders}) == 2  # as doubles some orders end above, others do not
    rows = [(k, x) for k, o in enumerate(orders) for x in o] + [(100, 40.0), (100, 0.01), (101, -40.0), (101, -0.01), (102, 1e300), (102, 1.0), (103, float("inf")), (104, None), (104, 41.0)]
    told = store.worth_writing(spark.createDataFrame(rows, "k int, x double").coalesce(1), "k", "x", 40.0)
    assert {r.k: r.x for r in told.collect()} == {100: 40.01, 101: -40.01, 102: 1e300, 103: float("inf"), 104: 41.0}
