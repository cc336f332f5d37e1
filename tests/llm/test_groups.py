import numpy as np
import pytest

from terrafold.llm.common import materialize
from terrafold.llm.groups import components, group_links


def comparison():
    """Links of numbers that differ by 1 at most; a closure, as executors don't import tests."""

    def near(rows, label, second):
        v = np.array([x[0] for x in rows])
        i, j = np.nonzero(np.triu(np.abs(v[:, None] - v[None, :]) <= 1, 1) & (label[:, None] != label[None, :]))
        keep = np.ones(len(i), dtype=bool) if second is None else second[i] != second[j]
        return i[keep], j[keep]

    return near


@pytest.mark.parametrize("values", [list(range(0, 400, 2)), list(range(60)), [*range(80), *range(200, 260), *range(400, 600, 3)], [7] * 90])
@pytest.mark.parametrize("side", [4, 16, 512])
def test_links_connect_what_all_pairs_connect(spark, values, side):
    rows = [(k % 2, k * 10 + 3, v, 1) for k, v in enumerate(values)]
    member = materialize(spark.createDataFrame(rows, "root long, id long, v long, size long").repartition(3))
    links = group_links(member, ["v"], comparison(), side=side)
    got = {r.node: r.root for r in components(links).collect()}
    label = {i: i for _, i, _, _ in rows}
    while True:
        new = {i: min(label[j] for r2, j, v2, _ in rows if r2 == r and abs(v2 - v) <= 1) for r, i, v, _ in rows}
        if new == label:
            break
        label = new
    assert {i: got.get(i, i) for i in label} == label


def test_no_member_gives_no_link(spark):
    member = spark.createDataFrame([], "root long, id long, v long, size long")
    assert group_links(member, ["v"], comparison()).count() == 0
