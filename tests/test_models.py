"""Trees, planes and token attributions."""

import numpy as np
from small import rows

from chronocohort.operators import attribution as A
from chronocohort.operators import features as FE


def test_joint_plane_keeps_sets_and_ids(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(60, 4)) * [5, 3, 1, 0.5]
    sets = {n: spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points[k::3])], "i int, v array<double>") for k, n in enumerate("abc")}
    got = FE.pca_joint(sets, "i", "v").toPandas()
    assert sorted(zip(got.source, got.i)) == sorted((n, i) for n in "abc" for i in range(20))
    top = np.sort(np.linalg.eigvalsh(np.cov(points.T)))[::-1]
    np.testing.assert_allclose([got.pc1.var(), got.pc2.var()], top[:2], rtol=1e-9)


def test_tokens_of_late_cycles_are_ranked(spark):
    data = [(1, c, p, t, s) for c, p, t, s in [(1, 1, "a", 0.5), (2, 1, "a", 0.4), (5, 1, "late", 0.9), (5, 2, "late", 0.7), (9, 1, "z", 0.1)]]
    df = spark.createDataFrame(data, "subject_id int, cycle_number int, position int, token string, rollout_score double")
    assert rows(A.token_by_cycle(df, "subject_id", "cycle_number", 2), "token", "cycle_number", "score", "rank") == [("a", 1, 0.5, 2), ("a", 2, 0.4, 2), ("late", 5, 0.9, 1)]
