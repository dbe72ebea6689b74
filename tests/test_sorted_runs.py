"""A key's rows of a trigger come in runs of bounded size."""

import numpy as np
import pandas as pd

from gritsieve.streaming import keyed as Y


def test_a_triggers_rows_come_sorted_in_runs():
    rng = np.random.default_rng(4)
    n = 2 * Y.RUN + 500
    rows = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 5000, n), unit="s"), "id": rng.permutation(n), "features": [np.array([float(k)]) for k in range(n)], "error": None})
    rows.loc[:3, "error"] = "bad"  # other parts have no value in this column
    runs = list(Y.sorted_runs((rows.iloc[a : a + 3000] for a in range(0, n, 3000)), ["ts", "id"]))
    assert [len(r) for r in runs] == [Y.RUN, Y.RUN, 500]
    want = rows.sort_values(["ts", "id"], ignore_index=True)
    got = pd.concat(runs, ignore_index=True)
    assert got["id"].tolist() == want["id"].tolist() and [x[0] for x in got["features"]] == [x[0] for x in want["features"]]
    assert got["error"].notna().sum() == 4
