"""The report of resamplers counts the rows that they make, with one search of neighbours."""

import numpy as np
import pytest

from logforge.operators import balance


@pytest.mark.parametrize("gap", [20, 0])
def test_resample_report_counts_what_resamplers_make(spark, monkeypatch, gap):
    rng = np.random.default_rng(4)
    labels = [0] * (30 + gap) + [1] * 30
    df = spark.createDataFrame([(i, rng.normal(size=2).tolist(), c) for i, c in enumerate(labels)], "id long, x array<double>, label int").repartition(2)
    want = {c: [s.where(f"label = {c}").count() for s in (df, balance.smote(df), balance.adasyn(df))] for c in (0, 1)}
    searches, plain = [], balance.nearest
    monkeypatch.setattr(balance, "nearest", lambda *a, **k: searches.append(a) or plain(*a, **k))
    got = {r.label: [r.original, r.smote, r.adasyn] for r in balance.resample_report(df).collect()}
    assert got == want and len(searches) == (1 if gap else 0)
