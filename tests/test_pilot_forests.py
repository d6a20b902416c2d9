"""The window selection pilot grows one forest at a time."""

import threading

import pytest

from strideframe.operators.models import ensembles as ens
from strideframe.plans import studies as st


class Stop(Exception):
    pass


def test_one_forest_at_a_time(spark, monkeypatch):
    rows = [(s, p, s, (p + s) % 3, [float(p % 5), float(s)], 0.5, 0.5, 0.5) for s in range(3) for p in range(12)]
    scores = ",".join(f"{c} double" for c in st.bud.SCORES)
    table = spark.createDataFrame(rows, f"stream long, pos long, who long, code int, features array<double>, {scores}")
    threads, make = set(), ens.random_forest
    monkeypatch.setattr(ens, "random_forest", lambda trees: threads.add(threading.get_ident()) or make(trees, depth=2))

    def stop(predicted, *_):
        assert predicted.count() == len(rows)
        raise Stop

    monkeypatch.setattr(st.bud, "trigger_thresholds", stop)
    with pytest.raises(Stop):
        st.pilot(table, [0, 1, 2], folds=3, trees=2)
    assert threads == {threading.get_ident()}
