"""The benign sample about all labelled edges, against the sequential rule."""

from collections import Counter

from strandlog import plans
from strandlog.plans.views import Views


def test_benign_sample_is_about_every_labelled_edge_and_four_times_as_many(spark):
    data = "/root/testdata/sf0.01"
    v = Views(spark, data)
    rows = sorted(v.edges.join(v.labels, "txn_id").select("txn_id", "src", "dst", "label").collect())
    fraud = [r for r in rows if r.label]
    targets, had, want = {a for r in fraud for a in (r.src, r.dst)}, Counter(), []
    for r in rows:
        touched = [a for a in (r.src, r.dst) if a in targets]
        if not r.label and len(want) < 4 * len(fraud) and any(had[a] < 8 for a in touched):
            want.append(r.txn_id)
            had.update(touched)
    assert len(fraud) > 500
    assert sorted(r.txn_id for r in plans.queries()["benign_sample_capped"](spark, data).collect()) == want
