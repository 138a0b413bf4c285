import os

from tidemark.operators import scoring
from tidemark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_training_is_not_cut(spark, monkeypatch):
    """50 trees of depth 3, as the reference trains."""
    models, train = [], scoring.train_gbt
    monkeypatch.setattr(scoring, "train_gbt", lambda *a, **b: models.append(train(*a, **b)) or models[-1])
    found = catalog.train_eval(spark, SF).first()
    assert found.trees == models[0].getNumTrees == 50
    assert max(t.depth for t in models[0].trees) <= 3 == models[0].getMaxDepth()
    assert found.beats_majority
