"""Replay of published reports: an 8-class confusion matrix must give the
published per-class table and scalar metrics (A15-A17)."""
import pytest

# FIXED VALUES: published 8-class confusion matrix (true rows x predicted columns)
CLASSES = ["Benign", "BruteForce", "DDoS", "DoS", "Mirai", "Recon", "Spoofing", "Web"]
MATRIX = [
    [15978, 35, 0, 0, 0, 1831, 2192, 48],
    [73, 1681, 1, 0, 0, 450, 373, 35],
    [3, 1, 355329, 22, 14, 18, 17, 2],
    [1, 1, 16, 74483, 0, 10, 6, 2],
    [0, 0, 4, 0, 526799, 2, 20, 0],
    [1839, 216, 18, 2, 2, 63733, 4665, 438],
    [2267, 259, 5, 2, 8, 4972, 89266, 522],
    [72, 33, 1, 2, 0, 874, 951, 3033],
]
# FIXED VALUES: published scalar metrics for that matrix
PUBLISHED = {
    "accuracy": 0.9806312015942712,
    "balanced_accuracy": 0.858131861582744,
    "f1_macro": 0.8708056975783438,
    "f1_weighted": 0.9805191097986738,
    "precision_macro": 0.8862347765934806,
    "recall_macro": 0.858131861582744,
}
PUBLISHED_BENIGN = (0.7896999950575792, 0.7955586536546505, 0.7926184984001786, 20084)
PUBLISHED_WEB = (0.7433823529411765, 0.6107531212243255, 0.6705726287862038, 4966)


@pytest.fixture(scope="module")
def conf(spark):
    rows = [(t, p, MATRIX[i][j]) for i, t in enumerate(CLASSES)
            for j, p in enumerate(CLASSES) if MATRIX[i][j]]
    return spark.createDataFrame(rows, "y_true string, y_pred string, n long")


def test_scalar_metrics(conf):
    from netlens.operators.evaluate import scalar_metrics
    got = scalar_metrics(conf).first().asDict()
    for k, v in PUBLISHED.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


def test_per_class(conf):
    from netlens.operators.evaluate import classification_report
    rep = {r["class"]: r for r in classification_report(conf).collect()}
    for name, exp in (("Benign", PUBLISHED_BENIGN), ("Web", PUBLISHED_WEB)):
        r = rep[name]
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(exp[:3], abs=1e-12)
        assert r["support"] == exp[3]
    assert rep["macro avg"]["f1"] == pytest.approx(PUBLISHED["f1_macro"], abs=1e-12)
    assert rep["weighted avg"]["f1"] == pytest.approx(PUBLISHED["f1_weighted"], abs=1e-12)
    assert rep["accuracy"]["precision"] == pytest.approx(PUBLISHED["accuracy"], abs=1e-12)


def test_reweighting_with_observed_priors_is_identity(conf, spark):
    """Reweighting by the held-out supports themselves returns the observed metrics."""
    from netlens.operators.evaluate import reweighted
    priors = spark.createDataFrame([(c, sum(MATRIX[i])) for i, c in enumerate(CLASSES)],
                                   "label string, n long")
    _, summary = reweighted(conf, priors)
    s = summary.first()
    assert s["accuracy"] == pytest.approx(PUBLISHED["accuracy"], abs=1e-12)
    assert s["f1_macro"] == pytest.approx(PUBLISHED["f1_macro"], abs=1e-12)
    assert s["f1_weighted"] == pytest.approx(PUBLISHED["f1_weighted"], abs=1e-12)
