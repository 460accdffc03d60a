"""Probe models over the vector trials."""

from pyspark.sql import functions as F

from trialloom.operators import probes, splits
from trialloom.plans.registry import query
from trialloom.plans.tables import SEED
from trialloom.plans.xfit_views import vec_donors
from trialloom.session import cut

CLASSES, FOLDS, GRID, RIDGE_GRID = 3, 3, [0.1, 1.0], [0.1, 1.0, 10.0]
PERMUTATIONS = 200


def probe_rows(t):
    rows = t.vec_trials.select("trial_id", "text_key", "subject_id", "reading_task", "length", "vector", (F.col("label") % CLASSES).cast("int").alias("y"))
    folds = splits.balanced_folds(rows, "text_key", "reading_task", FOLDS, SEED).select("text_key", "fold")
    return t.shared("probe_rows", lambda: rows.join(folds, "text_key"))


def with_x(rows):
    return rows.withColumn("x", F.col("vector").cast("array<double>"))


@query("I17_probe_classifier")
def i17(t):
    """Parameter by grouped folds, then out-of-fold predictions with it."""
    rows = with_x(probe_rows(t))
    parameter, score = probes.select_parameter(rows, "fold", "multiclass", GRID, CLASSES)
    out = probes.left_out(rows, "fold", "multiclass", [parameter], CLASSES, ["trial_id"])
    return out.withColumn("cv_utility", F.lit(round(score, 6)))


@query("I17_probe_ridge")
def i17b(t):
    """The length from the vector, out of fold, for the whole grid of penalties: cross products are added up once."""
    rows = with_x(probe_rows(t).withColumn("y", F.col("length").cast("double")))
    return probes.left_out(rows, "fold", "regression", RIDGE_GRID, CLASSES, ["trial_id"]).withColumn("yhat", F.round("yhat", 4))


@query("I17_probe_multilabel")
def i17c(t):
    """Out-of-fold predictions of label sets with none, one or two labels."""
    first, second = (F.col("length") % 4 != 0), F.col("length") % CLASSES
    hot = F.array(*[((first & (F.col("y") == i)) | ((F.col("length") % 2 == 0) & (second == i) & (F.col("length") % 8 != 0))).cast("int")
                    for i in range(CLASSES)])
    rows = with_x(probe_rows(t)).withColumn("y", hot).select("trial_id", "fold", "x", "y")
    return probes.labels_left_out(rows, "fold", "trial_id", CLASSES, 1.0)


def metadata_predictions(rows):
    """Every fold predicted from the metadata of the others."""
    return probes.left_out(probes.metadata_vectors(rows, ["reading_task", "subject_id"], ["length"]), "fold", "multiclass", [1.0], CLASSES, ["trial_id"])


@query("I18_metadata_baseline")
def i18(t):
    return metadata_predictions(probe_rows(t)).select("trial_id", "y", "yhat")


@query("I19_held_out_subjects")
def i19(t):
    """Screen on point gains, then every subject by a model without it, for the right and the wrong signal."""
    base = probe_rows(t)
    donors = vec_donors(t).select(F.col("target_id").alias("trial_id"), F.col("donor_id"))
    signal = base.select(F.col("trial_id").alias("donor_id"), F.col("vector").alias("wrong_vector"))
    wrong = base.drop("vector").join(donors, "trial_id").join(signal, "donor_id").withColumnRenamed("wrong_vector", "vector")
    rows, test_wrong = with_x(base), with_x(cut(wrong))
    right = probes.left_out(rows, "fold", "multiclass", [1.0], CLASSES, ["trial_id"])
    swapped = probes.left_out(rows, "fold", "multiclass", [1.0], CLASSES, ["trial_id"], test_wrong)
    scores = [probes.utility(cut(x), "multiclass", CLASSES) for x in (right, metadata_predictions(base), swapped)]
    passed = probes.point_gain(*scores)
    out = probes.left_out(rows, "subject_id", "multiclass", [1.0], CLASSES, ["trial_id", "subject_id"])
    return out.drop("parameter").withColumn("screen_passed", F.lit(passed))


@query("I20_decodability")
def i20(t):
    rows = with_x(probe_rows(t)).select("trial_id", "fold", "x", "y")
    shuffled = cut(splits.permuted_labels(rows.select("trial_id", "y"), "trial_id", "y", PERMUTATIONS, SEED))
    return probes.decodability(rows, "fold", CLASSES, shuffled, "trial_id")
