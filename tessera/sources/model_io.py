"""Save / load a trained model with its preparation state.

Layout under ``<dir>/<name>``: ``model`` (Spark ML writer output) and
``metadata`` (one JSON row: model class, feature names, label classes,
fitted preparation state, timestamp).  Models of plain numbers (linear SVR, softmax
boosting, pairwise SVM) and kernel feature maps lie in the metadata, a nearest-neighbour model's
training rows as Parquet under ``model``.
"""

from __future__ import annotations

import datetime
import importlib
import json
import os

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.prepare import FittedPrep, LabelEncoding, PrepConfig


def _prep_state(p: FittedPrep) -> dict:
    return {"numeric": p.numeric, "categorical": p.categorical, "config": p.config.__dict__,
            "numeric_fill": p.numeric_fill, "categorical_fill": p.categorical_fill,
            "clip": {k: list(v) for k, v in p.clip.items()}, "scale": {k: list(v) for k, v in p.scale.items()},
            "categories": p.categories}


def save_model(result, base_dir: str, model_name: str) -> str:
    """Persist a TrainResult; returns the model folder."""
    path = os.path.join(base_dir, model_name)
    m = result.model
    calibration = None
    if type(m).__name__ == "PlattScaled":  # margin classifier + logistic calibration
        calibration, m = [m.a, m.b], m.model
    meta = {"model_name": model_name, "estimator": result.model_name,
            "is_classification": result.is_classification,
            "feature_names": result.feature_names,
            "target": result.label.column, "task": result.label.task, "classes": result.label.classes,
            "prep": _prep_state(result.prep), "best_params": {k: str(v) for k, v in result.best_params.items()},
            "timestamp": datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S"), "calibration": calibration}
    kind = type(m).__name__
    if hasattr(m, "write"):
        m.write().overwrite().save(os.path.join(path, "model"))
        meta["model_class"] = f"{type(m).__module__}.{kind}"
    elif kind == "KNNClassifierModel":
        m.train.write.mode("overwrite").parquet(os.path.join(path, "model"))
        meta["model_class"] = "knn"
        meta["knn"] = [m.k, m.weights, m.p, m.features_col, m.label_col, m.classes]
    elif kind == "SoftmaxBoostingModel":
        meta["model_class"] = "softmax_boosting"
        meta["boosting"] = m.state()
    elif kind == "PairwiseSVMModel":
        meta["model_class"] = "pairwise_svm"
        meta["pairwise"] = m.state()
    else:  # driver-held linear model (SVR): coefficients in the metadata
        meta["model_class"] = "linear"
        meta["coefficients"] = [float(v) for v in m.coefficients.toArray()]
        meta["intercept"] = float(m.intercept)
    meta["feature_map"] = result.feature_map.state() if result.feature_map is not None else None
    spark = result.metrics.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(
        os.path.join(path, "metadata"))
    return path


class LoadedModel:
    def __init__(self, model, prep: FittedPrep, label: LabelEncoding, meta: dict, feature_map=None):
        self.model, self.prep, self.label, self.meta, self.feature_map = model, prep, label, meta, feature_map

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        x = self.prep.assemble(df, keep=keep)
        return self.model.transform(self.feature_map(x) if self.feature_map is not None else x)


def load_model(spark: SparkSession, path: str) -> LoadedModel:
    """Inverse of ``save_model``; raises when the folder is not a saved model."""
    try:
        meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()[0])
    except Exception as e:  # noqa: BLE001
        raise RuntimeError(f"no readable model there: {e}") from e
    st = meta["prep"]
    prep = FittedPrep(st["numeric"], st["categorical"], PrepConfig(**st["config"]), st["numeric_fill"],
                      st["categorical_fill"], {k: tuple(v) for k, v in st["clip"].items()},
                      {k: tuple(v) for k, v in st["scale"].items()}, st["categories"])
    label = LabelEncoding(meta["target"], meta["task"], meta["classes"])
    if meta["model_class"] == "linear":
        import numpy as np

        from tessera.plans.svr import LinearSVRModel
        model = LinearSVRModel(np.asarray(meta["coefficients"]), meta["intercept"], "features")
    elif meta["model_class"] == "knn":
        from tessera.operators.knn import KNNClassifierModel
        from tessera.session import shared_dir
        shared_dir(spark)  # its scoring checkpoints
        model = KNNClassifierModel(spark.read.parquet(os.path.join(path, "model")), *meta["knn"])
    elif meta["model_class"] == "softmax_boosting":
        from tessera.operators.boosting import SoftmaxBoostingModel
        model = SoftmaxBoostingModel.from_state(meta["boosting"])
    elif meta["model_class"] == "pairwise_svm":
        from tessera.operators.pairwise import PairwiseSVMModel
        model = PairwiseSVMModel(**meta["pairwise"])
    else:
        mod, cls = meta["model_class"].rsplit(".", 1)
        model = getattr(importlib.import_module(mod), cls).load(os.path.join(path, "model"))
        if meta.get("calibration"):
            from tessera.plans.training import PlattScaled
            model = PlattScaled(model, *meta["calibration"])
    feature_map = None
    if meta.get("feature_map"):
        from tessera.plans.training import FeatureMap
        feature_map = FeatureMap(**meta["feature_map"])
    return LoadedModel(model, prep, label, meta, feature_map)
