from faultline.learning.epochs import Epochs, fit_epochs
from faultline.learning.model import (
    FLATTENED,
    confusion_counts,
    evaluate,
    fault_pipeline,
    fit,
    flattened_frame,
    score,
    signature,
    training_frame,
)
from faultline.learning.registry import (
    latest_model_path,
    latest_models,
    load_latest,
    read_models,
    read_signature,
    save_version,
)
from faultline.learning.regression import (
    distance_frame,
    distance_pipeline,
    predict_distance,
    regression_metrics,
)

__all__ = [
    "FLATTENED",
    "Epochs",
    "confusion_counts",
    "distance_frame",
    "distance_pipeline",
    "evaluate",
    "fault_pipeline",
    "fit",
    "fit_epochs",
    "flattened_frame",
    "latest_model_path",
    "latest_models",
    "load_latest",
    "predict_distance",
    "read_models",
    "read_signature",
    "regression_metrics",
    "save_version",
    "score",
    "signature",
    "training_frame",
]
