"""Engine settings, passed to every operator that has a threshold."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Reproducibility and splitting.
    seed: int = 42
    test_size: float = 0.2
    val_size: float = 0.2
    cv_folds: int = 5

    # File and table admission.
    max_file_size_mb: int = 100
    allowed_extensions: tuple[str, ...] = (".csv", ".parquet", ".orc", ".json")
    min_rows: int = 10
    min_columns: int = 2
    max_null_ratio: float = 0.5

    # Task detection and feature routing.
    unique_ratio_threshold: float = 0.05
    max_unique_for_classification: int = 20
    one_hot_threshold: int = 15
    id_threshold: float = 0.95
    id_min_rows: int = 50

    # Models trained when the caller names none.
    default_classification_models: tuple[str, ...] = (
        "Logistic Regression", "Random Forest", "Gradient Boosting",
    )
    default_regression_models: tuple[str, ...] = (
        "Linear Regression", "Ridge", "Random Forest", "Gradient Boosting",
    )

    # Bounds that keep broadcasts and aggregation buffers small on any input.
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 * 1024 * 1024
    rank_bucket_rows: int = 100_000

    # Models (or folds) fitted at the same time.
    parallelism: int = 2

    # Preprocessing variants: "standard" or "centered" (frequency - 0.5).
    freq_scaling: str = "standard"
