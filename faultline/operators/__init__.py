from faultline.operators.caching import cached
from faultline.operators.coding import code_rows, code_counts
from faultline.operators.dataset import build_dataset, join_target, model_rows
from faultline.operators.exact import exact_places, exact_sums
from faultline.operators.features import (
    batch_summary,
    feature_sizes,
    long_steps,
    rounded,
    sequences,
)
from faultline.operators.locations import attach_distance, with_distance
from faultline.operators.sequence import (
    add_batches,
    add_keyed_batches,
    add_row_index,
    batch_keys,
    check_unique,
    colocated_batches,
    drop_batches,
    full_batch_ids,
    full_batches,
)
from faultline.operators.splits import assign_split
from faultline.operators.sweep import (
    log_sweep,
    run_ids,
    sweep_grouped,
    sweep_mapped,
    sweep_streamed,
)
from faultline.operators.targets import class_counts, class_counts_pivoted, class_target

__all__ = [
    "add_batches",
    "add_keyed_batches",
    "add_row_index",
    "assign_split",
    "attach_distance",
    "batch_keys",
    "batch_summary",
    "build_dataset",
    "cached",
    "check_unique",
    "class_counts",
    "class_counts_pivoted",
    "class_target",
    "code_counts",
    "colocated_batches",
    "code_rows",
    "drop_batches",
    "exact_places",
    "exact_sums",
    "feature_sizes",
    "full_batch_ids",
    "full_batches",
    "join_target",
    "log_sweep",
    "long_steps",
    "model_rows",
    "rounded",
    "run_ids",
    "sequences",
    "sweep_grouped",
    "sweep_mapped",
    "sweep_streamed",
    "with_distance",
]
