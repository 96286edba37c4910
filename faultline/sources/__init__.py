from faultline.sources.scratch import (
    clear_scratch,
    discard,
    lasting_path,
    scratch_path,
    scratch_scope,
    stored,
)
from faultline.sources.sinks import overwrite_table, schema_in_use
from faultline.sources.tables import read_table

__all__ = [
    "clear_scratch",
    "discard",
    "lasting_path",
    "overwrite_table",
    "read_table",
    "schema_in_use",
    "scratch_path",
    "scratch_scope",
    "stored",
]
