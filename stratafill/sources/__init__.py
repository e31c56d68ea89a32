from stratafill.sources.publishing import (
    has_rows, publish, publish_version, replace_partitions, settings,
)
from stratafill.sources.staging import (
    drop_shuffles, new_path, preview, release, remove, shared_dir, stage, stage_counted,
    staged_since,
)
from stratafill.sources.tables import SCHEMAS, Tables, load

__all__ = ["SCHEMAS", "Tables", "drop_shuffles", "has_rows", "load", "new_path", "preview",
           "publish", "publish_version", "release", "remove", "replace_partitions", "settings",
           "shared_dir", "stage", "stage_counted", "staged_since"]
