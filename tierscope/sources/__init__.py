from tierscope.sources.files import (  # noqa: F401
    coerce_tf_columns, normalize_missing, read_json_report,
    read_listings_csv, read_scoring_requests, read_snapshot, require_columns,
    write_csv, write_json_report, write_snapshot,
)
from tierscope.sources.tables import listings_raw, read_table  # noqa: F401
