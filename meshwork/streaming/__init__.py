from .logs import (  # noqa: F401
    append_log, read_snapshot, start_alert_stream, start_usage_counts,
    usage_column_counts, usage_product_counts,
)
from .alerts import start_late_alert_stream  # noqa: F401
