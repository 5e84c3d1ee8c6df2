"""Reports, key-value lines, keyed tables, messages and the console."""

from .messages import route_messages, stream_to_kafka, to_kafka, top_messages
from .reports import console_sample, console_stream, key_value_lines, report_best, report_flat, report_routes, report_sections, write_key_value
from .tables import append_rows, overwrite_rows, read_table, upsert_rows, versions

__all__ = ["append_rows", "console_sample", "console_stream", "key_value_lines", "overwrite_rows", "read_table", "report_best", "report_flat", "report_routes", "report_sections", "route_messages", "stream_to_kafka", "to_kafka", "top_messages", "upsert_rows", "versions", "write_key_value"]
