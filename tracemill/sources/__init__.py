from tracemill.sources.eventlog import EventLog
from tracemill.sources.files import detect_delimiter, read_csv, read_csv_table, read_traces

__all__ = ["EventLog", "detect_delimiter", "read_csv", "read_csv_table", "read_traces"]
