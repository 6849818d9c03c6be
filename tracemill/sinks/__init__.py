from tracemill.sinks.models import load_model, redraw, save_model
from tracemill.sinks.text import (
    fuzzy_dot,
    heuristic_dot,
    trace_lines,
    write_dot,
    write_traces,
)

__all__ = [
    "fuzzy_dot",
    "heuristic_dot",
    "load_model",
    "redraw",
    "save_model",
    "trace_lines",
    "write_dot",
    "write_traces",
]
