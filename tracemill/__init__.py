"""Process mining on Spark DataFrames."""

from tracemill.errors import DelimiterError, MissingColumnError
from tracemill.operators.bands import frequency_bands
from tracemill.operators.follows import (
    ProcessModel,
    activity_frequency,
    base_model,
    directly_follows,
    end_activities,
    max_frequency,
    start_activities,
    vocabulary,
)
from tracemill.operators.graph import ProcessGraph, degrees, reachable, sink_nodes, source_nodes, summary
from tracemill.operators.ordering import ordered_events, traces
from tracemill.plans.fuzzy import FuzzyBase, FuzzyRun, correlation, fuzzy_graph, outgoing, significance
from tracemill.plans.heuristic import (
    dependencies,
    dependency_cells,
    dependency_edges,
    heuristic_graph,
    heuristic_sweep,
    terminal_edges,
    zero_cells,
)
from tracemill.plans.params import FuzzyParams, HeuristicParams
from tracemill.sinks import (
    fuzzy_dot,
    heuristic_dot,
    load_model,
    redraw,
    save_model,
    trace_lines,
    write_dot,
    write_traces,
)
from tracemill.sources import (
    EventLog,
    detect_delimiter,
    read_csv,
    read_csv_table,
    read_traces,
)

__all__ = [
    "DelimiterError",
    "EventLog",
    "FuzzyBase",
    "FuzzyParams",
    "FuzzyRun",
    "HeuristicParams",
    "MissingColumnError",
    "ProcessGraph",
    "ProcessModel",
    "activity_frequency",
    "base_model",
    "correlation",
    "degrees",
    "dependencies",
    "dependency_cells",
    "dependency_edges",
    "detect_delimiter",
    "directly_follows",
    "end_activities",
    "frequency_bands",
    "fuzzy_dot",
    "fuzzy_graph",
    "heuristic_dot",
    "heuristic_graph",
    "heuristic_sweep",
    "load_model",
    "max_frequency",
    "ordered_events",
    "reachable",
    "outgoing",
    "read_csv",
    "read_csv_table",
    "read_traces",
    "redraw",
    "save_model",
    "significance",
    "sink_nodes",
    "source_nodes",
    "start_activities",
    "summary",
    "trace_lines",
    "terminal_edges",
    "traces",
    "vocabulary",
    "write_dot",
    "write_traces",
    "zero_cells",
]
