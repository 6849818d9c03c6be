from tracemill.functions.rounding import fmt2, mean2, np2

__all__ = ["fmt2", "mean2", "np2"]
