"""Errors raised before any Spark job starts."""


class MissingColumnError(ValueError):
    """A role column named by the caller is not in the table."""


class DelimiterError(ValueError):
    """The field separator of a text log could not be recognised."""
