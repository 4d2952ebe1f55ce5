"""Errors of validation; all are ValueError, so callers may catch either."""


class SequenceError(ValueError):
    """Input breaks a rule of the data model."""


class NoReads(SequenceError):
    """A selection holds no read with symbols."""
