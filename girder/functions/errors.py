"""Errors that callers can act on."""


class RuleError(ValueError):
    """A rule document or one of its rules cannot be used."""


class SpecEvaluationError(RuntimeError):
    """A specification could not be evaluated."""


class StaleSnapshotError(RuntimeError):
    """A snapshot is damaged or of another format."""
