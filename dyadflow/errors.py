"""Errors that stop a build."""


class PipelineError(ValueError):
    """Input or result breaks a rule that the panel relies on."""


class DecisionRequired(PipelineError):
    """A choice that the data cannot make: someone has to state it."""
