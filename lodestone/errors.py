"""Failures that a user can mend, with the process exit codes of the command line."""


class UsageError(Exception):
    """A wrong argument, setting or index state."""

    exit_code = 1


class EnvironmentFailure(Exception):
    """Something outside the engine is missing, locked or unreachable."""

    exit_code = 2
