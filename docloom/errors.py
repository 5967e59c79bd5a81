"""Errors by role."""


class EngineError(Exception):
    """Anything that this engine raises on purpose."""


class ConfigError(EngineError):
    """A wrong or missing setting."""


class InvalidInput(EngineError, ValueError):
    """An argument or row that can't be worked on."""


class StepFailed(EngineError):
    """A step that broke off."""


class MissingResource(EngineError):
    """A file, provider or library that isn't there."""
