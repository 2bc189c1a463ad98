"""Errors of model loading and prediction."""


class ModelError(Exception):
    """Base of all errors of this engine."""


class ModelIOError(ModelError):
    """The bytes end early, or the file cannot be read."""


class InvalidModelError(ModelError):
    """The bytes are no model of this format, or contradict themselves."""


class UnsupportedVersionError(ModelError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"format version {actual}; {expected} is needed")
        self.expected, self.actual = expected, actual


class EmptyInputError(ModelError):
    """A text yields no feature at all."""
