"""Errors that name what is wrong with a dataset or a request."""

from __future__ import annotations


class DatasetError(ValueError):
    """A dataset or request that cannot be analysed; ``code`` is machine readable."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
        self.message = message
