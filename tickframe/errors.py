"""Errors of the library; each keeps the facts that its message states."""

from __future__ import annotations


class TickframeError(Exception):
    """Base of all errors here."""

    def __init__(self, message: str, **facts):
        super().__init__(message)
        self.message = message
        self.facts = facts

    def __getattr__(self, name: str):
        try:
            return self.__dict__["facts"][name]
        except KeyError:
            raise AttributeError(name) from None


class InsufficientData(TickframeError):
    """A series has fewer rows than an indicator needs: required, provided."""


class InvalidParams(TickframeError):
    """A parameter is missing, of the wrong type or out of range: param, value, expected."""


class InvalidDataFormat(TickframeError):
    """Rows lack columns or hold impossible values: expected, received."""


class CalculationError(TickframeError):
    """A computation could not be carried out: operation, reason."""


class StreamStateError(TickframeError):
    """A streaming state does not belong to the indicator that got it: operation, reason."""


class ValidationError(TickframeError):
    """A check of values failed: field, value, constraint."""


def insufficient_data(required: int, provided: int) -> InsufficientData:
    return InsufficientData(f"Insufficient data: required {required}, got {provided}", required=required, provided=provided)
