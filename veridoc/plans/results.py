"""Verdicts added up over several judges: how many failed, and whether any of them had something to say."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class ValidationResult(NamedTuple):
    """match: whether a judge applied; errors: how many failed. Of Columns as of plain values."""

    match: bool | Column = False
    errors: int | Column = 0

    def _failed(self, valid: bool | Column) -> int | Column:
        return (~valid).cast("int") if isinstance(valid, Column) else int(not valid)

    def add_valid(self, valid: bool | Column = True) -> ValidationResult:
        """A verdict that says nothing of a match."""
        return self._replace(errors=self._failed(valid) + self.errors)

    def add_match(self, valid: bool | Column = True) -> ValidationResult:
        """A verdict of a judge that applied."""
        return ValidationResult(True, self._failed(valid) + self.errors)

    def add_result(self, other: ValidationResult) -> ValidationResult:
        match = self.match | other.match if isinstance(self.match, Column) or not isinstance(other.match, Column) else other.match | self.match
        return ValidationResult(match, other.errors + self.errors)

    def is_valid(self) -> bool | Column:
        return self.errors == 0

    def column(self) -> Column:
        """As a struct."""
        return F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(("match", "errors"), self, strict=True)))
