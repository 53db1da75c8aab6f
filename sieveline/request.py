"""What a search asks for."""

from __future__ import annotations

import math
from dataclasses import dataclass

DEFAULT_LIMIT, DEFAULT_CONTEXT = 100, 0
UNSET = "unset"


@dataclass(frozen=True)
class SearchRequest:
    pattern: str
    path: str | None = None
    glob: str | None = None
    ignore_case: bool = False
    literal: bool = False
    multiline: bool = False
    hidden: bool = False
    no_ignore: bool = False
    context: int = DEFAULT_CONTEXT
    before_context: int | None = None
    after_context: int | None = None
    limit: float | None | str = UNSET

    @property
    def before(self) -> int:
        return _count(self.before_context, self.context)

    @property
    def after(self) -> int:
        return _count(self.after_context, self.context)

    @property
    def line_limit(self) -> int | None:
        """None: all lines. Fractions go down, negative numbers to 0."""
        if self.limit is None:
            return None
        if self.limit == UNSET:
            return DEFAULT_LIMIT
        if not math.isfinite(self.limit):
            raise ValueError("limit must be finite")
        return max(0, math.floor(self.limit))


def _count(value, otherwise) -> int:
    value = otherwise if value is None or not math.isfinite(value) else value
    return max(0, math.floor(value))
