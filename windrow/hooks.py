"""Named points of a run where callers look at, or change, the tables that pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

POINTS = (
    "before_normalize", "after_normalize", "before_low_pass", "after_low_pass", "before_fingerprint", "after_fingerprint", "before_similarity",
    "after_similarity", "before_cluster", "after_cluster", "before_canonical", "after_canonical", "before_action", "after_action", "on_error",
)


class Hooks:
    """Callbacks by point, in the order they were added; one that returns a table replaces what passes on."""

    def __init__(self) -> None:
        self._held: dict[str, list[Callable]] = defaultdict(list)

    def add(self, point: str, call: Callable) -> None:
        if point not in POINTS:
            raise KeyError(point)
        self._held[point].append(call)

    def run(self, point: str, table: DataFrame) -> DataFrame:
        for call in self._held[point]:
            try:
                table = call(table) or table
            except Exception as error:
                for seen in self._held["on_error"]:
                    seen(point, error)
                if not self._held["on_error"]:
                    raise
        return table
