"""Result of a batch write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from rollcall.model import Model

#: A model brought up to date, and the rows of members and roster that are new or other than before.
Settled = tuple[Model, dict[str, DataFrame]]


@dataclass(frozen=True)
class Outcome:
    """`changed` has the written tables; `model` also has levels and roster brought up to date; `rejected` are the requests that
    were turned away, with their reason.

    What a store needs to write no more than the difference: `touched` has, for tables stored by session or bucket, those whose rows
    may differ from before, and `rows` the rows of these; `removed` has the keys of rows that are gone, by table; `settle_rows` is
    `settle` by rows, where the model keeps a standing.
    """

    changed: Model
    rejected: DataFrame
    settle: Callable[[Model], Model] = lambda model: model
    touched: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, DataFrame] = field(default_factory=dict)
    removed: dict[str, DataFrame] = field(default_factory=dict)
    settle_rows: Callable[[Model], Settled] | None = None

    @cached_property
    def model(self) -> Model:
        return self.settle_rows(self.changed)[0] if self.settle_rows else self.settle(self.changed)
