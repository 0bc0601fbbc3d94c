"""Options of an all-pairs run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """strategy: "tile" compares blocks of items in vectorised Arrow functions,
    or, if there is only a column expression, joins them by tile; "theta"
    evaluates an expression over a theta join; "auto" takes theta for an expression
    and few items, otherwise tile.

    tile: items along the side of a tile; None sizes it by items and cores.
    include_diagonal: whether each item is also paired with itself.
    hilbert: schedule tiles along a Hilbert curve, so that neighbouring tasks
    share items. fail_fast: raise on the first failed comparison instead of
    returning its row with a null result and the error's text.
    """

    strategy: str = "auto"
    tile: int | None = None
    include_diagonal: bool = False
    hilbert: bool = False
    fail_fast: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in ("auto", "tile", "theta"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.tile is not None and self.tile < 1:
            raise ValueError("tile must be at least 1")
