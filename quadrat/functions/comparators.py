"""Comparators of images by name; applications register their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import imaging


@dataclass(frozen=True)
class Comparator:
    """prepare: noise pattern -> payload vector, once an image; block: (h, w, compat) -> block function of payloads."""

    prepare: Callable[[np.ndarray], np.ndarray]
    block: Callable[[int, int, bool], Callable]


COMPARATORS: dict[str, Comparator] = {}


def register(name: str, comparator: Comparator) -> None:
    if name in COMPARATORS:
        raise ValueError(f"there is a comparator {name} already")
    COMPARATORS[name] = comparator


register("ncc", Comparator(np.ravel, lambda h, w, compat: imaging.ncc_block))
register("pce", Comparator(imaging.packed_spectrum, lambda h, w, compat: imaging.pce_block(h, w, *(("last", "row") if compat else ("max", "hermitian")))))
