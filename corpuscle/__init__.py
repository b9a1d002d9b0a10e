"""Corpus token-cost analytics and training-data operators on Spark."""

from __future__ import annotations

import importlib

#: Names that are loaded when they are asked for.
_WHERE = {
    "Subword": "corpuscle.operators.tokenizers",
    "Augmented": "corpuscle.operators.augmented",
    "Decoder": "corpuscle.plans.model",
    "Plan": "corpuscle.plans.build",
    "build": "corpuscle.plans.build",
    "Router": "corpuscle.plans.router",
    "load": "corpuscle.plans.router",
    "read_pack": "corpuscle.sources.packs",
    "write_pack": "corpuscle.sources.packs",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(f"module corpuscle has no {name}")
    return getattr(importlib.import_module(_WHERE[name]), name)
