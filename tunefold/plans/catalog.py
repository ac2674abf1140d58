"""All registered queries and their SQL."""
from __future__ import annotations

import importlib
import pkgutil

from .registry import QUERIES, ORACLES, compose


def _load() -> None:
    import tunefold.plans as pkg
    for m in sorted(x.name for x in pkgutil.iter_modules(pkg.__path__) if x.name.startswith("q_")):
        importlib.import_module(f"tunefold.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: compose(v) for k, v in ORACLES.items()}
