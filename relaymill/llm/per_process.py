"""Objects that a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: str, make: Callable[[], object]) -> object:
    """The object of this name in this process; made at the first call.

    Task code arrives anew with every task, so its own globals do not last.
    """
    name = "relaymill_kept_per_process"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
