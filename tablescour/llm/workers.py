"""Objects that a Python worker process keeps from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

_HOME = "_tablescour_kept"


def kept(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` gave when this process first asked for ``key``.

    Functions travel to workers by value, so their modules' globals begin anew with each
    task; a module registered by name stays.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME))
    if key not in home.__dict__.setdefault("objects", {}):
        home.objects[key] = build()
    return home.objects[key]
