"""The function library: every function on plain values, by name.

Modules register their functions when they are imported. Where Spark has an expression for a
function, plans.columns uses that instead for whole columns.
"""

from . import database, dates, engineering, finance, information, logic, lookup, mathematics, statistics, texts  # noqa: F401
from .registry import REGISTRY, Function, register_custom, unregister_custom

__all__ = ["REGISTRY", "Function", "register_custom", "unregister_custom"]
