"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op9", "op10", "op3", "op5", "op7", "op4", "op2", "op1", "op6", "op8")
QUERIES, ORACLE_SQL = {}, {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
