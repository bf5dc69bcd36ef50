"""Queries over the driver tables, each with the SQL it must agree with.

A module holds one family: ``QUERIES`` maps a name to a function of (spark, sf_dir), ``ORACLE``
the same name to SQL for DuckDB. Names without SQL are checked by tests on small inputs.
"""

from registry import chunking, completions, editor, evaluation, files, retrieval, streams, text, training, workflows

MODULES = (files, text, chunking, retrieval, training, evaluation, completions, editor, streams, workflows)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def unchecked_queries() -> dict:
    """Queries whose result SQL can't state; tests compare them with brute force."""
    return {name: fn for module in MODULES for name, fn in getattr(module, "UNCHECKED", {}).items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
