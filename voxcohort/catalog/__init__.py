"""Every operator as a query over the given tables, with the same result as SQL where SQL can express it."""

import importlib
import pkgutil

from voxcohort.catalog import registry


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.SQL)
