"""Every query by name, and the SQL of those that SQL can express."""

from importlib import import_module

MODULES = ("relations", "choices", "records", "sequences", "events")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"spanloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"spanloom.plans.{m}").SQL.items()}
