"""All registered queries: name -> (Spark callable, SQL for the same result)."""

from importlib import import_module

ENTRIES: dict = {}
for _name in ("series", "walk", "market", "text", "files", "evidence"):
    ENTRIES.update(import_module(f"barloom.catalogue.{_name}").QUERIES)

ENTRY_QUERY = "information_coefficient"
