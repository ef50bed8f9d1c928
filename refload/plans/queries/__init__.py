"""Every operator over the given tables, in one module per area."""

from importlib import import_module

AREAS = ["scans", "names", "formats", "loads", "versions", "schemas", "checks", "workflows", "reports", "streams"]


def load_all() -> None:
    """Import every area, which fills the catalogue."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
