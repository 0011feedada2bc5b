"""All registered queries, with their SQL where there is one."""

from __future__ import annotations

from gridloom.plans import gridding, readback, reloading, starring, unpivoting, upkeep

MODULES = [unpivoting, starring, readback, gridding, upkeep, reloading]


def registered() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out
