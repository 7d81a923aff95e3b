"""Imports every query module so that the registry is complete."""

from __future__ import annotations


def load() -> None:
    from revledger.plans import ledger_queries  # noqa: F401
    from revledger.plans import graph_queries  # noqa: F401
    from revledger.plans import grant_queries  # noqa: F401
    from revledger.plans import routing_queries  # noqa: F401
    from revledger.plans import check_queries  # noqa: F401
    from revledger.plans import script_queries  # noqa: F401
    from revledger.plans import layout_queries  # noqa: F401
    from revledger.plans import stream_queries  # noqa: F401
