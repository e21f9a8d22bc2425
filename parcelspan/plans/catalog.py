"""Importing this module registers every query."""

from parcelspan.plans import contract, kpi, models, network, registers, storage, streams  # noqa: F401
