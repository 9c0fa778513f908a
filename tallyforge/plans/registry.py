"""Imports every module that registers queries."""

from tallyforge.plans import findings, graphs, index, landings, reviews, scalars, sources, stats, streams, texts  # noqa: F401
