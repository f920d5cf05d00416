"""Imports every query module so that the registry is complete."""

from flightspark.plans import align, atlas, bands, completion, depth, frames, jobs, planes, streams, surfaces, telemetry, texture, tracks, world  # noqa: F401
from flightspark.plans.registry import QUERIES, oracles  # noqa: F401
