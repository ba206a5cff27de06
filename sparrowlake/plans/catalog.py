"""All queries of the library's own operators."""

from __future__ import annotations

from sparrowlake.plans.registry import Registry

REGISTRY = Registry()

from sparrowlake.plans import q_extra, q_metrics, q_profile, q_runs, q_sampling, q_sources, q_streaming  # noqa: E402,F401
