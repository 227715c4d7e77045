"""Structured Streaming over events, logs, heartbeats and leases.

The source's channels are in memory and lose what a slow reader misses.  Streams
here are checkpointed: nothing is lost, and deduplication makes events once-only.
"""

from .pipelines import *  # noqa: F401, F403
