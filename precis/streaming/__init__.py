"""Structured Streaming versions of the preparation steps."""

from precis.streaming.streams import *  # noqa: F401,F403
