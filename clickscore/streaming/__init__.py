"""Streaming.

The study has no streaming logic: every script is a full batch rebuild.  The
only streaming piece here is the base build itself applied to a stream of
events (a stream-static join against the broadcast respondents and
dimension), so new events can be appended to the base table as they land
instead of rebuilding it; no new operator is introduced.
"""

from clickscore.streaming.base_stream import stream_base_events, stream_events

__all__ = ["stream_base_events", "stream_events"]
