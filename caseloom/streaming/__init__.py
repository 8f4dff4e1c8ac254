"""Structured Streaming forms of the audit jobs."""

from caseloom.streaming.lockout import lockout_stream, lockout_stream_counts, lockout_stream_final, start_lockout_stream

__all__ = ["lockout_stream", "lockout_stream_counts", "lockout_stream_final", "start_lockout_stream"]
