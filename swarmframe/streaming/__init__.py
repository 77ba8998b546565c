"""Structured Streaming operators."""

from swarmframe.streaming.sinks import decoded_stream, stream_decode, write_sets
from swarmframe.streaming.stats import stream_dropped, stream_sessions, stream_stats
from swarmframe.streaming.sync import stream_counts, stream_dedup, stream_late, stream_payloads, stream_sets, stream_sync, stream_tick_max

__all__ = [
    "decoded_stream", "stream_counts", "stream_decode", "stream_dedup", "stream_dropped", "stream_late", "stream_payloads", "stream_sessions",
    "stream_sets", "stream_stats", "stream_sync", "stream_tick_max", "write_sets",
]
