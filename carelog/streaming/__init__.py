"""Row-level operators applied to Structured Streaming sources.

The study has no streaming step; its per-row classifiers are stateless, so
they run unchanged on a stream (``support_stream``).  Session building
stays a batch job over the sink, because its grouping is by stay over the
whole time axis.
"""

from carelog.streaming.support_stream import start_support_event_stream, support_event_stream

__all__ = ["support_event_stream", "start_support_event_stream"]
