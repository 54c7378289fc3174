"""Line sources: batch text scans, streams of rolled files, a growing file, any text column."""

from loglark.sources.files import lines_from, read_logs, stream_logs
from loglark.sources.tail import TailSource, stream_tail

__all__ = ["TailSource", "lines_from", "read_logs", "stream_logs", "stream_tail"]
