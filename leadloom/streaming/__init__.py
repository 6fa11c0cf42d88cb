"""The same operators on Structured Streaming sources."""

from leadloom.streaming.levels import Levels
from leadloom.streaming.streams import (
    arrived,
    current_best,
    current_drops,
    current_state,
    kept_jobs,
    read_arrivals,
    read_drop_folder,
    stream_best_contact,
    stream_clean,
    stream_drops,
    stream_feeds,
    stream_job_retention,
    stream_job_state,
)

__all__ = [
    "Levels", "arrived", "current_best", "current_drops", "current_state", "kept_jobs", "read_arrivals",
    "read_drop_folder", "stream_best_contact", "stream_clean", "stream_drops", "stream_feeds",
    "stream_job_retention", "stream_job_state",
]
