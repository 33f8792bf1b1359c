"""The registered queries; the modules register theirs when this package is imported."""

from wayline.plans import board_queries, code_queries, model_queries, source_queries, stats_queries, stream_queries, summary_queries, trajectories  # noqa: F401
