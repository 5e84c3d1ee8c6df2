"""Streaming twins of the batch questions."""

from .run import TWINS, batch_word_counts, lineitem_stream, run_twin, scratch

__all__ = ["TWINS", "batch_word_counts", "lineitem_stream", "run_twin", "scratch"]
