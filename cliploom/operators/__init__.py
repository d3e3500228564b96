"""Operators on frame, clip and shard tables."""
