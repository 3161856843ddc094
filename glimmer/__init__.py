"""Spark jobs for single-molecule fluorescence analytics: frames, peaks, trajectories, states, events."""
