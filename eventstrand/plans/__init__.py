"""The three flows: events to windows, windows to training tables, scores to reports."""
