"""Set-level and positional operators over detections, lines and words."""
