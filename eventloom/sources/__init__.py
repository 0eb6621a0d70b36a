"""Readers and writers of detections, chunk clocks, logs, annotations, manifests and sampled signals."""
