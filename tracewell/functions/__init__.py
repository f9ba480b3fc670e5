"""Scalar expressions over per-frame signals."""
