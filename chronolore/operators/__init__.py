"""Operators: frames in, frames out."""
