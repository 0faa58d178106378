"""Whole jobs made of operators: load the graph, ask it, the four tools, and checks of its tables."""
