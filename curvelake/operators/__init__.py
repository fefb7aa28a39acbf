"""Operators on signals, graphs, curvatures and long statistics tables: DataFrame in, DataFrame out.

Tables (columns beside these pass where an operator says so):
signal(run, channel, t, phase), nodes(graph_id, node, weight), edges(graph_id, u, v, weight) with u <= v,
curv(graph_id, u, v, curvature), long(dyad, condition, freq, trial, window, value).
"""
