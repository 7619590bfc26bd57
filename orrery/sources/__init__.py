"""Edge lists, point files, named datasets, and the graph of the trade tables."""
