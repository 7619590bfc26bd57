"""Nothing here: the workloads are synchronous supersteps over a whole graph, without streams, watermarks or late data."""
