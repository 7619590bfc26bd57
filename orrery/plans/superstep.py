"""The superstep loop, and the engine that runs a program by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, partitioned
from ..graph import Graph
from ..operators.programs import PROGRAMS, VertexProgram
from ..schema import Mode

#: Supersteps between checkpoints: plans stay short, and few intermediate states are written.
EVERY = 4


def started(graph: Graph, program: VertexProgram) -> DataFrame:
    """Vertices with the program's state columns."""
    return graph.vertices.select("*", *[make().alias(c) for c, make in program.state.items()])


def messages(edges: DataFrame, state: DataFrame, program: VertexProgram, backward: bool) -> DataFrame:
    """(id, value): the sum of what each vertex gets.  Sums combine before the shuffle, so a hub costs one row per task."""
    sender, receiver = ("dst", "src") if backward else ("src", "dst")
    value = (program.backward if backward else program.forward)()
    sent = edges.join(state, F.col(sender) == F.col("id")).select(F.col(receiver).alias("to"), value.alias("value"))
    return sent.groupBy("to").agg(F.sum("value").alias("value"))


def laid_out(graph: Graph, program: VertexProgram) -> dict[str, DataFrame]:
    """The edges, written once for each direction in use, partitioned by the sender: supersteps move state and messages, never edges."""
    n = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [end for end, make in (("src", program.forward), ("dst", program.backward)) if make]
    edges = checkpointed(graph.with_degrees())
    return {end: partitioned(edges, n, end) for end in ends}


def superstep(edges: dict[str, DataFrame], state: DataFrame, program: VertexProgram) -> DataFrame:
    out = state
    for name, make, sender in (("_f", program.forward, "src"), ("_b", program.backward, "dst")):
        if make:
            got = messages(edges[sender], state, program, name == "_b").withColumnsRenamed({"to": "_to" + name, "value": name})
            out = out.join(got, F.col("id") == F.col("_to" + name), "left").drop("_to" + name).withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out.withColumns(program.apply()).drop("_f", "_b")


def run_program(graph: Graph, program: VertexProgram, iterations: int, every: int = EVERY, tolerance: float | None = None, normalize: bool = False) -> DataFrame:
    """State after the supersteps.

    ``tolerance`` ends the loop once no change is larger (one small aggregate a
    step); ``normalize`` scales authority and hub to unit length each step.
    """
    edges, state = laid_out(graph, program), started(graph, program)
    for step in range(1, iterations + 1):
        state = superstep(edges, state, program)
        if normalize:
            state = normalized(state, [c for c in ("authority", "hub") if c in state.columns])
        if step % every == 0 and step < iterations or tolerance is not None:
            state = checkpointed(state)
        if tolerance is not None and not state.where(" or ".join(f"not ({c} <= {tolerance})" for c in state.columns if c.startswith("last_change"))).limit(1).count():
            break
    return state


def normalized(state: DataFrame, columns: list[str]) -> DataFrame:
    norms = state.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns]).first()
    return state.withColumns({c: F.col(c) / F.lit(norms[c] or 1.0) for c in columns})


@dataclass(frozen=True)
class GraphEngine:
    """Runs an algorithm by name; unknown names and modes are errors."""

    spark: SparkSession
    mode: Mode = Mode.SYNCHRONOUS

    def run(self, graph: Graph, algorithm: str, iterations: int = 10, method: str = "pregel", privacy=None, **options) -> DataFrame:
        from .private import private_pagerank

        if self.mode != Mode.SYNCHRONOUS:
            raise ValueError("only synchronous supersteps are implemented")
        if algorithm not in PROGRAMS:
            raise ValueError(f"unknown algorithm {algorithm!r}; known are {', '.join(PROGRAMS)}")
        if method == "pregel":
            return run_program(graph, PROGRAMS[algorithm](), iterations, **options)
        if method == "private":
            if algorithm != "pagerank":
                raise ValueError("the private method is implemented for pagerank")
            return private_pagerank(graph, privacy, iterations, **options)
        raise ValueError(f"unknown method {method!r}; known are pregel, private")
