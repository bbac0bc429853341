"""A fluent builder of operator graphs over named streams.

A graph is checked before it is planned: names, one writer for each stream, no cycles, no retractions
into operators that refuse them. Running it composes data frames; Spark sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import key_group
from ..operators import changelog, filters, joins, process, ranking, windows
from ..operators.admission import operator_frontier
from ..schema import StreamPolicy, weight

#: What a change has beside its value.
FORWARDED = frozenset("key event_time sequence kind diff".split())
RETRACTS = {"normalize", "top_n", "window", "process"}
COLLECTIONS = {"normalize", "top_n"}


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    inputs: tuple[str, ...]
    options: tuple[tuple[str, object], ...]
    run: Callable = field(compare=False, repr=False, default=None)


def forward(changes: DataFrame, operator: str, *, stream: str, value: list[str], key: str = "key", partitions: int = 1) -> DataFrame:
    """An operator's changes as records of a stream: kinds stay, ids are stable, equal keys share a
    partition (a null key has partition 0), and no late policy applies."""
    where = key_group(F.col(key), partitions).cast("int") if partitions > 1 else F.lit(0)
    return changes.select(
        F.lit(stream).alias("stream"), where.alias("partition"), "sequence", "event_time", F.col(key).cast("string").alias("key"), F.struct(*value).alias("value"), "kind",
        F.concat_ws(":", F.lit("operator"), F.lit(operator), F.col("sequence").cast("string"), "kind").alias("event_id"),
    )


class Graph:
    """Streams and operators; each operator's output is a stream of the operator's name."""

    def __init__(self, name: str):
        if not name.strip():
            raise ValueError("a graph has a name")
        self.name = name
        self.streams: dict[str, StreamPolicy] = {}
        self.nodes: dict[str, Node] = {}

    def stream(self, name: str, policy: StreamPolicy | None = None) -> Graph:
        if name in self.streams or name in self.nodes:
            raise ValueError(f"{name} exists")
        self.streams[name] = policy or StreamPolicy()
        return self

    def _add(self, name: str, kind: str, inputs: tuple[str, ...], run: Callable, **options) -> Graph:
        if not name.strip():
            raise ValueError("an operator has a name")
        node = Node(name, kind, inputs, tuple(sorted(options.items(), key=lambda x: x[0])), run)
        if name in self.nodes and self.nodes[name] == node:
            return self  # registering the same operator again changes nothing
        if name in self.nodes or name in self.streams:
            raise ValueError(f"{name} exists with another meaning")
        self.nodes[name] = node
        return self

    def filter(self, name: str, source: str, path: str, comparison: str, operand) -> Graph:
        return self._add(name, "filter", (source,), lambda d: filters.filter_records(d, path, comparison, operand), path=path, comparison=comparison, operand=operand)

    def window(self, name: str, source: str, spec: windows.WindowSpec, aggregation: str, path: str | None = None) -> Graph:
        value = F.col(f"value.{path}") if path else None
        return self._add(name, "window", (source,), lambda d: windows.aggregate(d, spec, aggregation, value), spec=spec, aggregation=aggregation, path=path)

    def deduplicate(self, name: str, source: str) -> Graph:
        return self._add(name, "deduplicate", (source,), ranking.deduplicate)

    def temporal_join(self, name: str, probes: str, versions: str, how: str = "inner") -> Graph:
        return self._add(name, "temporal_join", (probes, versions), lambda p, v: joins.as_of(p, v, how=how), how=how)

    def interval_join(self, name: str, left: str, right: str, bounds: joins.Interval) -> Graph:
        run = (lambda l, r=None: joins.interval_self(l, bounds)) if left == right else (lambda l, r: joins.interval(l, r, bounds))  # noqa: E741
        if left == right and bounds.lower < 0:
            raise ValueError("a self-join looks forward")
        return self._add(name, "interval_join", (left, right), run, bounds=bounds)

    def normalize(self, name: str, source: str, primary_key: list[str], payload: list[str], mode: str = "upsert") -> Graph:
        return self._add(name, "normalize", (source,), lambda d: changelog.normalize(d, primary_key, payload, mode=mode), primary_key=tuple(primary_key), payload=tuple(payload), mode=mode)

    def top_n(self, name: str, source: str, order_by: list[tuple[str, str]], n: int, *, partition_by: tuple[str, ...] = (), ties: tuple[str, ...] = ("sequence",), mode: str = "retract", identity: tuple[str, ...] = ()) -> Graph:
        def run(rows):
            if identity:
                rows = changelog.fold(rows if "diff" in rows.columns else rows.withColumn("diff", weight()), list(identity))
                return ranking.top_n(rows, order_by, n, partition_by=list(partition_by), ties=list(ties), count="count")
            return ranking.top_n(rows, order_by, n, partition_by=list(partition_by), ties=list(ties))

        return self._add(name, "top_n", (source,), run, order_by=tuple(order_by), n=n, partition_by=partition_by, ties=ties, mode=mode, identity=identity)

    def process(self, name: str, source: str, definition: process.Process) -> Graph:
        return self._add(name, "process", (source,), lambda d: process.fold(d, definition), definition=definition.name, version=definition.version)

    def connect(self, operator: str, stream: str, *, key: str = "key", value: tuple[str, ...] = ()) -> Graph:
        """Forward an operator's changes to a declared stream. The stream's progress is the operator's,
        so it is source-managed, and it takes changes from one operator alone."""
        if any(n.kind == "forward" and n.name == stream for n in self.nodes.values()):
            raise ValueError(f"{stream} has an upstream")
        if stream in self.nodes:
            raise ValueError(f"{stream} is an operator")
        if stream not in self.streams:
            raise ValueError(f"{stream} is not declared")
        if self.streams[stream].watermark != "source_managed":
            raise ValueError(f"{stream} takes its progress from {operator} and needs to be source_managed")
        policy = self.streams[stream]
        run = lambda d: forward(d, operator, stream=stream, value=list(value) or [c for c in d.columns if c not in FORWARDED], key=key, partitions=policy.partitions)
        self.nodes[stream] = Node(stream, "forward", (operator,), (("key", key), ("value", value)), run)
        return self

    def map(self, name: str, source: str, function: Callable[[DataFrame], DataFrame]) -> Graph:
        """Any function of a data frame, for projections and for shaping an output into records."""
        return self._add(name, "map", (source,), function, function=getattr(function, "__name__", "function"))

    def order(self) -> list[Node]:
        """Operators after those that they read; a cycle is an error."""
        done: dict[str, int] = {}
        out: list[Node] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in self.streams and name not in self.nodes:
                return
            if name not in self.nodes:
                raise ValueError(f"{above[-1]} reads {name}, which nothing writes")
            if name in above:
                raise ValueError("a cycle: " + " -> ".join([*above[above.index(name) :], name]))
            if name in done:
                return
            for i in self.nodes[name].inputs:
                visit(i, (*above, name))
            done[name] = len(out)
            out.append(self.nodes[name])

        for name in sorted(self.nodes):
            visit(name, ())
        return out

    def retracting(self) -> set[str]:
        """Outputs that may hold retractions, through filters, maps and joins too."""
        found: set[str] = set()
        for node in self.order():
            if node.kind in RETRACTS or any(i in found for i in node.inputs):
                found.add(node.name)
        return found

    def validate(self) -> Graph:
        found = self.retracting()
        for node in self.order():
            options = dict(node.options)
            for i in node.inputs:
                if node.kind == "deduplicate" and i in found:
                    raise ValueError(f"{node.name} takes no retractions, which {i} may give")
                if node.kind in COLLECTIONS and i in self.nodes and self.nodes[i].kind in RETRACTS | {"forward"} and options["mode"] != "retract":
                    raise ValueError(f"{node.name} reads the changes of {i} and needs retract mode")
                if i in self.streams and self.streams[i].late_policy == "accept" and node.kind in ("window", "deduplicate", "temporal_join", "interval_join"):
                    raise ValueError(f"{node.name} does not take {i}, which accepts records of any lateness")
        return self

    def explain(self) -> str:
        """A stable text of streams and operators in the order in which they run."""
        lines = [f"graph {self.name}"]
        for name in sorted(self.streams):
            p = self.streams[name]
            lines.append(f"  stream {name}: {p.watermark} watermark, {p.partitions} partition(s), disorder {p.disorder:g} s, lateness {p.lateness:g} s, late: {p.late_policy}")
        for node in self.order():
            options = ", ".join(f"{k}={v}" for k, v in node.options if v not in (None, ()))
            lines.append(f"  {node.kind} {node.name} <- {', '.join(node.inputs)}" + (f" [{options}]" if options else ""))
        return "\n".join(lines)

    def run(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Lazy outputs of all operators and forwarded streams, by name."""
        self.validate()
        missing = sorted(set(self.streams) - set(sources) - set(self.nodes))
        if missing:
            raise ValueError(f"no data for {', '.join(missing)}")
        made = dict(sources)
        for node in self.order():
            made[node.name] = node.run(*[made[i] for i in node.inputs])
        return {n: made[n] for n in self.nodes}

    def backfill(self, name: str, sources: dict[str, DataFrame]) -> DataFrame:
        """The output of one operator over what its sources have retained, as if it had been registered
        before they began; only what stands upstream of it is composed."""
        self.validate()
        made = dict(sources)
        needed = {name}
        for node in reversed(self.order()):
            if node.name in needed:
                needed |= set(node.inputs)
        for node in self.order():
            if node.name in needed:
                made[node.name] = node.run(*[made[i] for i in node.inputs])
        return made[name]

    def frontiers(self, streams: dict[str, float | None], *, pending: tuple[str, ...] = ()) -> dict[str, float | None]:
        """Through which time (seconds) the output of every operator is complete, from the frontiers of
        the streams that sources write to (none if unknown, infinite if sealed). A forwarded stream's
        partitions advance to its operator's frontier, less its own lateness, and end with it."""
        known = {n: streams.get(n) for n in self.streams}
        for node in self.order():
            found = operator_frontier(node.kind, [known[i] for i in node.inputs], pending=node.name in pending)
            if node.kind == "forward" and found is not None:
                found -= self.streams[node.name].lateness
            known[node.name] = found
        return known
