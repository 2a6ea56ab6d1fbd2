"""Pipelines: handlers before and after parsing, branches, and children that go through the whole pipeline again.

Handlers compile to expressions on one document row each; Catalyst joins neighbouring ones into few projections. A
row that is rejected stays in the plan with its status but no handler changes it, and the rows that need a parser or
another Python stage are the active ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, functions as F

from .. import model, stored
from ..functions.fields import put
from ..operators.base import Handler
from ..operators.conditions import Condition
from ..operators.filters import end_of_phase
from ..sources.detect import prepare
from ..sources.parsers import ParserFactory

Step = "Handler | If | Reject | Callable[[DataFrame], DataFrame]"
_numbers = count()


@dataclass
class Reject:
    """Rejects every row that reaches it."""


@dataclass
class If:
    """then where the condition holds, otherwise elsewhere. The condition is evaluated once, before either branch."""

    condition: Condition
    then: list = field(default_factory=list)
    otherwise: list = field(default_factory=list)
    negate: bool = False


def IfNot(condition: Condition, then: list, otherwise: list | None = None) -> If:
    return If(condition, then, otherwise or [], negate=True)


def run_steps(df: DataFrame, steps: list) -> DataFrame:
    for step in steps:
        if isinstance(step, Handler):
            df = step.apply(df)
        elif isinstance(step, Reject):
            df = df.withColumn("rejected_by", model.rejected(F.lit(True), "Reject"))
        elif isinstance(step, If):
            n = next(_numbers)
            yes, no = f"_then{n}", f"_else{n}"
            test = F.coalesce(step.condition.test(), F.lit(False))
            test = model.active() & (~test if step.negate else test)
            df = df.withColumn(yes, test).withColumn(no, model.active() & ~F.col(yes))
            for flag, inner in ((yes, step.then), (no, step.otherwise)):
                with model.branch(flag):
                    df = run_steps(df, inner)
            df = df.drop(yes, no)
        elif callable(step):
            df = step(df)
        else:
            raise TypeError(f"not a step of a flow: {step!r}")
    return df


@dataclass
class Pipeline:
    """pre handlers, parser, post handlers. Children go as deep as there are any; only on a stream, whose plan is made
    before its rows are seen, max_depth bounds them."""

    pre: list = field(default_factory=list)
    post: list = field(default_factory=list)
    parsers: ParserFactory | None = None
    max_depth: int = 5
    processors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    #: Told of "begin", of each "level" that is stored, with its depth, and of "end" (of planning, where nothing is stored).
    listeners: list[Callable[[str, int], None]] = field(default_factory=list)

    def one_pass(self, df: DataFrame) -> DataFrame:
        """All phases over one level of documents; children stay in their array."""
        df = prepare(df)
        df = end_of_phase(run_steps(df, self.pre))
        if self.parsers is not None:
            df = self.parsers.parse(df)
        return end_of_phase(run_steps(df, self.post))

    def splits(self) -> bool:
        def any_of(steps: list) -> bool:
            return any(getattr(s, "kind", "") == "splitter" or isinstance(s, If) and (any_of(s.then) or any_of(s.otherwise)) for s in steps)

        return any_of(self.pre) or any_of(self.post) or bool(self.parsers and self.parsers.splits())

    def run(self, df: DataFrame, written: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """All documents, children included, with depth and child_index, statuses in model.status().

        Where handlers or parsers make children, each level is stored (by `written`, else in the session's shared folder)
        and computed once, until a level has no children. On a stream levels are unrolled up to max_depth when the plan
        is built, and a document of the last level that has children gets an error. Children of rejected rows go on,
        those of rows with an error don't.
        """
        def tell(event: str, depth: int) -> None:
            for listener in self.listeners:
                listener(event, depth)

        tell("begin", 0)
        level, out, stream = df, None, df.isStreaming
        for depth in count():
            done = self.one_pass(level)
            if not self.splits():
                out = done.drop("children")
                break
            if not stream:
                done = (written or stored.written)(done)
                tell("level", depth)
            elif depth == self.max_depth:
                done = done.withColumn("error", F.coalesce("error", F.when(F.size("children") > 0, F.lit(f"children deeper than {depth} levels"))))
            flat = done.drop("children")
            out = flat if out is None else out.unionByName(flat)
            if stream and depth == self.max_depth or not stream and done.filter(F.col("error").isNull() & (F.size("children") > 0)).isEmpty():
                break
            level = children(done, depth + 1)
        assert out is not None
        for processor in self.processors:
            out = processor(out)
        tell("end", depth)
        return out


def children(df: DataFrame, depth: int) -> DataFrame:
    """The children of one level as documents of the next."""
    flat = df.filter(F.col("error").isNull()).select(F.col("reference").alias("_parent"), F.col("parent_refs").alias("_parents"), F.posexplode("children").alias("child_index", "c"))
    # the parent's own reserved fields are set anew for the child
    inherited = F.map_filter(F.col("c.metadata"), lambda k, _: ~k.isin(model.REFERENCE, model.CONTENT_TYPE, model.CONTENT_ENCODING, model.CONTENT_FAMILY))
    meta = put(put(inherited, model.EMBEDDED_INDEX, F.array(F.col("child_index").cast("string")), "replace"), model.EMBEDDED_PARENT, F.array("_parent"), "replace")
    start = {
        "reference": F.col("c.reference"),
        "parent_refs": F.concat("_parents", F.array("_parent")),
        "depth": F.lit(depth),
        "child_index": F.col("child_index"),
        "content_type": F.col("c.content_type"),
        "content_encoding": F.lit(None),
        "raw": F.col("c.raw"),
        "content": F.col("c.content"),
        "metadata": meta,
        "rejected_by": F.lit(None),
        "error": F.lit(None),
        "has_include": F.lit(False),
        "include_hit": F.lit(False),
        "children": F.array(),
    }
    return flat.select(*(start[name].cast(kind).alias(name) for name, (kind, _) in model.COLUMNS.items()))
