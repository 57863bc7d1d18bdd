"""Call budgets of tools: which actions of a sample may still run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import running_sum

# fixed values: calls allowed per sample
TOOL_BUDGETS = {"inspect_image": 1, "match_domain_skill": 1, "local_retrieve": 1, "web_search": 3, "web_read": 1}


def guard(log: DataFrame, keys: list[str], step: str, bucket: Column, budgets: dict[str, int] = TOOL_BUDGETS) -> DataFrame:
    """Adds ``executed``: the action is within the budget of its tool.

    The running count is taken inside buckets of steps and linked, so a sample
    with very many steps is not counted by one task.
    """
    allowed = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    counted = running_sum(log.withColumn("_one", F.lit(1)), [*keys, "tool_name"], [step], bucket, "_one", "_nth")
    limit = F.element_at(allowed, F.col("tool_name"))
    return counted.withColumn("executed", limit.isNull() | (F.col("_nth") <= limit)).drop("_one", "_nth")


class LoopBudget(StatefulProcessor):
    """Per sample: calls of each tool so far, and when the sample began.  A timer closes a sample whose time is up."""

    def __init__(self, tool: str, step: str, at: str, budgets: dict[str, int], seconds: float, names: list[str]):
        self.tool, self.step, self.at, self.budgets, self.seconds, self.names = tool, step, at, budgets, seconds, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "tool string", "n long")
        self.began = handle.getValueState("began", "at timestamp")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            part = part.sort_values(self.step, kind="stable")
            outcomes = []
            for tool, at in zip(part[self.tool], part[self.at], strict=True):
                if not self.began.exists():
                    self.began.update((at.to_pydatetime(),))
                    if self.seconds:
                        self.handle.registerTimer(int(at.timestamp() * 1000 + self.seconds * 1000))
                late = self.seconds and (at.to_pydatetime() - self.began.get()[0]).total_seconds() >= self.seconds
                limit = self.budgets.get(tool)
                if self.closed.exists() or late:
                    outcomes.append("out_of_time")
                    continue
                used = self.calls.getValue((tool,))[0] if self.calls.containsKey((tool,)) else 0
                self.calls.updateValue((tool,), (used + 1,))
                outcomes.append("executed" if limit is None or used < limit else "over_budget")
            yield part[self.names].assign(outcome=outcomes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the sample's time is up: its counts are not needed any more, only that it is closed
        self.calls.clear()
        self.closed.update((True,))
        yield from ()

    def close(self) -> None:
        pass


def guard_stream(log: DataFrame, sample: str, step: str, at: str, tool: str = "tool_name", budgets: dict[str, int] = TOOL_BUDGETS,
                 seconds: float = 0.0, delay: str = "0 seconds") -> DataFrame:
    """A stream of actions with ``outcome``: executed, over_budget (of its tool) or out_of_time (``seconds`` after the sample's first action; 0: no limit).

    Counts are keyed state, so they go on over batches and restarts.  Actions of a sample are taken in ``step`` order inside a batch; batches
    must come in order.  Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    names = log.columns
    schema = T.StructType([*log.schema.fields, T.StructField("outcome", T.StringType())])
    keyed = log.withWatermark(at, delay).groupBy(sample)
    processor = LoopBudget(tool, step, at, budgets, seconds, names)
    return keyed.transformWithStateInPandas(processor, schema, "Append", "EventTime" if seconds else "None")
