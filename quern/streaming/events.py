"""Event mode: every block of input is matched against the stored quads and then forgotten.

Blocks don't see each other, so they needn't be processed one after another: all are matched
in one job in which each pattern is looked up in the blocks and in the stored quads, and
solutions are joined on the block as well. A stored quad belongs to every block, which is
what an unbound block variable says to a compatibility join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import terms as t
from quern.functions.registry import Context
from quern.plans.compiler import Compiler
from quern.plans.relation import Relation, VarType
from quern.sources.quads import QuadSource
from quern.sparql import ast as A

BLOCK = "_:block"


class EventSource(QuadSource):
    """Stored quads and blocks (quads with ``block_id``)."""

    extra = {BLOCK: ("block_id", VarType("integer", nullable=True))}

    def __init__(self, blocks: DataFrame, stored: DataFrame):
        quads = stored.select(*"spog", F.lit(None).cast("bigint").alias("block_id"))
        super().__init__(blocks.select(*"spog", F.col("block_id").cast("bigint").alias("block_id")).unionByName(quads))

    def dataset(self, default: list[str], named: list[str]) -> EventSource:
        if default or named:
            raise ValueError("event mode has no FROM")
        return self


def event_matches(blocks: DataFrame, stored: DataFrame, query: A.Query, ctx: Context | None = None) -> DataFrame:
    """Solutions of a SELECT's pattern with the ``block_id`` that each is found in."""
    compiler = Compiler(EventSource(blocks, stored), ctx or Context())
    r: Relation = compiler.solutions(query)
    names = [x[1].name if isinstance(x, tuple) else x.name for x in query.projection] if query.projection is not None else [n for n in r.vars if not n.startswith("_:")]
    r = r.where(~r.is_null(BLOCK))
    found = r.df.select(F.col(f"`v_{BLOCK}`").alias("block_id"), *(t.to_term(r.val(n)).alias(n) for n in names))
    return found.distinct() if query.distinct else found
