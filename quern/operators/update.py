"""SPARQL Update over a quad table: each operation maps a table to a new one.

Nothing is changed in place: DELETE is a set difference and INSERT a union on the whole
quads (null-safe, so the default graph takes part), both of which shuffle once. Callers
decide when to write the result down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import terms as t
from quern.plans.compiler import Compiler
from quern.sources.quads import QuadSource, quads_of
from quern.sparql import ast as A


def changes(compiler: Compiler, op: A.Update) -> tuple[DataFrame, DataFrame]:
    """(deleted, inserted) quads of an operation on the compiler's source."""
    spark = compiler.spark
    if op.kind == "INSERT DATA":
        return quads_of(spark, []), quads_of(spark, list(op.insert))
    if op.kind == "DELETE DATA":
        return quads_of(spark, list(op.delete)), quads_of(spark, [])
    solutions = compiler.group(op.where) if op.with_ is None or op.using or op.using_named else compiler.group(op.where, op.with_)
    delete = compiler.instantiate(solutions, op.delete, op.with_)
    insert = compiler.instantiate(solutions, op.insert, op.with_)
    return delete, insert


def with_dataset(compiler: Compiler, op: A.Update) -> Compiler:
    if not op.using and not op.using_named:
        return compiler
    return Compiler(compiler.source.dataset([x.value for x in op.using], [x.value for x in op.using_named]), compiler.ctx, compiler.services)


def applied(quads: DataFrame, delete: DataFrame, insert: DataFrame) -> DataFrame:
    """Deletes first, then inserts."""
    return quads.select(*"spog").subtract(delete.select(*"spog")).union(insert.select(*"spog")).distinct()


def update(quads: DataFrame, op: A.Update | A.Manage, compiler: Compiler | None = None, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The quad table after one operation."""
    if isinstance(op, A.Manage):
        return managed(quads, op, load)
    compiler = compiler or Compiler(QuadSource(quads), _context())
    return applied(quads, *changes(with_dataset(compiler, op), op))


def _context():
    from quern.functions.registry import Context

    return Context()


def _in_graph(ref: object):
    if ref == "DEFAULT":
        return F.col("g").isNull()
    if ref == "NAMED":
        return F.col("g").isNotNull()
    if ref == "ALL":
        return F.lit(True)
    return F.coalesce(F.col("g")["lex"] == ref.value, F.lit(False))


def _moved(rows: DataFrame, target: object) -> DataFrame:
    g = F.lit(None).cast(t.TERM) if target == "DEFAULT" else t.to_term(t.constant(target)).cast(t.TERM)
    return rows.select("s", "p", "o", g.alias("g"))


def managed(quads: DataFrame, op: A.Manage, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """CLEAR, DROP, CREATE, ADD, MOVE, COPY and LOAD. Graphs without quads don't exist, so
    CREATE changes nothing and SILENT has nothing to silence but a failed LOAD."""
    quads = quads.select(*"spog")
    if op.kind == "CREATE":
        return quads
    if op.kind in ("CLEAR", "DROP"):
        return quads.where(~_in_graph(op.source))
    if op.kind == "LOAD":
        try:
            if load is None:
                raise ValueError("no reader is given for LOAD")
            rows = load(op.source.value).select(*"spog")
        except Exception:
            if op.silent:
                return quads
            raise
        return quads.union(rows if op.target == "DEFAULT" else _moved(rows, op.target)).distinct()
    if op.source == op.target:
        return quads
    rows = _moved(quads.where(_in_graph(op.source)), op.target)
    kept = quads
    if op.kind in ("MOVE", "COPY"):
        kept = kept.where(~_in_graph(op.target))
    if op.kind == "MOVE":
        kept = kept.where(~_in_graph(op.source))
    return kept.union(rows).distinct()


def run_sequential(quads: DataFrame, operations: list, make: Callable[[DataFrame], Compiler] | None = None, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """An update script in the classical reading: one operation after another."""
    for op in operations:
        if not isinstance(op, A.Query):
            quads = update(quads, op, make(quads) if make else None, load)
    return quads
