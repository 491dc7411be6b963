"""The read-only SQL console: which statements may run.

A statement is parsed and every part of it looked at, subqueries, common tables
and what EXPLAIN explains included. It may run if all its plan nodes are on a fixed list of reading
ones, it calls only functions that come with Spark and do not reach into the
JVM, and it names only views and tables of the catalog: no script, no command, no file
path, no user function, no name made at run time. What is not known to read is
refused. Views are trusted: whoever registers one decides what it does.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

_CATALYST = "org.apache.spark.sql.catalyst."

# How a read-only statement may start.
READ_PREFIXES = ("select", "show", "explain", "with")

READING = frozenset(
    "Aggregate CTERelationDef CTERelationRef Distinct ExplainCommand Except Filter Generate GlobalLimit Intersect Join LateralJoin "
    "LocalLimit LocalRelation Offset OneRowRelation OneRowRelation$ Pivot Project RebalancePartitions Repartition "
    "RepartitionByExpression Sample Sort SubqueryAlias Tail Union UnionLoop UnionLoopRef UnresolvedHaving UnresolvedHint "
    "UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot "
    "Window WithWindowDefinition".split()
)
SHOWING = frozenset(
    "CurrentNamespace$ ResolvedNamespace ShowColumns ShowCurrentNamespaceCommand ShowFunctions ShowNamespaces ShowTables "
    "ShowViews UnresolvedNamespace UnresolvedTableOrView".split()
)
REACHING_OUT = frozenset({"reflect", "java_method", "try_reflect"})


def _parts(gateway, thing) -> Iterator[JavaObject]:
    """A tree and all trees inside it, whatever field or collection holds them."""
    todo = [thing]
    while todo:
        it = todo.pop()
        if not isinstance(it, JavaObject):
            continue
        if is_instance_of(gateway, it, _CATALYST + "trees.TreeNode"):
            yield it
        if is_instance_of(gateway, it, "scala.collection.Iterable"):
            inner = it.iterator()
        elif is_instance_of(gateway, it, "scala.Product"):
            inner = it.productIterator()
        else:
            continue
        while inner.hasNext():
            todo.append(inner.next())


def _strings(sequence) -> list[str]:
    return [sequence.apply(i) for i in range(sequence.size())]


def refusal(spark: SparkSession, text: str) -> str | None:
    """Why a statement may not run, or nothing if it only reads."""
    if not text.lower().startswith(READ_PREFIXES):
        return f"it does not start with one of {', '.join(READ_PREFIXES)}"
    gateway = spark.sparkContext._gateway
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        return f"it cannot be parsed: {error.getMessage()}"
    allowed = READING | SHOWING if text.lower().startswith("show") else READING
    named, common = [], set()
    for part in _parts(gateway, plan):
        kind = part.getClass().getSimpleName()
        if is_instance_of(gateway, part, _CATALYST + "plans.logical.LogicalPlan"):
            if kind not in allowed:
                return f"{kind} is not a reading step"
            if kind == "UnresolvedRelation":
                named.append(_strings(part.multipartIdentifier()))
            elif kind == "UnresolvedWith":
                relations = part.cteRelations()
                common |= {relations.apply(i)._1().lower() for i in range(relations.size())}
            call = _strings(part.name()) if kind == "UnresolvedTableValuedFunction" else None
        elif "UnresolvedIdentifier" in kind:
            return "names must be written out"
        elif kind == "UnresolvedFunction":
            call = _strings(part.nameParts())
        elif kind == "UnresolvedGenerator":
            call = [part.name().unquotedString()]
        else:
            continue
        if call and (len(call) > 1 or call[0].lower() in REACHING_OUT or not _known(spark, builtin, call[0], kind)):
            return f"{'.'.join(call)} is not a function it may call"
    for name in named:
        if len(name) == 1 and name[0].lower() in common:
            continue
        if not spark.catalog.tableExists(".".join("`" + part.replace("`", "``") + "`" for part in name)):
            return f"{'.'.join(name)} is not a view or table"
    return None


def _known(spark: SparkSession, builtin, name: str, kind: str) -> bool:
    analysis = spark._jvm.org.apache.spark.sql.catalyst
    plain = analysis.FunctionIdentifier(name.lower())
    if kind == "UnresolvedTableValuedFunction":
        return analysis.analysis.TableFunctionRegistry.functionSet().contains(plain)
    return builtin.contains(plain)
