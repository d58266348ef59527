"""Syntax facts of Python sources: the one step that leaves the JVM.

Spark has no parser for Python, so an Arrow function runs the standard parser on a batch of texts and returns,
per text, the nodes the rules speak about with their place in the tree. It takes no decision: which node is a
finding is decided by column expressions (:mod:`python_rules`). The text itself is not sent back.

``pre`` numbers the reported nodes from the root down, ``parent_pre`` is the nearest reported node above, and ``post``
is the last number below a node, so A encloses B when ``A.pre < B.pre AND B.pre <= A.post``. Columns are UTF-8 byte offsets as the parser gives them.
"""

from __future__ import annotations

import ast
import gc
import sys
import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The few functions below travel with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIELDS = (
    ("pre", "int", pa.int32()),
    ("post", "int", pa.int32()),
    ("parent_pre", "int", pa.int32()),
    ("kind", "string", pa.string()),
    ("field", "string", pa.string()),
    ("line", "int", pa.int32()),
    ("col", "int", pa.int32()),
    ("loop_depth", "int", pa.int32()),
    ("async_scope", "boolean", pa.bool_()),
    ("call_root", "string", pa.string()),
    ("call_attr", "string", pa.string()),
    ("func_is_name", "boolean", pa.bool_()),
    ("name", "string", pa.string()),
    ("const_true", "boolean", pa.bool_()),
    ("is_add", "boolean", pa.bool_()),
    ("string_like", "boolean", pa.bool_()),
    ("arg0_kind", "string", pa.string()),
    ("in_literal_seq", "boolean", pa.bool_()),
    ("decorators", "array<string>", pa.list_(pa.string())),
    ("sleeps_below", "int", pa.int32()),
    ("self_calls", "int", pa.int32()),
)
FIELDS = tuple(name for name, _, _ in _FIELDS)

_LOOPS = {ast.For, ast.AsyncFor, ast.While}
_FUNCTIONS = {ast.FunctionDef, ast.AsyncFunctionDef}
_REPORTED = _LOOPS | _FUNCTIONS | {ast.Call, ast.Compare, ast.AugAssign}
KINDS = tuple(sorted(kind.__name__ for kind in _REPORTED))
# Nodes with nothing to report below them, and fields that hold no nodes worth entering.
_LEAVES = {
    ast.Name, ast.Constant, ast.alias, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.Pass, ast.Break,
    ast.Continue, str, int, bool,
}
_PLAIN_FIELDS = {
    "id", "ctx", "op", "ops", "attr", "name", "arg", "type_comment", "conversion", "is_async", "simple", "rest",
    "kwd_attrs", "type_ignores",
}


def _last_name(node):
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else ""


def _is_text(node):
    pending = [node]
    while pending:
        part = pending.pop()
        if isinstance(part, ast.JoinedStr) or (isinstance(part, ast.Constant) and isinstance(part.value, str)):
            return True
        if isinstance(part, ast.BinOp) and isinstance(part.op, ast.Add):
            pending += (part.left, part.right)
    return False


def _describe(node):
    """The facts of one node that depend on the node alone."""
    if isinstance(node, ast.Call):
        callee = node.func
        return {
            "call_root": _last_name(callee.value) if isinstance(callee, ast.Attribute) else "",
            "call_attr": _last_name(callee),
            "func_is_name": isinstance(callee, ast.Name),
            "arg0_kind": type(node.args[0]).__name__ if node.args else None,
        }
    if type(node) in _FUNCTIONS:
        names = [_last_name(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        return {"name": node.name, "decorators": names}
    if isinstance(node, ast.While):
        return {"const_true": isinstance(node.test, ast.Constant) and node.test.value is True}
    if isinstance(node, ast.AugAssign):
        return {"is_add": isinstance(node.op, ast.Add), "string_like": _is_text(node.value)}
    if isinstance(node, ast.Compare):
        pairs = zip(node.ops, node.comparators)
        return {"in_literal_seq": any(
            isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)) for op, right in pairs
        )}
    return {}


def node_rows(source: str, kinds=frozenset(KINDS)) -> list[dict]:
    """Facts of the nodes of some kinds in tree order; raises what the parser raises.

    What lies below a node is counted on the way: a loop knows how many attribute calls of ``sleep`` came before it and how
    many until its subtree is done, and a call of a plain name adds to the functions of that name around it. So no node
    is ever compared with all others, however many a file has.
    """
    rows, number, sleeps = [], 0, 0
    # Entries: a node to enter with its surroundings, or a row whose subtree is done.
    todo = [(ast.parse(source), None, None, 0, None, ())]
    while todo:
        item = todo.pop()
        if type(item) is dict:
            item["post"] = number
            if "sleeps_below" in item:
                item["sleeps_below"] += sleeps
            continue
        node, field, parent, depth, in_async, functions = item
        kind = type(node)
        if kind in _REPORTED:
            number += 1
            row = {
                "pre": number, "parent_pre": parent, "kind": kind.__name__, "field": field,
                "line": node.lineno, "col": node.col_offset, "loop_depth": depth, "async_scope": in_async,
            }
            if row["kind"] in kinds:
                row.update(_describe(node))
                rows.append(row)
            todo.append(row)
            parent = number
            if kind in _LOOPS:
                depth += 1
                row["sleeps_below"] = -sleeps
            elif kind in _FUNCTIONS:
                in_async = kind is ast.AsyncFunctionDef
                row["self_calls"] = 0
                functions = (*functions, (node.name, row))
            elif kind is ast.Call:
                callee = node.func
                if type(callee) is ast.Name:
                    for name, around in functions:
                        if name == callee.id:
                            around["self_calls"] += 1
                elif type(callee) is ast.Attribute and callee.attr == "sleep":
                    sleeps += 1
        below = []
        for name in node._fields:
            if name in _PLAIN_FIELDS:
                continue
            value = getattr(node, name, None)
            for child in value if type(value) is list else (value,):
                if child is not None and type(child) not in _LEAVES:
                    below.append((child, name, parent, depth, in_async, functions))
        below.reverse()
        todo += below
    return rows


def parse_batch(texts: pa.Array, kinds=frozenset(KINDS), fields=FIELDS) -> pa.Array:
    offsets, rows, errors = [0], [], []
    # Trees hold no reference cycles; without the collector's scans a batch takes a third less time.
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for text in texts.to_pylist():
                error = None
                if text is not None:
                    try:
                        rows += node_rows(text, kinds)
                    except SyntaxError as exc:
                        error = exc.msg
                    except (ValueError, RecursionError, MemoryError) as exc:
                        error = type(exc).__name__
                offsets.append(len(rows))
                errors.append(error)
    finally:
        gc.enable()
    columns = [pa.array([row.get(name) for row in rows], kind) for name, _, kind in _FIELDS if name in fields]
    nodes = pa.StructArray.from_arrays(columns, [name for name in FIELDS if name in fields])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["nodes", "error"])


def facts_type(fields: Iterable[str] = FIELDS) -> str:
    node = ",".join(f"{name}:{sql}" for name, sql, _ in _FIELDS if name in fields)
    return f"struct<nodes:array<struct<{node}>>,error:string>"


def syntax_facts(kinds: Iterable[str] = KINDS, fields: Iterable[str] = FIELDS) -> Column:
    """The facts of a row's ``_text``; only Python texts cross to the parser, and only nodes of the kinds asked for, with the
    fields asked for, come back.

    Declared nondeterministic so that the optimizer neither repeats the parse nor moves a filter onto it.
    """
    kinds, fields = frozenset(kinds), tuple(fields)
    if unknown := (kinds - set(KINDS)) | (set(fields) - set(FIELDS)):
        raise ValueError(f"no such node kinds or fields: {sorted(unknown)}")

    def parse(texts: pa.Array) -> pa.Array:
        return parse_batch(texts, kinds, fields)

    udf = F.arrow_udf(parse, facts_type(fields)).asNondeterministic()
    return udf(F.expr("IF(language = 'python', _text, NULL)"))
