"""Syntax nodes of the Python templates, fixed as literals: listed by the walk once, then compared with the sources by reading.

A node is ``pre-post parent kind field line:col depth`` and then what is known of it. ``@`` is a coroutine's scope, ``@@`` that of
a function inside one. A call has its root (``.`` for none), its name, whether that is a plain one, and the kind of its first
argument; a loop the sleeps below it; a function its name, decorators and calls of itself.
"""

from __future__ import annotations

NODES: dict[int, tuple[str, ...]] = {
    0: ("1-3 - For body 1:0 0 sleeps=0", "2-3 1 For body 2:4 1 sleeps=0", "3-3 2 Call value 3:8 2 call=.,use,plain,Name"),
    1: ("1-2 - For body 2:0 0 sleeps=0", "2-2 1 Call value 3:4 1 call=requests,get,attr,BinOp"),
    2: ("1-1 - Call value 1:5 0 call=.,open,plain,Constant", "2-2 - Call value 2:7 0 call=fh,read,attr,"),
    3: ("1-1 - Call context_expr 1:5 0 call=.,open,plain,Constant", "2-3 - For body 2:4 0 sleeps=0", "3-3 2 AugAssign body 3:8 1 adds=text"),
    4: ("1-2 - While body 2:0 0 endless sleeps=1", "2-2 1 Call value 3:4 1 call=time,sleep,attr,Constant"),
    5: ("1-4 - AsyncFunctionDef body 1:0 0 def=f,,0", "2-2 1 Call value 2:4 0 @ call=time,sleep,attr,Constant",
        "3-4 1 FunctionDef body 3:4 0 @ def=g,,0", "4-4 3 Call value 4:8 0 @@ call=time,sleep,attr,Constant"),
    6: ("1-3 - FunctionDef body 1:0 0 def=fib,,2", "2-2 1 Call left 2:11 0 @@ call=.,fib,plain,BinOp",
        "3-3 1 Call right 2:24 0 @@ call=.,fib,plain,BinOp"),
    7: ("1-3 - FunctionDef body 3:0 0 def=fib,lru_cache,2", "2-2 1 Call left 4:11 0 @@ call=.,fib,plain,BinOp",
        "3-3 1 Call right 4:24 0 @@ call=.,fib,plain,BinOp"),
    8: ("1-4 - For body 1:0 0 sleeps=0", "2-2 1 Call iter 1:9 1 call=.,sorted,plain,Name", "3-3 1 Compare test 2:7 1 literal",
        "4-4 1 Call value 3:8 1 call=re,sub,attr,Constant"),
    9: ("1-1 - Call value 1:8 0 call=.,sum,plain,ListComp", "2-2 - Call value 2:7 0 call=.,join,attr,ListComp"),
    10: ("1-4 - For body 1:0 0 sleeps=0", "2-2 1 Call value 2:4 1 call=conn,execute,attr,Name",
         "3-3 1 Call value 3:4 1 call=cursor,execute,attr,Name", "4-4 1 Call value 4:4 1 call=copy,deepcopy,attr,Name"),
    11: ("1-1 - Call value 2:0 0 call=.,print,plain,Constant", "2-2 - Call value 3:0 0 call=logger,debug,attr,JoinedStr"),
    12: ("1-1 - Call value 2:0 0 call=cur,execute,attr,Constant",),
    14: ("1-2 - For body 1:0 0 sleeps=0", "2-2 1 Call iter 1:12 1 call=df,iterrows,attr,"),
}
COLUMNS = (
    "pre", "post", "parent_pre", "kind", "field", "line", "col", "loop_depth", "async_scope", "call_root", "call_attr",
    "func_is_name", "name", "const_true", "is_add", "string_like", "arg0_kind", "in_literal_seq", "decorators", "sleeps_below",
    "self_calls",
)


def rows() -> list[tuple]:
    """``template`` and COLUMNS of every node."""
    out = []
    for template, nodes in NODES.items():
        for node in nodes:
            span, parent, kind, field, place, depth, *facts = node.split(" ")
            pre, post = map(int, span.split("-"))
            line, col = map(int, place.split(":"))
            row = dict.fromkeys(COLUMNS) | {
                "pre": pre, "post": post, "parent_pre": None if parent == "-" else int(parent), "kind": kind, "field": field,
                "line": line, "col": col, "loop_depth": int(depth),
            }
            if kind == "While":
                row["const_true"] = False
            for fact in facts:
                what, _, value = fact.partition("=")
                if what in ("@", "@@"):
                    row["async_scope"] = what == "@"
                elif what == "sleeps":
                    row["sleeps_below"] = int(value)
                elif what == "endless":
                    row["const_true"] = True
                elif what == "literal":
                    row["in_literal_seq"] = True
                elif what == "adds":
                    row |= {"is_add": True, "string_like": value == "text"}
                elif what == "call":
                    root, name, plain, first = value.split(",")
                    row |= {"call_root": root.strip("."), "call_attr": name, "func_is_name": plain == "plain", "arg0_kind": first or None}
                elif what == "def":
                    name, decorators, calls = value.split(",")
                    row |= {"name": name, "decorators": decorators, "self_calls": int(calls)}
            out.append((template, *(row[c] for c in COLUMNS)))
    return out
