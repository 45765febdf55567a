"""Facts of Python sources, by syntax tree: imports, candidate statements, canonical tokens, bindings, definitions."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.functions.decoding import decode_python

FRESH = "@fresh"
_SKIPPED = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}


def parsed(data: bytes | None) -> tuple[str | None, ast.Module | None]:
    text = decode_python(data)
    if text is None:
        return None, None
    try:
        return text, ast.parse(text, type_comments=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return text, None


def import_roots(tree: ast.AST) -> list[str]:
    """First parts of absolutely imported modules, each once."""
    out = set()
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                out |= {a.name.partition(".")[0] for a in names}
            case ast.ImportFrom(module=str(module), level=0):
                out.add(module.partition(".")[0])
    return sorted(out)


def visible_imports(tree: ast.Module, line: int) -> list[tuple[str, str]]:
    """(bound name, module or module.name) of top-level imports that end before a line; later ones win."""
    out: dict[str, str] = {}
    for node in tree.body:
        if node.lineno >= line:
            break
        if isinstance(node, ast.Import):
            for a in node.names:
                out[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
        elif isinstance(node, ast.ImportFrom) and node.level == 0 and node.module:
            for a in node.names:
                if a.name != "*":
                    out[a.asname or a.name] = f"{node.module}.{a.name}"
    return sorted(out.items())


_ALLOWED_OPS = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow)


def in_surface(root: ast.AST) -> bool:
    """Whether an expression stays in the fragment of names, constants, attributes, calls, subscripts and arithmetic."""
    for node in ast.walk(root):
        match node:
            case ast.Constant(value=v):
                if v is not None and type(v) not in (bool, int, float, complex, str, bytes):
                    return False
            case ast.Attribute(attr=name):
                if name.startswith("_"):
                    return False
            case ast.UnaryOp(op=op):
                if not isinstance(op, ast.UAdd | ast.USub | ast.Invert):
                    return False
            case ast.BinOp(op=op):
                if not isinstance(op, _ALLOWED_OPS):
                    return False
            case ast.keyword(arg=None) | ast.Starred():
                return False
            case ast.Name() | ast.Call() | ast.keyword() | ast.Subscript() | ast.Slice() | ast.operator() | ast.unaryop() | ast.expr_context():
                pass
            case _:
                return False
    return True


def spelling_problems(text: str) -> dict[str, int]:
    """Counts of spellings the fragment has no form for: trailing commas, adjacent strings."""
    out = {"trailing_comma": 0, "adjacent_literal": 0}
    last = None
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in _SKIPPED:
                continue
            if last is not None:
                out["trailing_comma"] += last.string == "," and t.string in (")", "]", "}")
                out["adjacent_literal"] += last.type == t.type == tokenize.STRING
            last = t
    except (tokenize.TokenError, SyntaxError):
        pass
    return out


def suppressed(text: str) -> bool:
    """Whether a comment switches checking off."""
    import re

    try:
        return any(t.type == tokenize.COMMENT and re.search(r"#\s*(type:\s*ignore|noqa|ty:\s*ignore|pyright:)", t.string)
                   for t in tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, SyntaxError):
        return False


def candidates(tree: ast.Module) -> list[tuple[str, ast.stmt, ast.expr, str | None]]:
    """(kind, statement, value, assigned name) of expression statements and single-name assignments, anywhere, in order."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Expr) and not isinstance(node.value, ast.Constant):
            out.append(("expression", node, node.value, None))
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            out.append(("output-assignment", node, node.value, node.targets[0].id))
    return sorted((c for c in out if in_surface(c[2])), key=lambda c: (c[1].lineno, c[1].col_offset))


def canonical_tokens(text: str, fresh: str | None = None) -> list[str] | None:
    """Numbers as 0, 0.0 or 0j, strings as "" or b"", the first use of a fresh name as @fresh; None for other tokens."""
    out: list[str] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in _SKIPPED:
                continue
            if t.type == tokenize.NUMBER:
                out.append({int: "0", float: "0.0", complex: "0j"}[type(ast.literal_eval(t.string))])
            elif t.type == tokenize.STRING:
                out.append('b""' if isinstance(ast.literal_eval(t.string), bytes) else '""')
            elif t.type in (tokenize.NAME, tokenize.OP):
                if t.string == fresh:
                    out.append(FRESH)
                    fresh = None
                else:
                    out.append(t.string)
            else:
                return None
    except (tokenize.TokenError, SyntaxError, ValueError, KeyError):
        return None
    return out


def bound_before(tree: ast.Module, name: str, line: int) -> bool:
    """Whether a name is bound in the scope around a line before that line."""
    scope: ast.AST = tree
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and node.lineno < line <= (node.end_lineno or node.lineno):
            if not isinstance(scope, ast.Module) and node.lineno < scope.lineno:
                continue
            scope = node
    args = scope.args if isinstance(scope, ast.FunctionDef | ast.AsyncFunctionDef) else None
    if args and any(a.arg == name for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]):
        return True
    for node in _own_scope(scope):
        if getattr(node, "lineno", line) >= line:
            continue
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store) and node.id == name or isinstance(node, ast.FunctionDef | ast.ClassDef) and node.name == name:
            return True
        if isinstance(node, ast.Import | ast.ImportFrom) and any((a.asname or a.name.partition(".")[0]) == name for a in node.names):
            return True
    return False


def _own_scope(scope: ast.AST) -> Iterator[ast.AST]:
    todo = list(ast.iter_child_nodes(scope))
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda):
            todo += ast.iter_child_nodes(node)


def loaded_after(tree: ast.Module, name: str, line: int) -> bool:
    return any(isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id == name and n.lineno > line for n in ast.walk(tree))


def identifiers(tree: ast.Module) -> list[str]:
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)})


def fresh_name(used: set[str], stem: str = "typegram") -> str:
    """The least unused name of the form __stem_fresh_k."""
    k = 0
    while f"__{stem}_fresh_{k}" in used:
        k += 1
    return f"__{stem}_fresh_{k}"


def hole(text: str, line: int, column: int, end_line: int, end_column: int) -> tuple[str, str, str]:
    """Text before, in and after a span of 1-based lines and UTF-8 byte columns."""
    data = text.encode()
    starts = [0]
    for i, b in enumerate(data):
        if b == 10:
            starts.append(i + 1)
    a, b = starts[line - 1] + column, starts[end_line - 1] + end_column
    return data[:a].decode(), data[a:b].decode(), data[b:].decode()


def definitions(tree: ast.Module) -> list[tuple[str, str, str | None, bool]]:
    """(name, kind, annotation, public) of the top level of a module or stub, with TYPE_CHECKING and version branches."""
    out: list[tuple[str, str, str | None]] = []
    exported: set[str] | None = None
    todo = list(reversed(tree.body))
    while todo:
        node = todo.pop()
        match node:
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
                out.append((name, "function", ast.unparse(node.returns) if node.returns else None))
            case ast.ClassDef(name=name):
                out.append((name, "class", None))
            case ast.AnnAssign(target=ast.Name(id=name), annotation=a):
                out.append((name, "attribute", ast.unparse(a)))
            case ast.Assign(targets=[ast.Name(id="__all__")], value=ast.List(elts=e) | ast.Tuple(elts=e)):
                exported = {x.value for x in e if isinstance(x, ast.Constant)}
            case ast.AugAssign(target=ast.Name(id="__all__"), value=ast.List(elts=e) | ast.Tuple(elts=e)):
                exported = (exported or set()) | {x.value for x in e if isinstance(x, ast.Constant)}
            case ast.Assign(targets=[ast.Name(id=name)], value=v):
                out.append((name, "alias" if isinstance(v, ast.Subscript | ast.Name | ast.Attribute) else "attribute", ast.unparse(v)))
            case ast.ImportFrom(names=names):
                out += [(a.asname, "reexport", None) for a in names if a.asname and a.asname == a.name]
            case ast.If(test=ast.Name(id="TYPE_CHECKING"), body=body):
                todo += reversed(body)
            case ast.If(body=body, orelse=orelse):
                todo += reversed([*body, *orelse])
            case ast.Try(body=body):
                todo += reversed(body)
    return [(n, k, a, n in exported if exported is not None else not n.startswith("_")) for n, k, a in out]


def per_source(df: DataFrame, key: str, data: str, f: Callable[[str, ast.Module], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """key and the rows f(text, tree) of every source that parses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for pdf in batches:
            rows = []
            for k, d in zip(pdf[key], pdf[data], strict=True):
                text, tree = parsed(d)
                if tree is not None:
                    rows += [(k, *r) for r in f(text, tree)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, data).filter(F.col(data).isNotNull()).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def scanned_imports(df: DataFrame, group: str, data: str = "data") -> DataFrame:
    """group, python_files, decoded_files, parsed_files, failures and imported roots, counted in the workers already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for pdf in batches:
            rows: dict[tuple, int] = {}

            def add(g, what, name=""):
                rows[g, what, name] = rows.get((g, what, name), 0) + 1

            for g, d in zip(pdf[group], pdf[data], strict=True):
                text, tree = parsed(d)
                add(g, "python_files")
                add(g, "decode_failures" if text is None else "decoded_files")
                if text is not None:
                    add(g, "parse_failures" if tree is None else "parsed_files")
                for root in import_roots(tree) if tree is not None else ():
                    add(g, "root", root)
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=[group, "counter", "name", "n"])

    kind = df.schema[group].dataType.simpleString()
    parts = df.select(group, data).mapInPandas(run, f"`{group}` {kind}, counter string, name string, n bigint")
    return parts.groupBy(group, "counter", "name").agg(F.sum("n").alias("n"))


def statements(df: DataFrame, key: str, data: str = "data") -> DataFrame:
    """key, kind, line, column, end_line, end_column, name, tokens of all candidate statements."""

    def rows(text: str, tree: ast.Module) -> list[tuple]:
        out = []
        for kind, node, _value, name in candidates(tree):
            segment = ast.get_source_segment(text, node)
            tokens = canonical_tokens(segment, name) if segment is not None else None
            if tokens is not None:
                out.append((kind, node.lineno, node.col_offset, node.end_lineno, node.end_col_offset, name, tokens))
        return out

    return per_source(df, key, data, rows, "kind string, line int, `column` int, end_line int, end_column int, name string, tokens array<string>",
                      ["kind", "line", "column", "end_line", "end_column", "name", "tokens"])


def simplified_completions(df: DataFrame) -> DataFrame:
    """Completions(query, ordinal, label, detail, has_edit): legal, public names without edits; the last of a label wins."""
    ok = F.col("label").rlike(r"\A[^\W\d]\w*\z") & ~F.col("label").isin(*keyword.kwlist) & ~F.col("label").startswith("_") & ~F.coalesce("has_edit", F.lit(False))
    return df.filter(ok).groupBy("query", "label").agg(F.max_by(F.struct("ordinal", "detail"), "ordinal").alias("s")).select("query", "label", "s.ordinal", "s.detail")


def completed_union(df: DataFrame, passes: int = 8) -> DataFrame:
    """Union of repeated pages(query, pass, label, detail): passes until one adds nothing, the best detail of each label."""
    firsts = df.groupBy("query", "label").agg(F.min("pass").alias("first"))
    new = firsts.groupBy("query").agg(F.collect_set("first").alias("with_new"))
    kept = df.join(new, "query").filter((F.col("pass") < passes) & F.forall(F.sequence(F.lit(0), F.col("pass")), lambda i: F.array_contains("with_new", i.cast("int"))))
    vague = F.col("detail").isNull() | F.col("detail").isin("Any", "Unknown")
    return kept.groupBy("query", "label").agg(F.min_by("detail", F.struct(vague, "detail", "pass")).alias("detail"))
