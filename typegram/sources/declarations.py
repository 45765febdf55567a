"""Declarations of C++ translation units from their syntax trees as JSON, and of Python stubs.

A file holds one or more JSON trees of nodes {kind, name, inner, type.qualType, ...}. Only declaration kinds are followed,
so bodies are never visited. The access of a member is that of the last access specifier before it.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typegram.operators.types import cpp_text, split_top

RECORD = "name string, kind string, owner string, result string, params array<string>, access string, is_static boolean, is_const boolean, is_deleted boolean, is_variadic boolean, complete boolean, target string, ord bigint"
_COLUMNS = ["name", "kind", "owner", "result", "params", "access", "is_static", "is_const", "is_deleted", "is_variadic", "complete", "target", "ord"]
_KINDS = {"CXXRecordDecl": "type", "ClassTemplateDecl": "template", "EnumDecl": "type", "TypedefDecl": "alias", "TypeAliasDecl": "alias", "FunctionDecl": "function",
          "CXXMethodDecl": "method", "CXXConstructorDecl": "constructor", "VarDecl": "value", "FieldDecl": "value", "NamespaceDecl": "scope", "LinkageSpecDecl": "scope", "TranslationUnitDecl": "scope"}


def trees(text: str) -> Iterator[dict]:
    """The JSON values of a sequence, one after another."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text):
            value, at = decoder.raw_decode(text, at)
            yield value


def _result(spelling: str) -> tuple[str | None, bool, bool]:
    """Result type, const and variadic of a function's spelling."""
    head, _, tail = spelling.partition("(")
    return cpp_text(head), tail.rpartition(")")[2].strip().startswith("const"), "..." in tail


def records(tree: dict) -> list[tuple]:
    out: list[tuple] = []
    todo: list[tuple[dict, str | None, str]] = [(tree, None, "public")]
    while todo:
        node, owner, access = todo.pop()
        kind = _KINDS.get(node.get("kind", ""))
        if kind is None or node.get("isImplicit"):
            continue
        name = node.get("name")
        full = f"{owner}::{name}" if owner and name and kind in ("type", "template", "scope") else name
        spelling = (node.get("type") or {}).get("qualType", "")
        inner = node.get("inner") or []
        if kind in ("function", "method", "constructor"):
            result, const, variadic = _result(spelling)
            params = [cpp_text((x.get("type") or {}).get("qualType")) or "?" for x in inner if x.get("kind") == "ParmVarDecl"]
            what = "static" if kind == "method" and node.get("storageClass") == "static" else "invocation" if name == "operator()" else kind
            out.append((name, what, owner, owner if kind == "constructor" else result, params, access, what == "static", const, bool(node.get("explicitlyDeleted")), variadic, True, None, len(out)))
            continue
        if kind in ("value", "alias"):
            out.append((name, kind, owner, None, [], access, False, False, False, False, True, cpp_text(spelling), len(out)))
            continue
        if kind == "type" and name:
            out.append((full, kind, owner, None, [], access, False, False, False, False, bool(node.get("completeDefinition")), None, len(out)))
            out += [(full, "base", owner, None, [], b.get("access", "public"), False, False, False, False, True, cpp_text((b.get("type") or {}).get("qualType")), len(out) + i)
                    for i, b in enumerate(node.get("bases") or [])]
        members, now = [], "private" if node.get("tagUsed") == "class" else "public"
        for x in inner:
            if x.get("kind") == "AccessSpecDecl":
                now = x.get("access", now)
            else:
                members.append((x, full if kind != "scope" or full else owner, now if kind == "type" else access))
        todo += reversed(members)
    return out


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """All declaration records of the files at path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                for tree in trees(text):
                    yield pd.DataFrame(records(tree), columns=_COLUMNS)

    return spark.read.text(path, wholetext=True).mapInPandas(run, RECORD)


def types_of(rows: DataFrame) -> DataFrame:
    """One row per type, the last complete definition before any incomplete one."""
    t = rows.filter("kind = 'type'")
    return t.groupBy("name").agg(F.max_by(F.struct("owner", "complete", "access"), F.struct("complete", "ord")).alias("s")).select("name", "s.*")


def callables_of(rows: DataFrame) -> DataFrame:
    """Callables with their signature key, each once."""
    c = rows.filter(F.col("kind").isin("function", "method", "static", "constructor", "invocation"))
    key = F.concat_ws("|", F.coalesce("owner", F.lit("")), "kind", "name", F.array_join("params", ","), F.col("is_const").cast("string"))
    return c.withColumn("signature", key).dropDuplicates(["signature"]).drop("target", "complete", "ord")


# ---- stubs ----
STUB = "module string, owner string, name string, kind string, params array<struct<name:string,type:string,kind:string,required:boolean>>, result string, bases array<string>"


def _variable_domain(call: ast.Call) -> list[str]:
    """Constraints of a type variable, else its bound, else object."""
    constraints = [ast.unparse(x) for x in call.args[1:]]
    bound = [ast.unparse(k.value) for k in call.keywords if k.arg == "bound"]
    return constraints or bound or ["object"]


def type_variables(tree: ast.Module) -> dict[str, list[str]]:
    return {n.targets[0].id: _variable_domain(n.value) for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name)
            and isinstance(n.value, ast.Call) and ast.unparse(n.value.func).rpartition(".")[2] == "TypeVar"}


def type_aliases(tree: ast.Module) -> dict[str, str]:
    return {n.targets[0].id: ast.unparse(n.value) for n in tree.body if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name)
            and isinstance(n.value, ast.Name | ast.Subscript | ast.BinOp | ast.Attribute)}


def resolved(annotation: str, aliases: dict[str, str], seen: frozenset[str] = frozenset()) -> str:
    """Annotation with module prefixes dropped, aliases replaced (cycles stay), Optional and Union as alternatives."""
    text = annotation.strip().strip("'\"")
    base, _, rest = text.partition("[")
    base = base.rpartition(".")[2] if base.replace(".", "").replace("_", "").isalnum() else base
    if not rest:
        parts = split_top(text, "|", "[({])}")
        if len(parts) > 1:
            return " | ".join(resolved(p, aliases, seen) for p in parts)
        if base in aliases and base not in seen:
            return resolved(aliases[base], aliases, seen | {base})
        return base
    args = [resolved(a, aliases, seen) for a in split_top(rest.rpartition("]")[0], ",", "[({])}")]
    if base == "Optional":
        return f"{args[0]} | None"
    if base == "Union":
        return " | ".join(args)
    return f"{base}[{', '.join(args)}]"


def stub_records(module: str, text: str) -> list[tuple]:
    """Functions, methods, attributes and constructors of a stub. Of overloaded functions only the overloads count;
    enumerations and protocols can't be constructed."""
    tree = ast.parse(text)
    aliases = type_aliases(tree)
    out: list[tuple] = []

    def function(node: ast.FunctionDef, owner: str | None, bases: list[str]) -> tuple:
        a = node.args
        required = len(a.posonlyargs) + len(a.args) - len(a.defaults)
        known = lambda x: resolved(ast.unparse(x), aliases) if x else "Any"
        ps = [(p.arg, known(p.annotation), "posonly" if i < len(a.posonlyargs) else "poskw", i < required) for i, p in enumerate([*a.posonlyargs, *a.args])]
        marks = {ast.unparse(d).rpartition(".")[2] for d in node.decorator_list}
        if owner and "staticmethod" not in marks:
            ps = ps[1:]
        ps += [(a.vararg.arg, known(a.vararg.annotation), "vararg", False)] if a.vararg else []
        ps += [(p.arg, known(p.annotation), "kwonly", d is None) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        kind = "attribute" if "property" in marks else "static" if marks & {"staticmethod", "classmethod"} else "constructor" if node.name == "__init__" else "method" if owner else "function"
        result = owner if kind == "constructor" else known(node.returns)
        return module, owner, node.name, kind, [dict(zip(("name", "type", "kind", "required"), p, strict=True)) for p in ps], owner if result == "Self" else result, bases

    def body(nodes: list[ast.stmt], owner: str | None, bases: list[str]) -> None:
        overloaded = {n.name for n in nodes if isinstance(n, ast.FunctionDef) and any(ast.unparse(d).endswith("overload") for d in n.decorator_list)}
        closed = any(b.partition("[")[0] in ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "Protocol") for b in bases)
        for n in nodes:
            if isinstance(n, ast.FunctionDef) and not (n.name.startswith("_") and n.name != "__init__"):
                if n.name in overloaded and not any(ast.unparse(d).endswith("overload") for d in n.decorator_list) or closed and n.name == "__init__":
                    continue
                out.append(function(n, owner, bases))
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and not n.target.id.startswith("_"):
                out.append((module, owner, n.target.id, "attribute", [], resolved(ast.unparse(n.annotation), aliases), bases))
            elif isinstance(n, ast.ClassDef) and owner is None:
                b = [resolved(ast.unparse(x), aliases) for x in n.bases]
                body(n.body, n.name, b)
                if not any(isinstance(x, ast.FunctionDef) and x.name == "__init__" for x in n.body) and not any(x.partition("[")[0] in ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "Protocol") for x in b):
                    out.append((module, n.name, "__init__", "constructor", [], n.name, b))

    body(tree.body, None, [])
    return out


def read_stubs(files: DataFrame) -> DataFrame:
    """STUB rows of files(module, path); files that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for module, path in zip(pdf["module"], pdf["path"], strict=True):
                try:
                    with open(path, encoding="utf-8") as f:
                        rows += stub_records(module, f.read())
                except (SyntaxError, UnicodeDecodeError, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["module", "owner", "name", "kind", "params", "result", "bases"])

    return files.select("module", "path").mapInPandas(run, STUB)


def stub_productions(rows: DataFrame, max_arity: int = 3, max_layouts: int = 64) -> DataFrame:
    """Productions of stub records: attributes, constructors, methods, static and free functions, and unit rows of bases."""
    from typegram.operators.calls import member_productions
    from typegram.operators.grammar import symbol
    from typegram.operators.layouts import with_layouts

    n = lambda v: F.struct(F.lit("N").alias("kind"), v.alias("value"))
    t = lambda v: F.struct(F.lit("T").alias("kind"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    attributes = member_productions(rows.filter("kind = 'attribute' AND owner IS NOT NULL").select("owner", "name", F.col("result").alias("type")))
    values = rows.filter("kind = 'attribute' AND owner IS NULL").select(F.col("result").alias("lhs"), F.array(t(F.col("name"))).alias("rhs"))
    calls = with_layouts(rows.filter("kind <> 'attribute'").select("owner", "name", "kind", "params", "result"), max_arity=max_arity, max_layouts=max_layouts)
    head = (F.when(F.col("kind") == "constructor", F.array(t(F.col("owner")))).when(F.col("kind") == "static", F.array(t(F.col("owner")), t("."), t(F.col("name"))))
            .when(F.col("kind") == "method", F.array(n(F.col("owner")), t("."), t(F.col("name")))).otherwise(F.array(t(F.col("name")))))
    args = F.concat(F.transform("positional", lambda x: F.array(n(x))), F.transform("keywords", lambda k: F.array(t(k["name"]), t("="), n(k["type"]))))
    flat = F.flatten(F.transform(args, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.array(t(",")), x))))
    called = calls.select(F.col("result").alias("lhs"), F.concat(head, F.array(t("(")), flat, F.array(t(")"))).alias("rhs"))
    bases = rows.filter("owner IS NOT NULL").select(F.explode("bases").alias("lhs"), F.array(symbol("N", F.col("owner"))).alias("rhs"))
    return attributes.unionByName(values).unionByName(called).unionByName(bases).distinct()
