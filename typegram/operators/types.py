"""Type expressions as rendered keys name<arg,...>?, with node tables for what a flat schema can't nest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = "<([{", ">)]}"


def split_top(text: str, separator: str = ",", pairs: str = _OPEN + _CLOSE) -> list[str]:
    """Parts at the separators outside of brackets and quotes; '->' closes nothing."""
    half = len(pairs) // 2
    out, depth, start, quote, i = [], 0, 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in pairs[:half]:
            depth += 1
        elif c in pairs[half:] and not (c == ">" and i and text[i - 1] == "-"):
            depth -= 1
        elif depth == 0 and text.startswith(separator, i):
            out.append(text[start:i].strip())
            i += len(separator)
            start = i
            continue
        i += 1
    last = text[start:].strip()
    return [*out, last] if last or out else []


@lru_cache(maxsize=100_000)
def parse(key: str) -> tuple[str, tuple[str, ...], bool]:
    """name, argument keys, nullable."""
    key = key.strip()
    nullable = key.endswith("?")
    body = key[:-1].rstrip() if nullable else key
    i = body.find("<")
    if i < 0 or not body.endswith(">"):
        return body, (), nullable
    return body[:i].strip(), tuple(render(*parse(a)) for a in split_top(body[i + 1:-1])), nullable


def render(name: str, args: tuple[str, ...] = (), nullable: bool = False) -> str:
    return name + (f"<{','.join(args)}>" if args else "") + ("?" if nullable else "")


def depth(key: str) -> int:
    """0 for a leaf, else one more than the deepest argument."""
    args = parse(key)[1]
    return 1 + max(map(depth, args)) if args else 0


def variables(key: str, known: frozenset[str]) -> list[str]:
    name, args, _ = parse(key)
    if not args:
        return [name] if name in known else []
    return list(dict.fromkeys(v for a in args for v in variables(a, known)))


def substitute(key: str, binding: dict[str, str], known: frozenset[str]) -> str | None:
    """key with variables replaced; None when one is unbound."""
    name, args, nullable = parse(key)
    if not args and name in known:
        got = binding.get(name)
        return None if got is None else got + ("?" if nullable and not got.endswith("?") else "")
    done = [substitute(a, binding, known) for a in args]
    return None if None in done else render(name, tuple(done), nullable)


def erased(key: str) -> str:
    return parse(key)[0]


def nodes(types: DataFrame, column: str) -> DataFrame:
    """type_key, name, args, nullable, depth of all types and their parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, tuple] = {}
            todo = [t for t in pdf[column] if t is not None]
            while todo:
                key = render(*parse(todo.pop()))
                if key not in seen:
                    name, args, nullable = parse(key)
                    seen[key] = (key, name, list(args), nullable, depth(key))
                    todo += args
            yield pd.DataFrame(list(seen.values()), columns=["type_key", "name", "args", "nullable", "depth"])

    return types.select(column).distinct().mapInPandas(run, "type_key string, name string, args array<string>, nullable boolean, depth int").distinct()


# ---- C++ spellings ----
_QUALIFIER = {"const", "volatile"}
#: Spellings of one primitive type (fixed values).
SYNONYMS = {
    "unsigned": "unsigned int", "signed": "int", "signed int": "int", "long int": "long", "signed long": "long", "unsigned long int": "unsigned long",
    "long long int": "long long", "signed long long": "long long", "unsigned long long int": "unsigned long long", "short int": "short",
    "unsigned short int": "unsigned short", "signed short": "short",
}


def parse_cpp(text: str | None) -> dict | None:
    """name, args, is_const, is_volatile, pointers (struct per *), reference (&, && or None) of a C++ spelling."""
    if text is None or not text.strip():
        return None
    rest, reference, pointers = text.strip(), None, []
    while True:
        if rest.endswith("&&"):
            reference, rest = "&&", rest[:-2].rstrip()
        elif rest.endswith("&"):
            reference, rest = "&", rest[:-1].rstrip()
        elif m := re.search(r"\*\s*((?:const|volatile|\s)*)$", rest):
            q = m.group(1).split()
            pointers.insert(0, {"is_const": "const" in q, "is_volatile": "volatile" in q})
            rest = rest[:m.start()].rstrip()
        else:
            break
    i = rest.find("<")
    args: list[str] = []
    tail = ""
    if i >= 0:
        j = rest.rfind(">")
        args = [cpp_text(a) or a for a in split_top(rest[i + 1:j])]
        rest, tail = rest[:i], rest[j + 1:]
    words = rest.split() + tail.split()
    name = " ".join(w for w in words if w not in _QUALIFIER | {"struct", "class", "enum", "typename"})
    return {"name": SYNONYMS.get(name, name), "args": args, "is_const": "const" in words, "is_volatile": "volatile" in words, "pointers": pointers, "reference": reference}


def cpp_text(text: str | None) -> str | None:
    """The canonical spelling."""
    t = parse_cpp(text)
    if t is None:
        return None
    out = "const " * t["is_const"] + "volatile " * t["is_volatile"] + t["name"] + (f"<{', '.join(t['args'])}>" if t["args"] else "")
    for p in t["pointers"]:
        out += "*" + " const" * p["is_const"] + " volatile" * p["is_volatile"]
    return out + (t["reference"] or "")


CPP_SCHEMA = "struct<name:string,args:array<string>,is_const:boolean,is_volatile:boolean,pointers:array<struct<is_const:boolean,is_volatile:boolean>>,reference:string>"


def cpp_parsed(df: DataFrame, column: str, name: str = "parsed") -> DataFrame:
    """df with the parsed form of a spelling; distinct spellings only are parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[name] = [parse_cpp(t) for t in pdf[column]]
            yield pdf

    return df.join(df.select(column).distinct().mapInPandas(run, f"`{column}` string, `{name}` {CPP_SCHEMA}"), column, "left")


def cpp_slot(spelling: Column) -> Column:
    """The slot type of a parameter: const T& is T; T& and T&& stay."""
    s = F.trim(spelling)
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*&\s*$", ""), r"^const\s+|\s+const$", ""))
    return F.when(s.rlike(r"[^&]&\s*$") & s.rlike(r"^const\s|\sconst\s*&\s*$"), bare).otherwise(F.regexp_replace(s, r"^const\s+(?!.*[*&])", ""))


def resolved_aliases(df: DataFrame, column: str, aliases: DataFrame, rounds: int = 8) -> DataFrame:
    """df with names replaced along alias(alias, target), at most `rounds` times; cycles stop there."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("target").alias("_target"))
    for _ in range(rounds):
        df = df.join(a, df[column] == F.col("_alias"), "left").withColumn(column, F.coalesce("_target", column)).drop("_alias", "_target")
    return df
