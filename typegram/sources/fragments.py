"""Library fragments: self-describing grammar texts with metadata, a symbol dictionary and rows.

    # typegram-library-cfg: 2
    # module: bisect
    # symbol-N00000: A:int
    N00000 -> N00001 bisect

One file is one module. Reading checks what the file says of itself: header, aliases, reserved symbols, counts.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


HEADER = "typegram-library-cfg"
#: Keys that name a schema header end like this, and only these versions are read.
HEADER_PATTERN, VERSIONS = r"library-cfg$", ("1", "2")


class FragmentError(ValueError):
    """A fragment that contradicts its format or itself."""


def encoded(name: str) -> str:
    """E:/A: symbols with everything but unreserved characters in percent form."""
    return name[:2] + quote(name[2:], safe="") if name[:2] in ("E:", "A:") else name


def decoded(name: str) -> str:
    return name[:2] + unquote(name[2:]) if name[:2] in ("E:", "A:") else name


def decoded_column(c: Column) -> Column:
    """JVM-side decoding: a plus sign is a plus sign here, not a blank."""
    return F.when(c.rlike("^[EA]:"), F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def metadata_value(c: Column) -> Column:
    """JSON text as it is, other text as a JSON string; so every value is valid JSON."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, no, line of the texts at path, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("no", "line"))
    return whole.withColumn("line", F.trim("line")).filter("line <> ''")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """meta(file, key, value), symbol(file, alias, nonterminal), production(file, lhs, rhs), errors(file, reason)."""
    comment = lines.filter(F.col("line").startswith("#")).select(
        "file", "no", F.trim(F.regexp_extract("line", r"^#\s*([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^#[^:]*:(.*)$", 1)).alias("value"))
    symbol = comment.filter(F.col("key").rlike("^symbol-")).select("file", F.substring("key", 8, 100).alias("alias"), decoded_column(F.col("value")).alias("nonterminal"))
    meta = comment.filter(~F.col("key").rlike("^symbol-")).select("file", "no", "key", "value")
    rows = lines.filter(~F.col("line").startswith("#")).select(
        "file", "no", F.regexp_extract("line", r"^(\S+) -> \S", 1).alias("l"), F.split(F.regexp_extract("line", r"^\S+ -> (.*)$", 1), r"\s+").alias("atoms"))
    long = rows.select("file", "no", "l", F.posexplode("atoms").alias("pos", "atom"))
    names = symbol.select("file", F.col("alias").alias("atom"), "nonterminal")
    joined = long.join(names, ["file", "atom"], "left")
    heads = rows.select("file", "no", F.col("l").alias("atom")).join(names, ["file", "atom"], "left").select(
        "file", "no", F.coalesce("nonterminal", decoded_column(F.col("atom"))).alias("lhs"), (F.col("nonterminal").isNull() & F.col("atom").rlike(r"^N\d+$")).alias("undefined"))
    value = F.coalesce("nonterminal", decoded_column(F.col("atom")))
    body = joined.groupBy("file", "no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(value.rlike("^[EA]:"), "N").otherwise("T").alias("kind"), value.alias("value")))),
                    lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))).alias("rhs"),
        F.max(F.col("nonterminal").isNull() & F.col("atom").rlike(r"^N\d+$")).alias("undefined_atom"), F.max(F.col("atom").isin("[", "]")).alias("bracket"))
    p = heads.join(body, ["file", "no"])
    production = p.select("file", "lhs", "rhs").distinct()
    first = meta.groupBy("file").agg(F.min_by(F.struct("key", "value"), "no").alias("h"), F.min("no").alias("n0"))
    files = lines.select("file").distinct()
    errors = [
        files.join(first, "file", "left").filter(~(F.coalesce(F.col("h.key").rlike(HEADER_PATTERN), F.lit(False)) & F.coalesce(F.col("h.value").isin(*VERSIONS), F.lit(False)))).select("file", F.lit("header").alias("reason")),
        comment.filter("key = ''").select("file", F.lit("malformed metadata").alias("reason")),
        rows.filter("l = ''").select("file", F.lit("malformed row").alias("reason")),
        symbol.groupBy("file", "alias").agg(F.count("*").alias("n")).filter("n > 1").select("file", F.lit("duplicate alias").alias("reason")),
        symbol.filter(~F.col("alias").rlike(r"^N\d+$")).select("file", F.lit("invalid alias").alias("reason")),
        symbol.filter(~F.col("nonterminal").rlike("^[EA]:")).select("file", F.lit("alias maps to no type").alias("reason")),
        p.filter("undefined OR undefined_atom").select("file", F.lit("undefined alias").alias("reason")),
        p.filter("bracket").select("file", F.lit("bracket terminal").alias("reason")),
        p.filter((F.col("lhs") == "START") | F.exists("rhs", lambda s: s["value"] == "START")).select("file", F.lit("START row").alias("reason")),
        p.filter(F.exists("rhs", lambda s: (s["kind"] == "T") & s["value"].rlike(r"\A[\w]+[^\w]|\A[^\w\"'@]+\w"))).select("file", F.lit("composite terminal").alias("reason")),
    ]
    flat = production.select("file", "lhs", "rhs", F.explode("rhs").alias("s"))
    actual = production.groupBy("file").agg(F.count("*").alias("productions"), F.sum(F.size("rhs") + 1).alias("grammar-symbols")).join(
        flat.select("file", F.explode(F.array(F.struct(F.lit("N").alias("kind"), F.col("lhs").alias("value")), F.col("s"))).alias("x")).distinct().groupBy("file").agg(
            F.count_if(F.col("x.kind") == "N").alias("nonterminals"), F.count_if(F.col("x.kind") == "T").alias("terminals")), "file")
    counted = actual.select("file", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("n")) for k in ("productions", "nonterminals", "terminals", "grammar-symbols")))).alias("c")).select("file", "c.*")
    errors.append(meta.join(counted, ["file", "key"]).filter(F.col("value") != F.col("n").cast("string")).select("file", F.concat(F.lit("count of "), "key").alias("reason")))
    out = errors[0]
    for e in errors[1:]:
        out = out.unionByName(e)
    return meta.drop("no"), symbol, production, out.distinct()


def read_fragments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """meta and production of valid fragments; raises FragmentError with the first contradiction."""
    meta, _, production, errors = parse(read_lines(spark, path))
    bad = errors.orderBy("file", "reason").first()
    if bad:
        raise FragmentError(f"{bad.file}: {bad.reason}")
    return meta, production


def render(p: DataFrame, module: str, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """no, line of a fragment: metadata, aliases over the sorted nonterminals, sorted distinct rows."""
    from typegram.operators.ordering import indexed

    spark = p.sparkSession
    names = p.select(F.explode(F.concat(F.array("lhs"), F.transform(F.filter("rhs", lambda s: s["kind"] == "N"), lambda s: s["value"]))).alias("name")).distinct()
    alias = indexed(names, ["name"], "i").select("name", F.concat(F.lit("N"), F.lpad(F.col("i").cast("string"), 5, "0")).alias("alias"))
    long = p.distinct().withColumn("pid", F.sha2(F.to_json(F.struct("lhs", "rhs")), 256)).select("pid", "lhs", F.posexplode("rhs").alias("pos", "s"))
    atoms = long.join(alias.withColumnRenamed("name", "v"), (F.col("s.kind") == "N") & (F.col("s.value") == F.col("v")), "left").select(
        "pid", "lhs", "pos", F.coalesce("alias", "s.value").alias("atom"))
    rows = atoms.groupBy("pid", "lhs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "atom"))), lambda x: x["atom"]), " ").alias("r")).join(
        alias.withColumnRenamed("name", "lhs"), "lhs").select(F.concat_ws(" -> ", "alias", "r").alias("line"))
    from typegram.operators.grammar import stats

    s = stats(p, start="START").first()
    head = [(HEADER, "2"), ("module", module), *dict(metadata or {}).items(), ("productions", str(s.productions)), ("nonterminals", str(s.nonterminals - 1)),
            ("terminals", str(s.terminals)), ("grammar-symbols", str(s.grammar_symbols))]
    heads = spark.createDataFrame([(0, i, f"# {k}: {v}") for i, (k, v) in enumerate(head)], "part int, i long, line string")
    percent = F.concat(F.substring("name", 1, 2), F.replace(F.url_encode(F.expr("substring(name, 3)")), F.lit("+"), F.lit("%20")))
    symbols = alias.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("i"), F.concat(F.lit("# symbol-"), "alias", F.lit(": "), percent).alias("line"))
    return heads.unionByName(symbols).unionByName(rows.distinct().select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("i"), "line"))


def write_fragment(p: DataFrame, path: str, module: str, metadata: Mapping[str, str] | None = None) -> None:
    """One text file; a fragment is small by construction."""
    render(p, module, metadata).orderBy("part", "i", "line").coalesce(1).select("line").write.mode("overwrite").text(path)


def within_budget(production: DataFrame, budget: int) -> DataFrame:
    """Rows that fit a token budget."""
    return production.filter(F.size("rhs") <= budget)


