"""Source trees and the facts in Python files."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20
# Folders that are no source.
IGNORED = (".agents", ".aws", ".config", ".git", ".ssh", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", "site-packages")


def read_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, length, content, status): files under ``root``, of whose own folders none is ignored; too large ones keep a row without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    below = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    ignored = F.exists(F.split(below, "/"), lambda s: s.isin(*IGNORED))
    good = F.col("length") <= MOST_BYTES
    return files.filter(~ignored).select("path", "length", F.when(good, F.col("content")).alias("content"), F.when(good, "ok").otherwise("source_read_failed").alias("status"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as a shuffle has, whatever their bytes: parsing what they stand for costs far more than reading them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


FACTS = "path string, kind string, name string, parent string, target string, line int, ordinal int"


def python_facts(files: DataFrame) -> DataFrame:
    """(path, text) to definitions, decorators, imports, calls, urls, router registrations and models with their place; a file that cannot be parsed gives one ``unsupported_syntax`` row.

    A fact's parent is the function or class around it, a decorator's the definition that it
    decorates. Strings given to decorators are JSON in the target, keyed by argument (``args``
    for positions). A registration's parent is its router. Resolution of names is left to joins.
    """

    def strings(node: ast.expr) -> list[str] | str | bool | None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str | bool):
            return node.value
        items = node.elts if isinstance(node, ast.List | ast.Tuple | ast.Set) else []
        return [e.value for e in items if isinstance(e, ast.Constant) and isinstance(e.value, str)]

    def given(node: ast.expr) -> str | None:
        if not isinstance(node, ast.Call):
            return None
        values = map(strings, node.args)
        flat = [s for v in values for s in (v if isinstance(v, list) else [v]) if isinstance(s, str)]
        return json.dumps({"args": flat} | {k.arg: strings(k.value) for k in node.keywords if k.arg})

    def registered(call: ast.Call) -> tuple[str, str] | None:
        named = {k.arg: k.value for k in call.keywords}
        prefix = call.args[0] if call.args else named.get("prefix")
        view = call.args[1] if len(call.args) > 1 else named.get("viewset", named.get("view"))
        return (prefix.value, ast.unparse(view)) if view is not None and isinstance(prefix, ast.Constant) and isinstance(prefix.value, str) else None

    def facts(path: str, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            yield path, "unsupported_syntax", None, None, None, None, 0
            return
        n = 0
        todo = [(node, "") for node in reversed(tree.body)]
        while todo:
            node, parent = todo.pop()
            line, inside = getattr(node, "lineno", None), parent
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                inside = f"{parent}.{node.name}".lstrip(".")
                bases = [ast.unparse(b) for b in node.bases] if isinstance(node, ast.ClassDef) else []
                kind = "model" if any(b in ("models.Model", "Model") for b in bases) else "class" if isinstance(node, ast.ClassDef) else "function"
                yield path, kind, inside, parent or None, ",".join(bases) or None, line, n
                n += 1
                for d in node.decorator_list:
                    yield path, "decorator", ast.unparse(d.func if isinstance(d, ast.Call) else d), inside, given(d), line, n
                    n += 1
            elif isinstance(node, ast.Import):
                for a in node.names:
                    yield path, "import", a.asname or a.name, parent or None, a.name, line, n
                    n += 1
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    yield path, "import", a.asname or a.name, parent or None, f"{'.' * node.level}{node.module or ''}:{a.name}", line, n
                    n += 1
            elif isinstance(node, ast.Call):
                name = ast.unparse(node.func)
                if name in ("path", "re_path") and len(node.args) >= 2 and isinstance(node.args[0], ast.Constant):
                    yield path, "url", str(node.args[0].value), parent or None, ast.unparse(node.args[1]), line, n
                elif isinstance(node.func, ast.Attribute) and node.func.attr == "register" and isinstance(node.func.value, ast.Name) and (r := registered(node)):
                    yield path, "register", r[0], node.func.value.id, r[1], line, n
                elif ".objects." in name:
                    yield path, "query", name.rpartition(".")[2], parent or None, name.partition(".objects.")[0], line, n
                else:
                    yield path, "call", name, parent or None, None, line, n
                n += 1
            todo.extend((child, inside) for child in reversed(list(ast.iter_child_nodes(node))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [f for p, t in zip(batch["path"], batch["text"], strict=True) for f in facts(p, t or "")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.select("path", "text").mapInPandas(rows, FACTS)


def resolved_imports(facts: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports with their module's only path; (path, name, target, module_path, outcome) by candidate count.

    ``modules`` has (module, path): several paths of one module leave it ambiguous.
    """
    known = modules.groupBy("module").agg(F.countDistinct("path").alias("n"), F.min("path").alias("module_path"))
    imports = facts.filter("kind = 'import'").withColumn("module", F.substring_index("target", ":", 1))
    n = F.coalesce(F.col("n"), F.lit(0))
    outcome = F.when(n == 1, "exact").when(n == 0, "unresolved").otherwise("ambiguous")
    return imports.join(known, "module", "left").select("path", "name", "target", F.when(n == 1, F.col("module_path")).alias("module_path"), outcome.alias("outcome"))
