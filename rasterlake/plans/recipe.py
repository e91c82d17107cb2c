"""Recipes: named steps with parameters and expressions, run as a graph of lazy DataFrames over a cache.

The planner (parsing, products of ``for_each`` lists, the graph, keys) works on the recipe's text, which
is small, on the driver; the steps it runs are DataFrame operators, and their results are Parquet tables
under ``key=<digest>``. A step whose key is there is read, not run, so a warm run executes nothing.

Expressions: numbers, strings, variables, unary minus, ``+ - * / %``, comparisons, ``a ? b : c`` and
calls of predicates. Strings join with ``+`` to anything; whole numbers divide to whole numbers (towards
zero, ``%`` keeps the sign); conditions must be booleans; ``&&``, ``||`` and ``!`` are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|&&|\|\||[-+*/%<>?:,()!]))")
_RANK = {"==": 1, "!=": 1, "<": 1, "<=": 1, ">": 1, ">=": 1, "+": 2, "-": 2, "*": 3, "/": 3, "%": 3}


class RecipeError(ValueError):
    pass


def _lex(src: str) -> list[tuple[str, str]]:
    out, at = [], 0
    src = src.rstrip()
    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise RecipeError(f"unexpected character at {at} in {src!r}")
        kind = m.lastgroup
        if m[kind] in ("&&", "||", "!"):
            raise RecipeError(f"{m[kind]} is not part of expressions; use a ? b : c")
        out.append((kind, m[kind]))
        at = m.end()
    return [*out, ("end", "")]


def parse(src: str) -> tuple:
    """The expression as nested tuples."""
    toks, at = _lex(src), 0

    def take(value: str | None = None):
        nonlocal at
        if value is not None and toks[at][1] != value:
            raise RecipeError(f"expected {value!r} in {src!r}, found {toks[at][1]!r}")
        at += 1
        return toks[at - 1]

    def operand():
        kind, v = take()
        if kind == "num":
            return ("lit", float(v) if "." in v else int(v))
        if kind == "str":
            return ("lit", v[1:-1])
        if v == "-":
            return ("neg", operand())
        if v == "(":
            inner = ternary()
            take(")")
            return inner
        if kind == "name":
            if v in ("true", "false"):
                return ("lit", v == "true")
            if toks[at][1] != "(":
                return ("var", v)
            take("(")
            args = []
            while toks[at][1] != ")":
                args.append(ternary())
                if toks[at][1] == ",":
                    take()
            take(")")
            return ("call", v, args)
        raise RecipeError(f"unexpected {v!r} in {src!r}")

    def climb(least: int):
        left = operand()
        while _RANK.get(toks[at][1], 0) >= least:
            op = take()[1]
            left = ("bin", op, left, climb(_RANK[op] + 1))
        return left

    def ternary():
        cond = climb(1)
        if toks[at][1] != "?":
            return cond
        take("?")
        yes = ternary()
        take(":")
        return ("if", cond, yes, ternary())

    out = ternary()
    if toks[at][0] != "end":
        raise RecipeError(f"{toks[at][1]!r} is left over in {src!r}")
    return out


def _arith(op: str, a, b):
    if isinstance(a, str) or isinstance(b, str):
        if op != "+":
            raise RecipeError(f"{op} doesn't work on strings")
        return show(a) + show(b)
    if isinstance(a, bool) or isinstance(b, bool):
        raise RecipeError(f"{op} doesn't work on booleans")
    if op in "/%" and b == 0:
        raise RecipeError("division by zero")
    if op == "/":
        if isinstance(a, int) and isinstance(b, int):
            return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return a / b
    if op == "%":
        r = abs(a) % abs(b)
        return -r if a < 0 else r
    return a + b if op == "+" else a - b if op == "-" else a * b


def show(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def evaluate(e: tuple, env: dict, predicates: dict[str, Callable] | None = None):
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "var":
        if e[1] not in env:
            raise RecipeError(f"unknown name {e[1]!r}")
        return env[e[1]]
    if kind == "neg":
        v = evaluate(e[1], env, predicates)
        if isinstance(v, (bool, str)):
            raise RecipeError("minus needs a number")
        return -v
    if kind == "if":
        c = evaluate(e[1], env, predicates)
        if not isinstance(c, bool):
            raise RecipeError("a condition must be a boolean")
        return evaluate(e[2] if c else e[3], env, predicates)
    if kind == "call":
        if e[1] not in (predicates or {}):
            raise RecipeError(f"unknown predicate {e[1]!r}")
        return predicates[e[1]](*[evaluate(a, env, predicates) for a in e[2]])
    op, a, b = e[1], evaluate(e[2], env, predicates), evaluate(e[3], env, predicates)
    if op in ("==", "!="):
        return (a == b) == (op == "==")
    if op in ("<", "<=", ">", ">="):
        if isinstance(a, str) != isinstance(b, str):
            raise RecipeError(f"{op} needs two of a kind")
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return _arith(op, a, b)


def to_column(e: tuple, kinds: dict[str, str]) -> Column:
    """The expression over columns; kinds: each name's type (int, float, str, bool)."""

    def kind_of(x) -> str:
        if x[0] == "lit":
            return {bool: "bool", int: "int", float: "float", str: "str"}[type(x[1])]
        if x[0] == "var":
            return kinds[x[1]]
        if x[0] == "neg":
            return kind_of(x[1])
        if x[0] == "if":
            return kind_of(x[2])
        if x[1] in ("+", "-", "*", "/", "%"):
            k = {kind_of(x[2]), kind_of(x[3])}
            return "str" if "str" in k else "float" if "float" in k else "int"
        return "bool"

    def col(x) -> Column:
        if x[0] == "lit":
            return F.lit(x[1])
        if x[0] == "var":
            return F.col(x[1])
        if x[0] == "neg":
            return -col(x[1])
        if x[0] == "if":
            return F.when(col(x[1]), col(x[2])).otherwise(col(x[3]))
        if x[0] == "call":
            raise RecipeError("predicates run on whole results, not on rows")
        op, a, b = x[1], col(x[2]), col(x[3])
        if op == "+" and kind_of(x) == "str":
            return F.concat(a.cast("string"), b.cast("string"))
        if op == "/" and kind_of(x) == "int":
            return F.when(b != 0, (F.abs(a) - F.abs(a) % F.abs(b)) / F.abs(b) * F.signum(a) * F.signum(b)).otherwise(F.raise_error(F.lit("division by zero"))).cast("long")
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b, "==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    return col(e)


def fill(template: str, env: dict, predicates=None) -> str:
    """``${expression}`` parts of a string replaced by their values."""
    return re.sub(r"\$\{([^}]*)\}", lambda m: show(evaluate(parse(m[1]), env, predicates)), template)


@dataclass
class Step:
    name: str
    op: str
    inputs: list[str]
    output: str
    params: dict = field(default_factory=dict)


def resolve(recipe: dict, predicates=None) -> list[Step]:
    """Every step for every combination of its ``for_each`` lists (names in order, values in order)."""
    if recipe.get("format") != VERSION:
        raise RecipeError(f"format must be {VERSION}")
    base = recipe.get("vars", {})
    out: list[Step] = []
    for raw in recipe.get("step", []):
        unknown = set(raw) - {"name", "op", "inputs", "output", "params", "for_each", "when"}
        if unknown:
            raise RecipeError(f"unknown fields {sorted(unknown)}")
        lists = raw.get("for_each", {})
        for values in itertools.product(*(base[lists[k]] if isinstance(lists[k], str) else lists[k] for k in sorted(lists))):
            env = {**base, **dict(zip(sorted(lists), values))}
            if "when" in raw and evaluate(parse(raw["when"]), env, predicates) is not True:
                continue
            params = {k: evaluate(parse(v[1:]), env, predicates) if isinstance(v, str) and v.startswith("=") else fill(v, env, predicates) if isinstance(v, str) else v for k, v in raw.get("params", {}).items()}
            out.append(Step(fill(raw["name"], env, predicates), raw["op"], [fill(i, env, predicates) for i in raw.get("inputs", [])], fill(raw["output"], env, predicates), params))
    twice = [o for o in {s.output for s in out} if sum(s.output == o for s in out) > 1]
    if twice:
        raise RecipeError(f"outputs made twice: {sorted(twice)}")
    return out


class Graph:
    def __init__(self, steps: list[Step], sources: set[str]):
        self.steps = steps
        made = {s.output: i for i, s in enumerate(steps)}
        self.deps: list[set[int]] = []
        for i, s in enumerate(steps):
            missing = [x for x in s.inputs if x not in made and x not in sources]
            if missing:
                raise RecipeError(f"{s.name}: no such input {missing}")
            if s.output in s.inputs:
                raise RecipeError(f"{s.name} reads its own output")
            self.deps.append({made[x] for x in s.inputs if x in made})
        self.order = self._order()

    def _order(self) -> list[int]:
        """Dependencies first; of steps that are ready, the first as written."""
        waiting = [len(d) for d in self.deps]
        users: list[list[int]] = [[] for _ in self.steps]
        for i, d in enumerate(self.deps):
            for j in d:
                users[j].append(i)
        ready = [i for i, n in enumerate(waiting) if not n]
        heapq.heapify(ready)
        out = []
        while ready:
            i = heapq.heappop(ready)
            out.append(i)
            for u in users[i]:
                waiting[u] -= 1
                if not waiting[u]:
                    heapq.heappush(ready, u)
        if len(out) < len(self.steps):
            raise RecipeError(f"a cycle holds {sorted(self.steps[i].name for i in range(len(self.steps)) if i not in out)}")
        return out

    def levels(self) -> list[int]:
        level = [0] * len(self.steps)
        for i in self.order:
            level[i] = max((level[j] + 1 for j in self.deps[i]), default=0)
        return level

    def ancestry(self, i: int) -> set[int]:
        out, todo = set(), set(self.deps[i])
        while todo:
            j = todo.pop()
            if j not in out:
                out.add(j)
                todo |= self.deps[j]
        return out

    def sinks(self) -> list[int]:
        used = set().union(*self.deps) if self.deps else set()
        return [i for i in range(len(self.steps)) if i not in used]


def keys(graph: Graph, source_digest: Callable[[str], str]) -> list[str]:
    """A digest of each step: its operator, parameters, output, version, and its inputs' digests."""
    out: dict[int, str] = {}
    made = {s.output: i for i, s in enumerate(graph.steps)}
    for i in graph.order:
        s = graph.steps[i]
        ins = [out[made[x]] if x in made else source_digest(x) for x in s.inputs]
        out[i] = hashlib.sha256("\0".join([str(VERSION), s.op, json.dumps(s.params, sort_keys=True), s.output, *ins]).encode()).hexdigest()
    return [out[i] for i in range(len(graph.steps))]


class Cache:
    """Step results by key, in any storage that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, key: str) -> str:
        return f"{self.root}/key={key}"

    def holds(self, key: str) -> bool:
        """Only whole results count: the writer's mark is there."""
        return self._fs.exists(self._path(f"{self.at(key)}/_SUCCESS"))

    def store(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(key))
        return self.read(key)

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.at(key))

    def gc(self, keep: set[str]) -> int:
        if not self._fs.exists(self._path(self.root)):
            return 0
        gone = [s.getPath() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().removeprefix("key=") not in keep]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def source_digest(df: DataFrame) -> str:
    """Of a table's schema and rows, whatever their order: their number and two sums of row hashes, by one aggregation."""
    row = [F.col(f"`{c}`") for c in df.columns]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), total("a"), total("b")).first()
    return hashlib.sha256(f"{df.schema.json()}|{n}|{a}|{b}".encode()).hexdigest()


def run(recipe: dict | str, operators: dict[str, Callable], sources: dict[str, DataFrame], cache: Cache, digests: dict[str, str] | None = None, predicates=None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Results by output name, and counts of steps run and found; operators take (inputs, params).

    A source is known by its digest: the one given, or else one of its content (``source_digest``).
    """
    steps = resolve(tomllib.loads(recipe) if isinstance(recipe, str) else recipe, predicates)
    graph = Graph(steps, set(sources))
    known = {n: (digests or {}).get(n) or source_digest(df) for n, df in sources.items()}
    digest = known.__getitem__
    have, count = dict(sources), {"run": 0, "found": 0}
    key = keys(graph, digest)
    for i in graph.order:
        s = steps[i]
        if s.op not in operators:
            raise RecipeError(f"{s.name}: no operator {s.op!r}")
        if cache.holds(key[i]):
            have[s.output] = cache.read(key[i])
            count["found"] += 1
        else:
            have[s.output] = cache.store(key[i], operators[s.op]([have[x] for x in s.inputs], s.params))
            count["run"] += 1
    return {s.output: have[s.output] for s in steps}, count


def expand(template: dict, rows: DataFrame | list[dict]) -> list[dict]:
    """A step template for each row of data (not a product): ``{column}`` parts become the row's values."""
    rows = [r.asDict() for r in rows.collect()] if isinstance(rows, DataFrame) else rows
    put = lambda v, r: re.sub(r"\{(\w+)\}", lambda m: "" if r.get(m[1]) is None else str(r[m[1]]), v) if isinstance(v, str) else [put(x, r) for x in v] if isinstance(v, list) else {k: put(x, r) for k, x in v.items()} if isinstance(v, dict) else v
    return [put(template, r) for r in rows]
