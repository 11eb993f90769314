"""Host for user-written transforms: contained, not a sandbox against hostile code.

One child interpreter a task (``-I -S``, an empty environment, a scratch folder) reads the
code once and then forks for every document: the fork runs the code from its beginning
under its own limits of CPU time and memory, answers through a pipe of its own and ends.
So nothing that a document leaves behind reaches the next, and results do not depend on
which documents share a task. What the code prints goes nowhere. Amounts travel as strings.

Code that cannot leave anything behind needs no fork: ``leaves_nothing`` reads it and allows
only listed imports, builtins and methods of plain values. The child then runs it from its
beginning for one document after another, a chunk at a time. A chunk that takes longer than one
document may, or meets the memory limit, is given again a document at a time.
"""

from __future__ import annotations

import ast
import builtins
import datetime as dt
import decimal
import json
import os
import select
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .definitions import Definition, changed_fields_expr, coerce_expr, rules_expr
from .results import wire_expr

MAX_SECONDS, DEFAULT_SECONDS, MEMORY = 30, 2.0, 512 * 1024 * 1024

_CHILD = r"""
import datetime, decimal, json, os, resource, sys, traceback
setup = json.loads(sys.stdin.readline())
replies = os.fdopen(os.dup(1), "w")
nowhere = os.open(os.devnull, os.O_RDWR)
def plain(x):
    if isinstance(x, decimal.Decimal):
        return format(x.normalize(), "f")
    if isinstance(x, datetime.datetime):
        return x.date().isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    raise TypeError(f"transform returned a {type(x).__name__}, which is not JSON")
code = []
def answer(data):
    try:
        space = {"__name__": "transform"}
        if not code:
            code.append(compile(setup["source"], "<transform>", "exec"))
        exec(code[0], space)
        out = space["transform"](data)
        if not isinstance(out, dict):
            raise TypeError(f"transform must return a dict, got {type(out).__name__}")
        return {"ok": json.loads(json.dumps(out, default=plain))}
    except BaseException as e:
        rows = [f.lineno for f in traceback.extract_tb(e.__traceback__) if f.filename == "<transform>"]
        return {"error": f"{type(e).__name__}: {e}" + (f" (line {rows[-1]})" if rows else "")}
if setup["shared"]:
    resource.setrlimit(resource.RLIMIT_AS, (setup["memory"], setup["memory"]))
    os.dup2(nowhere, 1)
    for line in sys.stdin:
        asked = json.loads(line)
        given = [answer(json.loads(data)) for data in asked]
        full = any(reply.get("error", "").startswith("MemoryError") for reply in given)
        if not full or len(asked) == 1:
            print(json.dumps([json.dumps(reply) for reply in given]), file=replies, flush=True)
        if full:
            os._exit(0)
for line in sys.stdin:
    take, give = os.pipe()
    pid = os.fork()
    if not pid:
        os.close(take)
        for fd in (0, 1, 2):
            os.dup2(nowhere, fd)
        replies = None
        seconds = int(setup["seconds"]) + 1
        resource.setrlimit(resource.RLIMIT_CPU, (seconds, seconds))
        resource.setrlimit(resource.RLIMIT_AS, (setup["memory"], setup["memory"]))
        try:
            raw = json.dumps(answer(json.loads(line))).encode()
            while raw:
                raw = raw[os.write(give, raw):]
        finally:
            os._exit(0)
    os.close(give)
    print(json.dumps({"pid": pid}), file=replies, flush=True)
    with os.fdopen(take, "rb") as f:
        raw = f.read()
    os.waitpid(pid, 0)
    print(json.dumps({"reply": raw.decode()}), file=replies, flush=True)
"""


def check_source(source: str) -> None:
    """The code must parse and define transform(one argument); it is not run."""
    for node in ast.parse(source).body:
        if isinstance(node, ast.FunctionDef) and node.name == "transform":
            if len(node.args.args) == 1 and not node.args.vararg and not node.args.kwonlyargs:
                return
            raise ValueError("transform takes exactly one argument")
    raise ValueError("the code defines no transform(data)")


#: What code that shares a process may import, call by name, and call on values: nothing that reaches state beyond a document's own.
_IMPORTS = {"decimal": {"Decimal", "InvalidOperation", *(n for n in dir(decimal) if n.startswith("ROUND_"))}, "datetime": {"date", "datetime", "timedelta"}, "math": {"ceil", "floor", "fabs", "isclose", "trunc"}}
_BUILTINS = frozenset("abs all any bool bytes dict divmod enumerate filter float frozenset int isinstance iter len list map max min next pow print range repr reversed round set sorted str sum tuple zip True False None".split())
_BUILTINS |= {n for n, x in vars(builtins).items() if isinstance(x, type) and issubclass(x, Exception)}
_METHODS = frozenset(n for kind in (str, bytes, list, dict, set, tuple, int, float, decimal.Decimal, dt.date, dt.datetime, dt.timedelta) for n in dir(kind) if not n.startswith("_"))
_NODES = (
    ast.Module, ast.FunctionDef, ast.Lambda, ast.arguments, ast.arg, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.NamedExpr, ast.Expr, ast.Pass, ast.Break, ast.Continue, ast.Raise, ast.Assert, ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler,
    ast.ImportFrom, ast.alias, ast.Call, ast.keyword, ast.Name, ast.Attribute, ast.Subscript, ast.Slice, ast.Constant, ast.JoinedStr, ast.FormattedValue, ast.Dict, ast.List, ast.Tuple, ast.Set, ast.Starred, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.comprehension,
    ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop,
)
CHUNK, CHUNK_CHARACTERS = 256, 1 << 20


def leaves_nothing(source: str) -> bool:
    """Whether the code, run again from its beginning, cannot meet anything that an earlier run did. Unknown syntax, names and methods say no."""
    nodes = list(ast.walk(ast.parse(source)))
    own = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.arg for n in nodes if isinstance(n, ast.arg)} | {n.name for n in nodes if isinstance(n, (ast.FunctionDef, ast.ExceptHandler)) and n.name}
    for n in nodes:
        if not isinstance(n, _NODES) or isinstance(n, ast.FunctionDef) and n.decorator_list:
            return False
        if isinstance(n, ast.ImportFrom):
            if n.level or any(a.name not in _IMPORTS.get(n.module, ()) for a in n.names):
                return False
            own |= {a.asname or a.name for a in n.names}
    for n in nodes:
        if isinstance(n, ast.Attribute) and not (isinstance(n.ctx, ast.Load) and n.attr in _METHODS):
            return False
        if isinstance(n, ast.Name) and (not isinstance(n.ctx, (ast.Load, ast.Store)) or n.id not in own | _BUILTINS):
            return False
    return not any(n.startswith("__") for n in own)


class TransformHost:
    """Runs one transform for many answers, each in a process of its own unless the code can leave nothing behind."""

    def __init__(self, source: str, seconds: float = DEFAULT_SECONDS):
        check_source(source)
        self.source, self.seconds, self.child = source, min(seconds, MAX_SECONDS), None
        self.shared = leaves_nothing(source)

    def _start(self) -> None:
        self.scratch = tempfile.TemporaryDirectory()
        self.child = subprocess.Popen([sys.executable, "-I", "-S", "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={}, cwd=self.scratch.name, start_new_session=True)
        self.held = b""
        self._send({"source": self.source, "seconds": self.seconds, "memory": MEMORY, "shared": self.shared})

    def _send(self, message) -> None:
        self.child.stdin.write(json.dumps(message).encode() + b"\n")
        self.child.stdin.flush()

    def _line(self, until: float) -> bytes | None:
        while b"\n" not in self.held:
            if not select.select([self.child.stdout], [], [], max(0.0, until - time.monotonic()))[0]:
                return None
            piece = os.read(self.child.stdout.fileno(), 1 << 16)
            if not piece:
                raise BrokenPipeError
            self.held += piece
        line, _, self.held = self.held.partition(b"\n")
        return line

    def close(self) -> None:
        if self.child is not None:
            try:
                os.killpg(self.child.pid, 9)  # a fork that still runs as well
            except OSError:
                pass
            self.child.communicate()
            self.scratch.cleanup()
            self.child = None

    def run_all(self, answers: list[str]) -> list[str]:
        """JSON replies to JSON answers, in order."""
        if not self.shared:
            return [json.dumps(self.run(json.loads(a))) for a in answers]
        out: list[str] = []
        while len(out) < len(answers):
            size, count = 0, 0
            for a in answers[len(out) : len(out) + CHUNK]:
                size, count = size + len(a), count + 1
                if size > CHUNK_CHARACTERS:
                    break
            chunk = answers[len(out) : len(out) + count]
            # together within the limit of one, or else each by itself
            out += self._together(chunk) or [r for a in chunk for r in self._together([a]) or [json.dumps({"error": self.why})]]
        return out

    def _together(self, chunk: list[str]) -> list[str] | None:
        """Replies of a chunk that ends within the time of one document; else None, ``why`` and no child."""
        try:
            if self.child is None:
                self._start()
                self._send([])
                if self._line(time.monotonic() + MAX_SECONDS) is None:  # it is up: the time starts now
                    raise BrokenPipeError
            self._send(chunk)
            line = self._line(time.monotonic() + self.seconds)
            if line is not None:
                return json.loads(line)
            self.why = f"timed out after {self.seconds:g}s"
        except (OSError, ValueError):
            self.why = "the transform's process ended"
        self.close()
        return None

    def run(self, data: dict) -> dict:
        """{"ok": dict} or {"error": text}."""
        if self.shared:
            return json.loads(self.run_all([json.dumps(data)])[0])
        try:
            if self.child is None:
                self._start()
            self._send(data)
            if self._line(time.monotonic() + MAX_SECONDS) is None:  # the fork's number: its time starts now
                raise BrokenPipeError
            line = self._line(time.monotonic() + self.seconds)
            if line is None:
                self.close()
                return {"error": f"timed out after {self.seconds:g}s"}
            reply = json.loads(line)["reply"]
            return json.loads(reply) if reply else {"error": "the transform's process ended"}
        except (OSError, ValueError, KeyError):
            self.close()
            return {"error": "the transform's process ended"}


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores if a scan gives fewer tasks: a fork a document costs milliseconds, a shuffle of answers little."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(2 * cores)


def transform_expr(source: str, data_json: Column, seconds: float = DEFAULT_SECONDS) -> Column:
    """JSON answers to JSON replies; Arrow-batched, one child a task, one fork a document."""
    check_source(source)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        host = TransformHost(source, seconds)
        try:
            for s in batches:
                given = s.notna()
                out = pd.Series([None] * len(s), index=s.index, dtype=object)
                out[given] = host.run_all(s[given].tolist())
                yield out
        finally:
            host.close()

    return run(data_json)


def process_frame(rows: DataFrame, d: Definition, answer_json: str, source: str, today: dt.date, seconds: float = DEFAULT_SECONDS) -> DataFrame:
    """Adds ``processed``: struct(values, errors, transformed, derived) of an answer put through a user's transform.

    What was read is coerced, goes through the code in its JSON form, and what comes back is
    coerced and checked like an answer. A transform that fails costs no document: the values
    stay what was read, and the reason joins the messages.
    """
    names = rows.columns
    read = dealt(rows).withColumn("read_", coerce_expr(d, F.try_parse_json(answer_json)))
    ran = read.withColumn("reply_", transform_expr(source, wire_expr(d, F.col("read_.values")), seconds))
    error, output = F.get_json_object("reply_", "$.error"), F.get_json_object("reply_", "$.ok")
    made = ran.withColumns({"error_": error, "output_": output}).withColumn("made_", coerce_expr(d, F.try_parse_json("output_")))
    values = F.when(F.col("error_").isNull(), F.col("made_.values")).otherwise(F.col("read_.values"))
    made = made.withColumn("values_", values)
    shape, checked = F.col("read_.errors"), rules_expr(d, F.col("values_"), today)
    returned = F.transform("made_.errors", lambda e: F.concat(F.lit("transform returned "), e))
    failed = F.concat(shape, checked, F.array(F.concat(F.lit("transform failed: "), F.col("error_"))))
    none = F.array().cast("array<string>")
    processed = F.struct(
        F.col("values_").alias("values"), F.when(F.col("error_").isNull(), F.concat(shape, returned, checked)).otherwise(failed).alias("errors"), F.col("output_").alias("transformed"),
        F.when(F.col("error_").isNull(), changed_fields_expr(d, F.col("read_.values"), F.col("values_"))).otherwise(none).alias("derived"),
    )
    return made.select(*names, processed.alias("processed"))


def check_examples(source: str, examples: list[tuple[dict, dict]], seconds: float = DEFAULT_SECONDS) -> list[str]:
    """Driver-side: what is wrong with each (input, expected) example."""
    host = TransformHost(source, seconds)
    problems = []
    try:
        for k, (given, expected) in enumerate(examples):
            reply = host.run(given)
            if "error" in reply:
                problems.append(f"example {k}: {reply['error']}")
            else:
                problems += [f"example {k}: {n} is {reply['ok'].get(n)!r}, not {v!r}" for n, v in expected.items() if reply["ok"].get(n) != v]
    finally:
        host.close()
    return problems
