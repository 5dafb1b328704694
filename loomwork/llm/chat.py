"""Chat formatting with a compiled template.

The template language has text, {{ expression }}, {# comment #} and the tags for, if/elif/else, set and generation.
Expressions have names, string and integer literals, lists, .key and [index], + ~ == != < <= > >= in, not, and, or, and
filters. There is no call, no attribute of a Python object and no import: a name reads the context, .key reads a mapping.
A template is parsed to a tree, constants are folded and neighbouring text is joined, and the tree becomes Python closures
that write to a sink, which also keeps the spans written inside generation blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, table

#: Control strings of TEMPLATE, and the character that precedes one, or itself, inside a text.
CONTROLS, ESCAPE = ("<turn>", "<text>", "</turn>"), "\\"
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | escape }}<text>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: A formatted conversation longer than this becomes several rows, cut between turns.
PIECE_CHARS = 1 << 20
FORMATTED = "conv_id long, piece int, text string, generated array<struct<start:long,stop:long>>"

_CONTROL = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_READ = re.compile("(?s)" + re.escape(ESCAPE) + ".|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile("(?s)" + re.escape(ESCAPE) + "(.)")


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}

# ---------------------------------------------------------------- parsing: nodes are tuples (kind, ...)

_TAG = re.compile(r"(?s)\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}")
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.,()\[\]]))""")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = next(k for k, x in zip(("int", "str", "name", "op"), m.groups(), strict=True) if x is not None)
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else None

    def take(self, *wanted: str) -> str | None:
        if (x := self.peek()) in wanted:
            self.at += 1
            return x
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.sum()
        while op := self.take(*_COMPARE):
            node = ("compare", op, node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("add" if op == "+" else "join", node, self.filtered())
        return node

    def filtered(self):
        node = self.item()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def item(self):
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, x = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            node = ("const", int(x))
        elif kind == "str":
            node = ("const", re.sub(r"(?s)\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), x[1:-1]))
        elif kind == "name":
            node = ("const", {"true": True, "false": False, "none": None}[x]) if x in ("true", "false", "none") else ("name", x)
        elif x == "(":
            node = self.either()
            self.need(")")
        elif x == "[":
            parts = []
            while not self.take("]"):
                parts.append(self.either())
                if self.peek() != "]":
                    self.need(",")
            node = ("list", parts)
        elif x == "-" and self.at < len(self.tokens) and self.tokens[self.at][0] == "int":
            node = ("const", -int(self.tokens[self.at][1]))
            self.at += 1
        else:
            raise TemplateError(f"unexpected {x!r}")
        while op := self.take(".", "["):
            if op == ".":
                node = ("get", node, ("const", self.name()))
            else:
                node = ("get", node, self.either())
                self.need("]")
        return node


def parse(source: str) -> list:
    """The tree of a template: a list of nodes."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("print", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    i = 0

    def body(*stops: str) -> tuple[list, str, str]:
        nonlocal i
        nodes = []
        while i < len(pieces):
            kind, x = pieces[i]
            i += 1
            if kind == "text":
                nodes.append(("text", x))
            elif kind == "print":
                nodes.append(("print", _Expression(x).whole()))
            else:
                word, _, rest = x.partition(" ")
                if word in stops:
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError("for NAME in EXPRESSION expected")
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
                elif word == "if":
                    cases, test = [], _Expression(rest).whole()
                    while True:
                        inner, stop, more = body("elif", "else", "endif")
                        cases.append((test, inner))
                        if stop == "endif":
                            nodes.append(("if", cases, []))
                            break
                        if stop == "else":
                            nodes.append(("if", cases, body("endif")[0]))
                            break
                        test = _Expression(more).whole()
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError("set NAME = EXPRESSION expected")
                    nodes.append(("set", name.strip(), _Expression(value).whole()))
                elif word == "generation":
                    nodes.append(("generation", body("endgeneration")[0]))
                else:
                    raise TemplateError(f"no tag {word!r} here")
        if stops:
            raise TemplateError(f"{stops[-1]} is missing")
        return nodes, "", ""

    return body()[0]


# ---------------------------------------------------------------- folding

def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "list":
        parts = [fold_expression(x) for x in node[1]]
        return ("const", [x[1] for x in parts]) if all(x[0] == "const" for x in parts) else ("list", parts)
    folded = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in node)
    if kind in ("and", "or") and folded[1][0] == "const":
        return folded[2] if bool(folded[1][1]) == (kind == "and") else folded[1]
    if all(x[0] == "const" for x in folded[1:] if isinstance(x, tuple)):
        return ("const", expression(folded)({}))
    return folded


def fold(nodes: list) -> list:
    """Constant expressions become values, printed constants text, constant tests their branch, neighbouring texts one."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text":
            if node[1] and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node[1]:
                out.append(node)
        else:
            out.append(node)

    for node in nodes:
        if node[0] == "print":
            e = fold_expression(node[1])
            add(("text", _show(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "if":
            cases, other = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] == "const":
                    if test[1]:
                        other = fold(inner)
                        break
                    continue
                cases.append((test, fold(inner)))
            for x in [("if", cases, other)] if cases else other:
                add(x)
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        else:
            add(node)
    return out


# ---------------------------------------------------------------- closures

def _show(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _get(x, key):
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, str)) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return None


def expression(node: tuple) -> Callable:
    kind = node[0]
    if kind == "const":
        return lambda c, v=node[1]: v
    if kind == "name":
        return lambda c, k=node[1]: c.get(k)
    if kind == "list":
        parts = [expression(x) for x in node[1]]
        return lambda c: [p(c) for p in parts]
    if kind == "not":
        a = expression(node[1])
        return lambda c: not a(c)
    if kind == "compare":
        f, a, b = _COMPARE[node[1]], expression(node[2]), expression(node[3])
        return lambda c: f(a(c), b(c))
    if kind == "filter":
        f, a = FILTERS[node[1]], expression(node[2])
        return lambda c: f("" if (x := a(c)) is None else x)
    a, b = expression(node[1]), expression(node[2])
    if kind == "get":
        return lambda c: _get(a(c), b(c))
    if kind == "and":
        return lambda c: a(c) and b(c)
    if kind == "or":
        return lambda c: a(c) or b(c)
    if kind == "add":
        return lambda c: a(c) + b(c)
    return lambda c: _show(a(c)) + _show(b(c))  # join


class Sink:
    """Collects text and the spans of generation blocks; full() tells after each turn whether to hand it on."""

    def __init__(self):
        self.parts: list[str] = []
        self.size, self.spans = 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def result(self) -> tuple[str, list[tuple[int, int]]]:
        return "".join(self.parts), self.spans


def _closure(nodes: list) -> Callable:
    """A generator function (context, sink): it writes, and yields after each round of an outermost loop."""
    steps = [_step(n) for n in nodes]

    def run(c: dict, sink: Sink) -> Iterator[None]:
        for s in steps:
            yield from s(c, sink)

    return run


def _step(node: tuple) -> Callable:
    kind = node[0]
    if kind == "text":

        def text(c, sink, t=node[1]):
            sink.write(t)
            return ()

        return text
    if kind == "print":

        def show(c, sink, e=expression(node[1])):
            sink.write(_show(e(c)))
            return ()

        return show
    if kind == "set":

        def put(c, sink, k=node[1], e=expression(node[2])):
            c[k] = e(c)
            return ()

        return put
    if kind == "if":
        cases, other = [(expression(t), _closure(b)) for t, b in node[1]], _closure(node[2])

        def choose(c, sink):
            for test, inner in cases:
                if test(c):
                    return inner(c, sink)
            return other(c, sink)

        return choose
    if kind == "generation":
        inner = _closure(node[1])

        def generate(c, sink):
            start = sink.size
            for _ in inner(c, sink):
                pass  # a block stays in one piece
            sink.spans.append((start, sink.size))
            return ()

        return generate
    name, of, inner = node[1], expression(node[2]), _closure(node[3])

    def loop(c, sink):
        for x in of(c) or ():
            c[name] = x
            for _ in inner(c, sink):
                pass
            yield

    return loop


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _closure(self.tree)

    def pieces(self, context: dict, most: int = PIECE_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, generation spans in it) of consecutive pieces, each cut after a loop's round once it has most characters."""
        sink, any_ = Sink(), False
        for _ in self._run(dict(context), sink):
            if sink.size >= most:
                any_ = True
                yield sink.result()
                sink.__init__()
        if sink.size or sink.spans or not any_:
            yield sink.result()

    def render(self, context: dict) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its generation spans, in code points."""
        return next(self.pieces(context, most=1 << 62))


# ---------------------------------------------------------------- Spark

def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, text, generated) from rows (conv_id, turn, role, text): a conversation's turns in order of turn (null first;
    ties by role and text) go through the template as messages. Turns are streamed: a task holds one piece, however long the
    conversation. Null roles and texts are empty; a null conv_id is a conversation of its own. Pieces of a conversation are
    consecutive rows of one partition. Other columns are left out."""
    Template(template)  # errors show here
    some = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = some.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        compiled = Template(template)
        stream = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(x.to_pylist() for x in b.columns), strict=True))
        ahead = next(stream, None)
        out: list[tuple] = []
        size = 0
        while ahead is not None:
            conv = ahead[0]

            def turns(conv=conv):
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    message = ahead[1]
                    ahead = next(stream, None)
                    yield message

            messages = turns()
            for k, (text, spans) in enumerate(compiled.pieces({"messages": messages})):
                out.append((conv, k, text, [{"start": a, "stop": b} for a, b in spans]))
                size += len(text)
                if size >= 4 * PIECE_CHARS:
                    yield _batch(out)
                    out, size = [], 0
            for _ in messages:  # a template need not read them all
                pass
        if out:
            yield _batch(out)

    return arrow_map(ordered, run, FORMATTED)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = (pa.int64(), pa.int32(), pa.string(), span)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "piece", "text", "generated"])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a text that TEMPLATE made."""
    turns, role, start = [], "", 0
    for m in _READ.finditer(formatted):
        x = m[0]
        if x == "<turn>":
            start = m.end()
        elif x == "<text>":
            role, start = unescape(formatted[start : m.start()]), m.end()
        elif x == "</turn>":
            turns.append((role, unescape(formatted[start : m.start()])))
    return turns


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted pieces: the digests of its turns and of its loss mask."""

    def run(batches):
        held, out = None, []
        for batch in batches:
            for conv, piece, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0:
                    if held:
                        out.append(held)
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    held[1] += 1
                    held[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    loss = unescape(text[s["start"] : s["stop"]])
                    held[3] += len(loss)
                    held[4].update(loss.encode())
                held[5] += len(text)
            if out:
                yield _digests(out)
                out = []
        if held:
            yield _digests([held])

    return arrow_map(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list) -> pa.RecordBatch:
    cols = list(zip(*[(c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in rows], strict=True))
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


#: Fixed by the contract: a conversation whose texts hold control strings.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return digest_formatted(format_conversations(rows.unionByName(more)))


OP3_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '<text>', '\<text>'), '</turn>', '\</turn>') AS te,
             replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '<text>', '\<text>'), '</turn>', '\</turn>') AS re FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(te) + length(re) + 20)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
