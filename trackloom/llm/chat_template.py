"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% endif %}``, ``{% for x in xs %}``, ``{% endfor %}``,
``{% set x = expression %}``, ``{% generation %}``, ``{% endgeneration %}`` and
``{# comments #}``.  Expressions have strings, integers, true, false, none, names,
``a.b`` (a key of a mapping, nothing else), ``+``, ``==``, ``!=``, ``in``, ``and``,
``or``, ``not`` and the filters of ``FILTERS``.  There are no calls and no access
to Python attributes.  It is parsed into a tree, constants are folded, and
Python closures are made of the rest; what a generation block writes is under
the loss mask.

``CHAT`` marks each turn.  Its control strings are taken apart inside texts by a
backslash after their first character, backslashes being doubled, so that
texts come back exactly and no text can end its own turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of CHAT.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
CHAT = (
    "{% for turn in turns %}<s>[ROLE]{{ turn.role|escape }}[/ROLE]"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}"
    "{% else %}[INST]{{ turn.text|escape }}[/INST]{% endif %}</s>{% endfor %}"
)
PART = 4_000_000  # characters after which a conversation goes on in a further row

_control = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """What a template may not say."""


_lexer = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+().|]))")
_WORDS = {"true": True, "false": False, "none": None}


def _lex(source: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    at = 0
    source = source.strip()
    while at < len(source):
        m = _lexer.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text[1:-1])))
        elif number is not None:
            out.append(("const", int(number)))
        elif name in _WORDS:
            out.append(("const", _WORDS[name]))
        elif name in ("and", "or", "not", "in"):
            out.append(("sign", name))
        elif name:
            out.append(("name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expressions:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens, self.at = _lex(source), 0

    def sign(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        got = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return got

    def either(self) -> tuple:
        got = self.both()
        while self.sign("or"):
            got = ("or", got, self.both())
        return got

    def both(self) -> tuple:
        got = self.negated()
        while self.sign("and"):
            got = ("and", got, self.negated())
        return got

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.sign("not") else self.compared()

    def compared(self) -> tuple:
        got = self.added()
        while op := self.sign("==", "!=", "in"):
            got = (op, got, self.added())
        return got

    def added(self) -> tuple:
        got = self.filtered()
        while self.sign("+"):
            got = ("+", got, self.filtered())
        return got

    def filtered(self) -> tuple:
        got = self.atom()
        while op := self.sign(".", "|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind != "name":
                raise TemplateError(f"a name has to follow {op!r}")
            self.at += 1
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            got = ("filter", name, got) if op == "|" else ("key", got, name)
        return got

    def atom(self) -> tuple:
        if self.sign("("):
            got = self.either()
            if not self.sign(")"):
                raise TemplateError("a parenthesis is open")
            return got
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("const", "name"):
            self.at += 1
            return self.tokens[self.at - 1]
        raise TemplateError("an expression is missing")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                out.append(("out", _Expressions(piece[2:-2]).whole()))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return out, f"{word} {rest}".strip()
                if word == "if":
                    out.append(conditional(rest))
                elif word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read for {rest!r}")
                    out.append(("for", m[1], _Expressions(m[2]).whole(), block("endfor")[0]))
                elif word == "generation":
                    out.append(("generation", block("endgeneration")[0]))
                elif word == "set":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"cannot read set {rest!r}")
                    out.append(("set", m[1], _Expressions(m[2]).whole()))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            elif piece and not piece.startswith("{#"):
                out.append(("text", piece))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def conditional(condition: str) -> tuple:
        cases = []
        while True:
            body, end = block("elif", "else", "endif")
            cases.append((_Expressions(condition).whole(), body))
            word, _, condition = end.partition(" ")
            if word == "else":
                return ("if", cases, block("endif")[0])
            if word == "endif":
                return ("if", cases, [])

    return block()[0]


def _apply(op: str, a, b):
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return a == b if op == "==" else a != b if op == "!=" else _text(a) in _text(b)


def _text(value) -> str:
    return "" if value is None else str(value)


def fold_expression(e: tuple) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "key":
        return ("key", fold_expression(e[1]), e[2])
    if kind == "filter":
        inner = fold_expression(e[2])
        return ("const", FILTERS[e[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", e[1], inner)
    if kind == "not":
        inner = fold_expression(e[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold_expression(e[1]), fold_expression(e[2])
    if kind in ("and", "or"):
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    return ("const", _apply(kind, a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)


def fold(tree: list[tuple]) -> list[tuple]:
    """The tree with constant expressions evaluated, dead branches gone and texts joined."""
    out: list[tuple] = []
    for node in tree:
        kind = node[0]
        if kind == "out":
            e = fold_expression(node[1])
            found = [("text", _text(e[1]))] if e[0] == "const" else [("out", e)]
        elif kind == "if":
            cases, last = [], fold(node[2])
            for condition, body in node[1]:
                c = fold_expression(condition)
                if c[0] != "const":
                    cases.append((c, fold(body)))
                elif c[1]:
                    last = fold(body)
                    break
            found = [("if", cases, last)] if cases else last
        elif kind == "for":
            found = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif kind == "generation":
            found = [("generation", fold(node[1]))]
        elif kind == "set":
            found = [("set", node[1], fold_expression(node[2]))]
        else:
            found = [node]
        for f in found:
            if f[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + f[1])
            elif f != ("text", ""):
                out.append(f)
    return out


def _value(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "key":

        def key(env, inner=_value(e[1]), k=e[2]):
            found = inner(env)
            if found is not None and not isinstance(found, dict):
                raise TemplateError(f"{k!r} is asked of something that is no mapping")
            return None if found is None else found.get(k)

        return key
    if kind == "filter":
        return lambda env, f=FILTERS[e[1]], inner=_value(e[2]): f(_text(inner(env)))
    if kind == "not":
        return lambda env, inner=_value(e[1]): not inner(env)
    a, b = _value(e[1]), _value(e[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env: _apply(kind, a(env), b(env))


Fragments = Iterator[tuple[str, bool]]


def _block(tree: list[tuple]) -> Callable[[dict, bool], Fragments]:
    steps = [_step(node) for node in tree]

    def run(env: dict, masked: bool) -> Fragments:
        for step in steps:
            yield from step(env, masked)

    return run


def _step(node: tuple) -> Callable[[dict, bool], Iterable[tuple[str, bool]]]:
    kind = node[0]
    if kind == "text":
        return lambda env, masked, s=node[1]: ((s, masked),)
    if kind == "out":
        return lambda env, masked, f=_value(node[1]): ((_text(f(env)), masked),)
    if kind == "generation":
        return lambda env, masked, body=_block(node[1]): body(env, True)
    if kind == "set":

        def assign(env, masked, name=node[1], f=_value(node[2])):
            env[name] = f(env)
            return ()

        return assign
    if kind == "if":
        cases, last = [(_value(c), _block(body)) for c, body in node[1]], _block(node[2])

        def choose(env, masked):
            for condition, body in cases:
                if condition(env):
                    return body(env, masked)
            return last(env, masked)

        return choose
    name, source, body = node[1], _value(node[2]), _block(node[3])

    def loop(env, masked):
        rows = iter(source(env) or ())
        index, now = 0, next(rows, _end)
        while now is not _end:
            after = next(rows, _end)
            index += 1
            yield from body(env | {name: now, "loop": {"index": index, "first": index == 1, "last": after is _end}}, masked)
            now = after

    return loop


_end = object()


def compile_template(source: str) -> Callable[[dict], Fragments]:
    """A function from the context to the text, in fragments (text, whether under the mask).

    Loops read their rows one ahead, so that rows may come from an iterator.
    """
    body = _block(fold(parse(source)))
    return lambda context: body(dict(context), False)


def render(source: str, turns: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and its spans under the loss mask, in code points."""
    out, spans = [], []
    at = 0
    for text, masked in compile_template(source)({"turns": turns}):
        if text and masked:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


_turn = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?))</s>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that CHAT wrote; anything else is an error."""
    at = 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])
        at = m.end()


FORMATTED = "conv_id long, part long, formatted string, mask_from array<long>, mask_to array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(rows: DataFrame, template: str = CHAT, part: int = PART, then: Callable | None = None, schema: str = FORMATTED, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format every conversation, its rows by turn, then role and text.

    Returns (conv_id, part, formatted, mask_from, mask_to): a row for each
    conversation, and further parts, cut between turns, for one of over ``part``
    characters, so that memory is bounded however long a conversation is.  A
    conversation's parts follow each other in one partition.  Mask positions are
    code points within the part.  Null roles and texts are empty; rows without a
    conv_id are one conversation without an id; rows that repeat a turn are turns
    each.  Other columns are not read; an empty table gives an empty one.
    ``then``, from formatted batches to batches of ``schema``, runs in the same
    Python worker, so that formatted texts need not go through another.
    """
    picked = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compile_template(template)
        stream = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
        ready: list[tuple] = []
        held = next(stream, None)
        while held is not None:
            now = held[0]

            between = False

            def turns():
                nonlocal held, between
                while held is not None and held[0] == now:
                    yield held[1]
                    held = next(stream, None)
                    between = True

            out, starts, ends = [], [], []
            at = n = 0
            for s, masked in made({"turns": turns()}):
                if between and at > part:
                    yield _batch([*ready, (now, n, "".join(out), starts, ends)])
                    ready, out, starts, ends, at, n = [], [], [], [], 0, n + 1
                between = False
                if s and masked:
                    starts.append(at)
                    ends.append(at + len(s))
                out.append(s)
                at += len(s)
            while held is not None and held[0] == now:  # turns that the template did not ask for
                held = next(stream, None)
            ready.append((now, n, "".join(out), starts, ends))
            if sum(len(r[2]) for r in ready[-64:]) > part or len(ready) >= 512:
                yield _batch(ready)
                ready = []
        if ready:
            yield _batch(ready)

    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow((lambda b: then(run(b))) if then else run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "part", "formatted", "mask_from", "mask_to"])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests (DIGESTS) of what formatted batches say: turns, and texts under the mask, read part by part."""
    done: list[tuple] = []
    held: list | None = None
    for b in batches:
        for conv, n, text, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
            if n == 0:
                if held:
                    done.append(_digests(held))
                held = [conv, 0, sha256(), 0, sha256(), 0]
            for who, said in read_turns(text):
                held[1] += 1
                held[2].update(f"{who}\n{said}\n".encode())
            for s, e in zip(starts, ends):
                loss = unescape(text[s:e])
                held[3] += len(loss)
                held[4].update(loss.encode())
            held[5] += len(text)
        if len(done) > 1000:
            yield _digest_batch(done)
            done = []
    if held:
        done.append(_digests(held))
    if done:
        yield _digest_batch(done)


def _digests(held: list) -> tuple:
    return (held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
