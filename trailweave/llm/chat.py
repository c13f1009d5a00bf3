"""Chat formatting of tables whose layout is told by a fingerprint of their schema.

The nested field paths of a table, hashed, select a declarative mapping: SQL expressions
that turn a layout of prompts, instructions or messages into canonical turns.  A template
marks the turns, and strings that could be taken for its marks are escaped reversibly.
Only DataFrame operations are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN, CLOSE, END = "### ", ": ", " </turn>\n"
# Every backslash of an escaped text belongs to one of these, so they are undone one by one.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
# A role that has no name of its own stands after this, with its colons escaped as well.
OTHER, COLON = "\\r", (":", "\\c")


def paths(schema: T.StructType) -> list[str]:
    """The nested field paths of a schema, ``[]`` for elements of arrays, in order."""
    found: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        else:
            found.append(path)

    walk(schema, "")
    return sorted(found)


def fingerprint(fields: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


_TURN = "named_struct('turn', CAST({} AS BIGINT), 'role', '{}', 'text', {})"
_PROMPT = "array(" + _TURN.format(0, "user", "{}") + ", " + _TURN.format(1, "assistant", "{}") + ")"
_MESSAGES = "transform({0}, (m, i) -> named_struct('turn', CAST(i AS BIGINT), 'role', {1}, 'text', {2}))"
_SHARE = "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END"

#: Field paths of each layout (besides conv_id) and the expression of its turns; None: one row a turn.
LAYOUTS: dict[str, tuple[list[str], str | None]] = {
    "rows": (["turn", "role", "text"], None),
    "prompt": (["prompt", "response"], _PROMPT.format("prompt", "response")),
    "completion": (["prompt", "completion"], _PROMPT.format("prompt", "completion")),
    "instruction": (["instruction", "output"], _PROMPT.format("instruction", "output")),
    "instruction_input": (
        ["instruction", "input", "output"], _PROMPT.format("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output"),
    ),
    "messages": (["messages[].role", "messages[].content"], _MESSAGES.format("messages", "m.role", "m.content")),
    "conversations": (["conversations[].from", "conversations[].value"], _MESSAGES.format("conversations", _SHARE, "m.value")),
}
MAPPINGS = {fingerprint(fields): (name, turns) for name, (fields, turns) in LAYOUTS.items()}


def layout(df: DataFrame) -> tuple[str, str | None]:
    """The mapping of a table: by all its fields, or by those that some layout knows."""
    own = [p for p in paths(df.schema) if p != "conv_id"]
    if found := MAPPINGS.get(fingerprint(own)):
        return found
    known = [(f, n, t) for n, (f, t) in LAYOUTS.items() if set(f) <= set(own)]
    if not known:
        raise ValueError(f"no layout for the fields {own}")
    _, name, turns = max(known, key=lambda x: (len(x[0]), x[1]))
    return name, turns


def canonical(df: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` with turns ``(turn, role, text)`` in order, from any known layout.

    Null texts become empty and null roles ``user``; any other role is kept as it is, and
    only ``assistant`` is trained on.  Turns are ordered by number, then
    role and text, null numbers first.  Rows of one conversation are gathered in one row,
    as its format demands; rows without a ``conv_id`` are one conversation.
    """
    _, turns = layout(df)
    if turns is None:
        one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
        gathered = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    else:
        gathered = df.select("conv_id", F.expr(turns).alias("turns"))
    filled = """transform(coalesce(turns, array()), t -> named_struct('turn', t.turn,
        'role', coalesce(t.role, 'user'), 'text', coalesce(t.text, '')))"""
    return gathered.select("conv_id", F.expr(filled).alias("turns"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escaped(text: str) -> str:
    """SQL of the escaped form of a text expression."""
    for plain, mark in ESCAPES:
        text = f"replace({text}, {_literal(plain)}, {_literal(mark)})"
    return text


def unescaped(text: str) -> str:
    for plain, mark in reversed(ESCAPES):
        text = f"replace({text}, {_literal(mark)}, {_literal(plain)})"
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_mask)``; the mask lists ``(start, length)`` of assistant texts.

    Positions count from 1 in code points of ``formatted``.
    """
    names = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in ROLES.items())
    other = f"concat({_literal(OTHER)}, replace({escaped('t.role')}, {_literal(COLON[0])}, {_literal(COLON[1])}))"
    head = f"concat({_literal(OPEN)}, CASE t.role {names} ELSE {other} END, {_literal(CLOSE)})"
    pieces = turns.selectExpr(
        "conv_id",
        f"transform(turns, t -> named_struct('head', {head}, 'body', {escaped('t.text')}, 'loss', t.role = 'assistant')) AS p",
    )
    # Lengths first; starts are running sums over them.
    sized = pieces.selectExpr(
        "conv_id", "p", "transform(p, x -> length(x.head)) AS heads", "transform(p, x -> length(x.body)) AS bodies"
    )
    starts = sized.selectExpr(
        "conv_id", "p", "heads", "bodies",
        f"""aggregate(sequence(1, size(p)), array(1), (s, i) -> IF(i > size(p), s,
            concat(s, array(element_at(s, -1) + heads[i - 1] + bodies[i - 1] + {len(END)})))) AS starts""",
    )
    return starts.selectExpr(
        "conv_id",
        f"array_join(transform(p, x -> concat(x.head, x.body, {_literal(END)})), '') AS formatted",
        """filter(transform(p, (x, i) -> named_struct('start', starts[i] + heads[i], 'length', bodies[i], 'loss', x.loss)),
           m -> m.loss) AS loss_mask""",
    )


def read_back(output: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, losses)``: turns and assistant texts from the output alone."""
    names = " ".join(f"WHEN {_literal(v)} THEN {_literal(k)}" for k, v in ROLES.items())
    role = f"substring_index(substring(b, {len(OPEN) + 1}), {_literal(CLOSE)}, 1)"
    plain = unescaped(f"replace(substring(role, {len(OTHER) + 1}), {_literal(COLON[1])}, {_literal(COLON[0])})")
    text = unescaped(f"substring(b, length(role) + {len(OPEN) + len(CLOSE) + 1})")
    blocks = f"filter(split(formatted, {_literal(END)}, -1), b -> b <> '')"
    parsed = output.selectExpr("*", f"transform({blocks}, b -> named_struct('b', b, 'role', {role})) AS _blocks")
    return parsed.selectExpr(
        "conv_id", "formatted",
        f"""transform(transform(_blocks, x -> named_struct('b', x.b, 'role', x.role)), x -> named_struct(
            'role', CASE x.role {names} ELSE {plain.replace('role', 'x.role')} END,
            'text', {text.replace('role', 'x.role').replace('(b,', '(x.b,')})) AS turns""",
        f"transform(loss_mask, m -> {unescaped('substring(formatted, m.start, m.length)')}) AS losses",
    )


def digest(read: DataFrame) -> DataFrame:
    return read.selectExpr(
        "conv_id", "CAST(size(turns) AS BIGINT) AS n_turns",
        "sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256) AS turns_sha256",
        "CAST(length(array_join(losses, '')) AS BIGINT) AS loss_chars", "sha2(array_join(losses, ''), 256) AS loss_sha256",
        "CAST(length(formatted) AS BIGINT) AS formatted_chars",
    )
