"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, the marks around a turn and whether its text
counts for the loss. Formatting emits segments (text, loss flag); their texts joined
are the training string. All of it is DataFrame functions.

Edge cases: a null text is the empty text; a null or unknown role is written with the
generic marks, carries no loss and makes the conversation invalid; turns that tie are
ordered by role, then text; repeated rows stay; an empty table gives an empty result;
a null conv_id is a conversation of its own. Columns beyond conv_id, turn, role and
text are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (opening mark, closing mark, text counts for the loss)
TEMPLATE = {
    "roles": {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True),
    },
    "other": ("<<ROLE>>", "<</ROLE>>", "<</END>>"),
    "start": "start",
    "next": {
        "start": ["system", "user"],
        "system": ["user"],
        "user": ["assistant"],
        "assistant": ["user"],
    },
    "accept": ["assistant"],
}


def marks(template: dict) -> list[str]:
    return [m for a, b, _ in template["roles"].values() for m in (a, b)] + list(template["other"])


def check_template(template: dict) -> None:
    """Marks must not overlap, else reading back would be ambiguous."""
    all_marks = marks(template)
    for m in all_marks:
        for i in range(1, len(m)):
            if any(m[i:].startswith(o) or o.startswith(m[i:]) for o in all_marks):
                raise ValueError(f"mark {m!r} overlaps another mark")
    if any(m.startswith(o) for k, m in enumerate(all_marks) for j, o in enumerate(all_marks) if j != k):
        raise ValueError("no mark may begin with another")


def _escapes(template: dict) -> list[tuple[str, str]]:
    """For each first character of a mark: that character and the pattern of what follows it."""
    firsts: dict[str, list[str]] = {}
    for m in marks(template):
        firsts.setdefault(m[0], []).append(re.escape(m[1:]))
    return [(c, "|".join(rest)) for c, rest in firsts.items()]


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    """Put one more backslash after the first character of everything that looks like a mark."""
    for c, rest in _escapes(template):
        text = F.regexp_replace(text, rf"{re.escape(c)}(\\*)(?={rest})", rf"{c}\\$1")
    return text


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    """The inverse of :func:`escape`."""
    for c, rest in _escapes(template):
        text = F.regexp_replace(text, rf"{re.escape(c)}\\(\\*)(?={rest})", rf"{c}$1")
    return text


def _role_case(role: Column, template: dict, pick, other) -> Column:
    out = F
    for name, spec in template["roles"].items():
        out = out.when(role == name, pick(spec))
    return out.otherwise(other)


def final_state(roles: Column, template: dict = TEMPLATE) -> Column:
    """Run the machine over an array of roles; ``error`` absorbs."""
    pairs = [F.lit(x) for s, to in template["next"].items() for r in to for x in (f"{s}>{r}", r)]
    step = F.create_map(*pairs)
    return F.aggregate(
        roles,
        F.lit(template["start"]),
        lambda s, r: F.coalesce(F.try_element_at(step, F.concat(s, F.lit(">"), r)), F.lit("error")),
    )


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, segments, formatted``.

    ``segments`` is an array of (text, loss). ``valid`` says whether the machine accepts
    the order of the roles and every turn number occurs once.
    """
    check_template(template)
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    role_open, role_end, other_close = template["other"]

    def parts(t: Column) -> Column:
        other_open = F.concat(F.lit(role_open), escape(t.role, template), F.lit(role_end))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(_role_case(t.role, template, lambda s: F.lit(s[0]), other_open), F.lit(False)),
            seg(escape(t.text, template), _role_case(t.role, template, lambda s: F.lit(s[2]), F.lit(False))),
            seg(_role_case(t.role, template, lambda s: F.lit(s[1]), F.lit(other_close)), F.lit(False)),
        )

    convs = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    numbers = F.transform("turns", lambda t: t.turn)
    state = final_state(F.transform("turns", lambda t: t.role), template)
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        (state.isin(template["accept"]) & (F.size(F.array_distinct(numbers)) == F.size("turns")) & ~F.exists(numbers, lambda n: n.isNull())).alias("valid"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Parse a formatted string into an array of (role, text)."""
    role_open, role_end, other_close = template["other"]
    shapes = [(name, a, b) for name, (a, b, _) in template["roles"].items()]
    pattern = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for _, a, b in [*shapes, ("", role_open, other_close)])

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(role_open) + 1), F.length(piece) - len(role_open) - len(other_close))
        cut = F.instr(inner, role_end)
        role = unescape(F.substring(inner, F.lit(1), cut - 1), template)
        text = F.substring(inner, cut + len(role_end), F.length(inner))
        for name, a, b in shapes:
            mine = piece.startswith(a)
            role = F.when(mine, F.lit(name)).otherwise(role)
            text = F.when(mine, F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def digests(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digest columns, read back from the formatted string and from its loss mask."""
    losses = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, template)), "")
    turns = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.withColumns({"back": read_back(F.col("formatted"), template), "loss_text": losses}).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
