"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative template
turns each conversation into text segments with a loss flag each. DataFrame functions only.

Within texts and roles, the characters that control strings are made of are escaped, so no text can hold a
control string, and reading back is exact. Null texts and roles are empty. Turns sort by turn, then role,
then text. Rows of a null conv_id are one conversation. Repeated rows are turns of their own; other columns
are ignored. A conversation's digest needs its whole text in one row; turns gather by partial lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.llm.arrays import running, stretches


@dataclass(frozen=True)
class Segment:
    """Control strings before and after a turn's text, and whether the text is under the loss mask."""

    before: str
    after: str
    loss: bool


#: The template by role; other roles get OTHER with their name. Every turn ends in END.
END = "</s>"
TEMPLATE = {"user": Segment("[INST] ", " [/INST]" + END, False), "assistant": Segment("", END, True)}
OTHER = Segment("<<{role}>>", END, False)
#: Escapes, in the order in which they are made; undone from the last to the first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;"))
#: The machine: from a state, by a role, to a state; a role without an entry leads to `bad` for good.
MACHINE = {("start", "system"): "start", ("start", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
ACCEPTED = ("answered",)


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _by_role(role: Column, value) -> Column:
    out = None
    for name, segment in TEMPLATE.items():
        out = (F if out is None else out).when(role == name, value(segment, name))
    return out.otherwise(value(OTHER, None))


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, valid, segments): segments are (text, loss), control strings and escaped texts in
    turn; valid: the machine accepts the roles."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def parts(t: Column) -> Column:
        name = escape(t["role"])
        before = _by_role(t["role"], lambda s, known: F.lit(s.before) if known else F.concat(F.lit(s.before.partition("{role}")[0]), name, F.lit(s.before.partition("{role}")[2])))
        after = _by_role(t["role"], lambda s, _: F.lit(s.after))
        loss = _by_role(t["role"], lambda s, _: F.lit(s.loss))
        segment = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
        return F.array(segment(before, F.lit(False)), segment(escape(t["text"]), loss), segment(after, F.lit(False)))

    moves = F.create_map(*(F.lit(x) for (state, by), to in MACHINE.items() for x in (f"{state} {by}", to)))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", s, t["role"])), F.lit("bad")))
    return gathered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*ACCEPTED).alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, valid, formatted, loss_runs): the text, and the masked stretches (start, length) in it."""
    s = segments(turns)
    text = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    sizes = F.transform("segments", lambda x: F.length(x["text"]).cast("long"))
    runs = F.zip_with("segments", running(sizes, lambda x, y: x + y, 0), lambda x, at: F.struct(at.alias("start"), F.length(x["text"]).cast("long").alias("length"), x["loss"].alias("loss")))
    masked = F.transform(F.filter(runs, lambda r: r["loss"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")))
    return s.select("conv_id", "valid", text.alias("formatted"), masked.alias("loss_runs"))


def read_back(texts: DataFrame) -> DataFrame:
    """(conv_id, turns): turns (role, text, loss) parsed from `formatted` alone."""
    user, assistant = TEMPLATE["user"], TEMPLATE["assistant"]
    mark, close = OTHER.before.split("{role}")
    tail = user.after.removesuffix(END)

    def parse(x: Column) -> Column:
        is_user, is_other = x.startswith(user.before), x.startswith(mark)
        role = F.when(is_user, F.lit("user")).when(is_other, F.substring_index(F.substring(x, len(mark) + 1, 2**31 - 1), close, 1)).otherwise(F.lit("assistant"))
        body = (
            F.when(is_user, x.substr(F.lit(len(user.before) + 1), F.length(x) - len(user.before) - len(tail)))
            .when(is_other, F.substring(x, 1, 2**31 - 1).substr(F.length(role) + len(mark) + len(close) + 1, F.length(x)))
            .otherwise(x)
        )
        loss = F.when(is_user, F.lit(user.loss)).when(is_other, F.lit(OTHER.loss)).otherwise(F.lit(assistant.loss))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"), loss.alias("loss"))

    pieces = F.split("formatted", END, -1)  # the last piece is what follows the last END: nothing
    return texts.select("*", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse).alias("turns"))


def loss_text() -> Column:
    """What `loss_runs` cut from `formatted`, unescaped."""
    return F.array_join(F.transform(stretches(F.col("formatted"), F.col("loss_runs")), unescape), "")


def report(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid); what is under the loss mask is cut by the mask."""
    back = read_back(formatted(turns)).withColumn("loss", loss_text())
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
