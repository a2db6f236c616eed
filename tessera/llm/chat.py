"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags per segment. Native expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, which roles bear loss and which role may follow which.

    ``{role}`` in ``head`` is the turn's role. A control character in a text is followed by ``mark``,
    so no control string of the template can stand inside a text, and reading back is exact.
    """

    head: str = "<|{role}|>\n"
    tail: str = "</s>\n"
    control: str = "<[|"
    mark: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; the state is the role of the turn before.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    #: roles at which a conversation may end.
    accepting: tuple[str, ...] = ("assistant", "user")


def escape(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit(t.mark), F.lit(t.mark * 2))
    for c in t.control:
        out = F.replace(out, F.lit(c), F.lit(c + t.mark))
    return out


def unescape(text: Column, t: Template) -> Column:
    out = text
    for c in t.control:
        out = F.replace(out, F.lit(c + t.mark), F.lit(c))
    return F.replace(out, F.lit(t.mark * 2), F.lit(t.mark))


def valid_order(roles: Column, t: Template) -> Column:
    """Runs the machine over an array of roles; the dead state is null."""
    arcs = F.create_map(*[F.lit(x) for a, nexts in t.follows.items() for b in nexts for x in (f"{a}>{b}", b)])
    end = F.aggregate(roles, F.lit("").cast("string"), lambda s, r: F.when(s.isNotNull(), F.element_at(arcs, F.concat(s, F.lit(">"), r))))
    return F.coalesce(end.isin(*t.accepting), F.lit(False))


def format_chats(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``valid``, ``segments`` (array of text, loss).

    Turns are ordered by number (null first), then role and text, so ties and repeated rows have one order.
    Null texts and roles are empty strings; an unknown role or a bad order makes ``valid`` false and is formatted
    all the same. Rows with a null conversation id form one conversation. Other columns are left out.
    """
    t = template
    before, after = t.head.split("{role}")
    turns = rows.groupBy(F.col(conv).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63) + 1)).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns")
    )
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        valid_order(F.transform("turns", lambda x: x.role), t).alias("valid"),
        F.flatten(
            F.transform(
                "turns",
                lambda x: F.array(
                    segment(F.concat(F.lit(before), escape(x.role, t), F.lit(after)), no),
                    segment(escape(x.text, t), x.role.isin(*t.loss_roles)),
                    segment(F.lit(t.tail), no),
                ),
            )
        ).alias("segments"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """From segments alone: ``turns`` (role, text), ``loss_text`` and ``formatted`` of each conversation."""
    t = template
    before, after = t.head.split("{role}")
    whole = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
    parts = F.filter(F.split("formatted", "\\Q" + t.tail + "\\E", -1), lambda p: p.startswith(before))
    body = lambda p: F.substring(p, len(before) + 1, 2**31 - 1)
    cut = lambda p: F.instr(p, after)
    turns = F.transform(
        F.transform(parts, body),
        lambda p: F.struct(unescape(F.substring(p, F.lit(1), F.instr(p, after) - 1), t).alias("role"), unescape(F.substring(p, F.instr(p, after) + len(after), F.length(p)), t).alias("text")),
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, t)), "")
    return whole.withColumn("turns", turns).withColumn("loss_text", loss)
