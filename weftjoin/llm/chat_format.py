"""Chat formatting: a declarative template, a finite-state machine over roles, loss flags by segment.

Everything here is DataFrame expressions.  Cases:

* null text or role: the empty string; null turn: before all other turns; null conv_id: a conversation of its own.
* ties in ``turn``: by role, then text; repeated rows are turns of their own.
* an order of roles that the machine doesn't accept: formatted all the same, ``valid`` is false.
* an empty table: no rows; further columns of the input are ignored.

A conversation is one output string, so its turns meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role, the marks of any other role, and the machine's transitions (state, role) -> state."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Role("[INST] ", " [/INST] "),
            "assistant": Role("<s>", "</s>\n", loss=True),
        }
    )
    other_opening: str = "[ROLE="
    other_opening_end: str = "] "
    other_closing: str = " [/ROLE] "
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """The strings that no escaped text may hold."""
        marks = [m for r in self.roles.values() for m in (r.opening, r.closing)]
        return sorted({m.strip() for m in [*marks, self.other_opening, self.other_closing]}, key=len, reverse=True)


DEFAULT = Template()


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\[](){}.*+?^$|/<>=-" and not c.isalnum() else c for c in text)


def _controls_after_first(t: Template) -> list[tuple[str, str]]:
    by_first: dict[str, list[str]] = {}
    for c in t.controls():
        by_first.setdefault(c[0], []).append(c[1:])
    return [(first, "|".join(_quoted(x) for x in rest)) for first, rest in by_first.items()]


def escape(text: Column, t: Template = DEFAULT) -> Column:
    """A control string gets a ``~`` after its first character, one with k of them gets k + 1: reversible."""
    for first, rest in _controls_after_first(t):
        text = F.regexp_replace(text, f"({_quoted(first)})(~*)(?=(?:{rest}))", "$1~$2")
    return text


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    for first, rest in reversed(_controls_after_first(t)):
        text = F.regexp_replace(text, f"({_quoted(first)})~(~*)(?=(?:{rest}))", "$1$2")
    return text


def _opening(role: Column, t: Template) -> Column:
    out = F.concat(F.lit(t.other_opening), F.url_encode(role), F.lit(t.other_opening_end))
    for name, r in t.roles.items():
        out = F.when(role == name, F.lit(r.opening)).otherwise(out)
    return out


def _closing(role: Column, t: Template) -> Column:
    out = F.lit(t.other_closing)
    for name, r in t.roles.items():
        out = F.when(role == name, F.lit(r.closing)).otherwise(out)
    return out


def format_conversations(conversations: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, valid, formatted, segments (text, loss); the segments' texts joined are formatted."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("x"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (a, b), c in t.transitions.items() for x in (f"{a} {b}", c)])
    final = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(steps[F.concat(s, F.lit(" "), x["role"])], F.lit("rejected")))
    trained = [name for name, r in t.roles.items() if r.loss]

    def segments(x: Column) -> Column:
        part = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(
            part(_opening(x["role"], t), F.lit(False)),
            part(escape(x["text"], t), x["role"].isin(trained)),
            part(_closing(x["role"], t), F.lit(False)),
        )

    out = grouped.select("conv_id", final.isin(*t.accepting).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select("conv_id", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation, from the string alone."""
    other = f"{_quoted(t.other_opening)}[^\\]]*{_quoted(t.other_opening_end)}"
    opening = "|".join([*(_quoted(r.opening) for r in t.roles.values()), other])
    closing = "|".join([*(_quoted(r.closing) for r in t.roles.values()), _quoted(t.other_closing)])
    pattern = F.lit(f"(?s)({opening})(.*?)({closing})")
    marks, texts = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))

    def role_of(mark: Column) -> Column:
        inner = F.substring(mark, F.lit(len(t.other_opening) + 1), F.char_length(mark) - len(t.other_opening) - len(t.other_opening_end))
        out = F.url_decode(inner)
        for name, r in t.roles.items():
            out = F.when(mark == r.opening, F.lit(name)).otherwise(out)
        return out

    return F.zip_with(marks, texts, lambda m, x: F.struct(role_of(m).alias("role"), unescape(x, t).alias("text")))


def chat_digest(conversations: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """The digest columns, read back from the formatted strings and their loss flags."""
    df = format_conversations(conversations, t).withColumn("turns", read_back(F.col("formatted"), t))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return df.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: two turns that hold the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
