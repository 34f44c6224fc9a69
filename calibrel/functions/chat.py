"""Conversation arrays: role names, conversion to chat turns, layout rendering."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role names of the two conversation shapes.
STRICT_ROLES = {"system": "system", "human": "user", "gpt": "assistant"}
LENIENT_ROLES = {
    "human": "user",
    "gpt": "assistant",
    "system": "system",
    "user": "user",
    "assistant": "assistant",
}

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

MIXED_TURNS = "array<struct<from:string,value:string,role:string,content:string>>"


@dataclass(frozen=True)
class Layout:
    """How a model writes a chat down: the text around the turns and each content."""

    bos: str
    before_role: str
    after_role: str
    after_content: str
    generation_prompt: str
    strip_content: bool = False
    # roles written differently, or with other text around their turns: role -> text
    role_names: Mapping[str, str] = field(default_factory=dict)
    before_role_of: Mapping[str, str] = field(default_factory=dict)
    after_role_of: Mapping[str, str] = field(default_factory=dict)
    after_content_of: Mapping[str, str] = field(default_factory=dict)
    # whether the role itself is written
    writes_role: bool = True

    def around(self, role: Column) -> tuple[Column, Column, Column, Column]:
        """What stands before the role, the role, and what follows it and the content."""

        def chosen(usual: Column, special: Mapping[str, str]) -> Column:
            for name, text in special.items():
                usual = F.when(role == name, F.lit(text)).otherwise(usual)
            return usual

        written = chosen(role, self.role_names) if self.writes_role else F.lit("")
        return (
            chosen(F.lit(self.before_role), self.before_role_of),
            written,
            chosen(F.lit(self.after_role), self.after_role_of),
            chosen(F.lit(self.after_content), self.after_content_of),
        )


# Two public chat layouts.
ROLE_HEADERS = Layout(
    bos="<|begin_of_text|>",
    before_role="<|start_header_id|>",
    after_role="<|end_header_id|>\n\n",
    after_content="<|eot_id|>",
    generation_prompt="<|start_header_id|>assistant<|end_header_id|>\n\n",
    strip_content=True,
)
CHATML = Layout(
    bos="",
    before_role="<|im_start|>",
    after_role="\n",
    after_content="<|im_end|>\n",
    generation_prompt="<|im_start|>assistant\n",
)


# An invented layout whose text depends on the role.
LABELS = Layout(
    bos="<s>",
    before_role="",
    after_role=": ",
    after_content="\n",
    generation_prompt="Assistant:",
    role_names={"user": "User", "assistant": "Assistant"},
    before_role_of={"assistant": "\n"},
    after_content_of={"assistant": "</s>\n"},
)


def map_role(role: Column, strict: bool = False, tolerant: bool = False) -> Column:
    """Chat role of a source role. Unknown names pass through; if strict they fail the job, or
    give null where ``tolerant``."""
    names = STRICT_ROLES if strict else LENIENT_ROLES
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    if strict and tolerant:
        return F.try_element_at(table, role)
    if strict:
        unknown = F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))
        return F.coalesce(F.try_element_at(table, role), F.raise_error(unknown).cast("string"))
    return F.coalesce(F.try_element_at(table, role), role)


def as_turns(shape: str, role: Column, text: Column) -> Column:
    """One four-field turn written in the ``sharegpt`` or the ``chat`` shape."""
    none = F.lit(None).cast("string")
    fields = {
        "sharegpt": (role, text, none, none),
        "chat": (none, none, role, text),
    }[shape]
    return F.struct(*[c.alias(n) for c, n in zip(fields, ("from", "value", "role", "content"))])


def _is_sharegpt(turn: Column) -> Column:
    return turn["from"].isNotNull() & turn["value"].isNotNull()


def _is_chat(turn: Column) -> Column:
    return turn["role"].isNotNull() & turn["content"].isNotNull()


def convert(conversations: Column, mode: str = "lenient", tolerant: bool = False) -> Column:
    """Chat turns of a mixed array.

    ``lenient``: ``from``/``value`` wins, else ``role``/``content`` as it is, else the turn
    is dropped. ``strict``: every turn is read as ``from``/``value``; an unknown role or a
    turn without them fails the job, or has a null role or content where ``tolerant``, so that the
    conversation cannot be rendered. ``as_is``: every turn is read as ``role``/``content``.
    """
    if mode == "strict":
        return F.transform(
            conversations,
            lambda t: F.struct(
                map_role(t["from"], True, tolerant).alias("role"),
                (
                    t["value"]
                    if tolerant
                    else F.coalesce(
                        t["value"], F.raise_error(F.lit("turn without value")).cast("string")
                    )
                ).alias("content"),
            ),
        )
    if mode == "as_is":
        return F.transform(
            conversations,
            lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
        )
    if mode != "lenient":
        raise ValueError(f"unknown mode {mode!r}")
    known = F.filter(conversations, lambda t: _is_sharegpt(t) | _is_chat(t))
    return F.transform(
        known,
        lambda t: F.struct(
            F.when(_is_sharegpt(t), map_role(t["from"])).otherwise(t["role"]).alias("role"),
            F.when(_is_sharegpt(t), t["value"]).otherwise(t["content"]).alias("content"),
        ),
    )


def convert_turns(
    conversations: Column, mode: str = "lenient", start: Column | int = 0, tolerant: bool = False
) -> Column:
    """The chat turns as ``(position, role, content)``; positions count dropped turns too."""
    first = F.lit(start) if isinstance(start, int) else start
    placed = F.transform(
        conversations,
        lambda t, i: F.transform(
            convert(F.array(t), mode, tolerant),
            lambda c: F.struct((first + i).cast("bigint").alias("position"), c["role"], c["content"]),
        ),
    )
    return F.flatten(placed)


def dropped_turns(conversations: Column) -> Column:
    """Number of turns in neither shape, which the lenient mode drops."""
    return F.size(F.filter(conversations, lambda t: ~(_is_sharegpt(t) | _is_chat(t))))


def render(
    chat: Column,
    layout: Layout,
    add_generation_prompt: bool = False,
    opens: Column | None = None,
    closes: Column | None = None,
) -> Column:
    """The chat as one text; null if the chat, a role or a content is null.

    ``opens`` and ``closes`` say whether the row holds the beginning and the end of its
    conversation, for rows that hold a part only.
    """

    def turn_text(t: Column) -> Column:
        content = F.btrim(t["content"], F.lit(WHITESPACE)) if layout.strip_content else t["content"]
        before, role, after_role, after_content = layout.around(t["role"])
        return F.concat(before, role, after_role, content, after_content)

    whole = F.forall(chat, lambda t: t["role"].isNotNull() & t["content"].isNotNull())
    body = F.array_join(F.transform(chat, turn_text), "")
    bos = F.lit(layout.bos)
    if opens is not None:
        bos = F.when(opens, bos).otherwise(F.lit(""))
    pieces = [bos, body]
    if add_generation_prompt:
        prompt = F.lit(layout.generation_prompt)
        if closes is not None:
            prompt = F.when(closes, prompt).otherwise(F.lit(""))
        pieces.append(prompt)
    return F.when(whole, F.concat(*pieces))
