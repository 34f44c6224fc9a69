"""Column expressions: chat shapes, layouts, tokens, names."""

from calibrel.functions.chat import (
    CHATML,
    LABELS,
    ROLE_HEADERS,
    Layout,
    as_turns,
    convert,
    convert_turns,
    dropped_turns,
    map_role,
    render,
)
from calibrel.functions.names import artifact_name, contains_ignoring_case, pad_fallback
from calibrel.functions.tokens import attention_mask, tokenize, truncate

__all__ = [
    "CHATML",
    "LABELS",
    "ROLE_HEADERS",
    "Layout",
    "artifact_name",
    "as_turns",
    "attention_mask",
    "contains_ignoring_case",
    "convert",
    "convert_turns",
    "dropped_turns",
    "map_role",
    "pad_fallback",
    "render",
    "tokenize",
    "truncate",
]
