from .hashing import hash_uniform, hex7_int, mint_id
from .text import (
    NON_WORD_CLASS,
    WS_CLASS,
    answer_tokens,
    default_process,
    falsy_coalesce,
    fmt3,
    nonempty,
    normalize_answer,
    normalize_text,
    strip_ws,
    truncate,
    word_tokens,
)

__all__ = [
    "NON_WORD_CLASS", "WS_CLASS", "answer_tokens", "default_process", "falsy_coalesce", "fmt3",
    "hash_uniform", "hex7_int", "mint_id", "nonempty", "normalize_answer", "normalize_text",
    "strip_ws", "truncate", "word_tokens",
]
