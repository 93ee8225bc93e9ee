"""Texts at the edges."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))


def edge_texts() -> list[str | None]:
    """Null, empty, blank, short, very long, repeated and odd texts."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the angry bear while birds sing in the old tree near the river"
    many = " ".join(f"word{i}" for i in range(120))
    return [
        None, "", " ", "\n\t ", "a", "A", "a", "two words", "Two WORDS", base, base, base.upper(), base + " today", base + "\n", many, many + " tail", "head " + many,
        " ".join(many.split()[:60] + ["x"] + many.split()[60:]), LONG, LONG, LONG + " end", "  double  spaces   and\ttabs\r\nlines \n", "non\xa0breaking  space", "İstanbul ÇÉ naïve don't we'll I'M",
        "日本語 のテキスト", "emoji 😀😀 ok", "<|endoftext|> is text", "123 4567 8.9,10", "x" * 5000, "trailing  ", "line\n\nbreak\n \nend", "*** ### $$$ word***",
    ]
