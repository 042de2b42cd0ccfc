"""Rows that operators must survive."""

#: Missing, empty, blank, long, repeated and tied texts.
HOSTILE = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b"),
    (4, "a"),
    (5, "one two three four five six seven eight nine ten.\n" * 3),
    (5, "one two three four five six seven eight nine ten.\n" * 3),
    (None, "no id but a text of some words, long enough for a line."),
    (None, None),
    (6, "word " * 20_000),
    (7, "x" * 50_000),
    (8, "<|endoftext|> <s> ÉCOLE Σίσυφος ΑΣ \x00 日本語 \U0001f600  two  spaces "),
    (9, "▁mark ▁ inside"),
]
