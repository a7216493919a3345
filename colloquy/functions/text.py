"""Column functions over roles, turns and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Roles and their aliases, and the literal prompt texts.
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt")
SYSTEM_ROLE = "system"
RAG_HEADER = "Retrieved training examples (use as structural reference):"
INJECT_HEADER = "Use os exemplos recuperados do treino como referência estrutural."
JOINED_HEADER = "Retrieved examples:"

# Whitespace as str.strip() of Python sees it.
_STRIP = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def is_user(role: Column) -> Column:
    return role.isin(*USER_ROLES)


def is_assistant(role: Column) -> Column:
    return role.isin(*ASSISTANT_ROLES)


def normalize_role(role: Column) -> Column:
    """Aliases to their plain names; a missing role is ``user``; others stay."""
    return (
        F.when(role.isNull() | is_user(role), "user")
        .when(is_assistant(role), "assistant")
        .otherwise(role)
    )


def first_non_empty(first: Column, second: Column) -> Column:
    """The first of two message arrays that has elements, else an empty array."""
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return (
        F.when(F.size(first) > 0, first)
        .when(F.size(second) > 0, second)
        .otherwise(empty)
    )


def last_content(messages: Column, roles: tuple[str, ...]) -> Column:
    """Content of the last message of a nested item with one of ``roles``."""
    hits = F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["content"], F.lit(""))


def first_content(messages: Column, roles: tuple[str, ...]) -> Column:
    hits = F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["content"], F.lit(""))


def example_text(fields: list[str], query: Column, workflow: Column) -> Column:
    """The named fields in the order given; unknown and empty ones drop out."""
    known = {"query": query, "workflow": workflow}
    parts = [F.coalesce(known[f], F.lit("")) for f in fields if f in known]
    if not parts:
        return F.lit("")
    return strip(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n"))


def plain_line(role: Column, content: Column) -> Column:
    return F.concat(
        F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(content, F.lit(""))
    )


def plain_text(messages: Column) -> Column:
    return F.array_join(
        F.transform(messages, lambda m: plain_line(m["role"], m["content"])), "\n"
    )


def estimate_tokens(n_chars: Column, chars_per_token: int = 4) -> Column:
    """Whole tokens of a text of ``n_chars`` characters, at least one."""
    return F.greatest(
        F.lit(1).cast("long"), F.floor(n_chars / F.lit(chars_per_token)).cast("long")
    )


def few_shot_example(number: Column, question: Column, workflow: Column) -> Column:
    return F.concat(
        F.lit("### Example "), number.cast("string"),
        F.lit("\nQuestion:\n"), question,
        F.lit("\n\nWorkflow:\n"), workflow, F.lit("\n"),
    )


def chat_turn(role: Column, content: Column) -> Column:
    """Default chat template of one turn."""
    return F.concat(
        F.lit("<|"), role, F.lit("|>\n"), F.coalesce(content, F.lit("")), F.lit("\n")
    )


GENERATION_PROMPT = "<|assistant|>\n"


def code_points(text: Column) -> Column:
    """Default tokenizer: one id per character, its Unicode code point."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c))
