"""Places where a language model may be plugged in; each takes a callable and has a fallback without one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pactlake.contract import Clause, Contract

Narrator = Callable[[str], str | None]
Annotator = Callable[[str, Clause, list[str]], dict[str, str] | None]


def neighbours(columns: list[str], column: str, reach: int = 3) -> list[str]:
    """The columns within `reach` places of a column."""
    at = columns.index(column)
    return [c for c in columns[max(0, at - reach) : at + reach + 1] if c != column]


def annotate(contract: Contract, annotator: Annotator | None, limit: int | None = None) -> Contract:
    """The contract with annotations of its ambiguous columns; an annotator that fails leaves a column as it is."""
    names = list(contract.schema)
    wanted = [c for c in names if contract.schema[c].description is None and contract.schema[c].format is None][:limit]
    schema = dict(contract.schema)
    for c in wanted if annotator else []:
        try:
            said = annotator(c, schema[c], neighbours(names, c))
        except Exception:  # a provider's failure must not lose the contract
            said = None
        if said:
            schema[c] = replace(schema[c], llm_annotations=said)
    return replace(contract, schema=schema)


def asked(narrator: Narrator | None, request: str) -> str:
    """What the narrator says; nothing without one, or where it fails."""
    try:
        return (narrator(request) if narrator else None) or ""
    except Exception:  # as above
        return ""


def narrate(score: int, grade: str, totals: dict[str, int], narrator: Narrator | None = None) -> str:
    """A sentence on the health score, by the narrator or, without one, by rule."""
    plain = f"Health {score} of 100 ({grade}): {totals.get('passed', 0)} of {totals.get('total', 0)} checks passed, {totals.get('critical', 0)} critical and {totals.get('high', 0)} high."
    return asked(narrator, plain) or plain


def narrate_violation(said: str, narrator: Narrator | None = None) -> str:
    """A failing check in a sentence for readers outside the field; the rule's text without a narrator."""
    return asked(narrator, f"Say in one sentence what broke, which system it touches and what that costs: {said}").strip() or said


def advise(actions: list[str], issues: list[str], narrator: Narrator | None = None, most: int = 3) -> list[str]:
    """Recommendations: as many lines of the narrator's answer as are asked for, without their numbers; else the rules' actions."""
    request = "\n".join([f"Give {most} actions, one a line, the most urgent first. Known issues:", *(issues or ["none"]), "Actions so far:", *actions])
    lines = (re.sub(r"^\s*\d+[.)]\s*", "", line).strip() for line in asked(narrator, request).splitlines())
    return [line for line in lines if line][:most] or actions
