"""Questions about packets of facts, for people and for text models."""

from __future__ import annotations

import random

#: How each kind of question is put.
TEMPLATES = {
    "construction": ["How is {field} constructed?", "Show the construction trace of {field}.", "Where does {field} come from, step by step?", "Explain how the pipeline builds {field}."],
    "downstream": ["What happens to {field} further down the pipeline?", "Which later fields use {field}?", "Explain the downstream impact of {field}.", "Where does {field} flow to?"],
    "affected": ["Is {field} affected by {other}?", "Does {other} influence {field}?", "Would a change in {other} propagate to {field}? Answer YES or NO.", "Check whether {field} depends on {other}."],
}


def question(kind: str, field: str, other: str | None, rng: random.Random) -> str:
    return rng.choice(TEMPLATES.get(kind, TEMPLATES["affected"])).format(field=field, other=other)


def message(packet_json: str, said: str) -> str:
    """What a text model is asked: the question and the packet's JSON."""
    return f"QUESTION: {said}\nFACTS: {packet_json}"
