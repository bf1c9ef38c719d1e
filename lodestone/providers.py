"""What a language model does for the engine, as injected functions; none is needed for plain search.

A provider's answer is checked here: an answer that does not fit is treated as a failed call (None), and a failed
call leaves results as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd

from lodestone.functions.text import fold_text
from lodestone.operators.catalog import GENERIC_IN_QUERIES

Call = Callable[[str], str | None]


def structured(call: Call, prompt: str, valid: Callable[[Any], bool], tries: int = 2) -> Any | None:
    """The JSON value a model returned, asked again if it doesn't parse or fit; None after the last try."""
    for _ in range(tries):
        try:
            value = json.loads(call(prompt) or "")
        except (ValueError, TypeError):
            continue
        if valid(value):
            return value
    return None


def _number(value: Any) -> float:
    """A number or a numeral; 0 for anything else."""
    return float(np.nan_to_num(pd.to_numeric(pd.Series([value], dtype=object), errors="coerce").astype(float)[0]))


def parse_query(call: Call, query: str, groups: Callable[[str, str], list[str]] = lambda kind, name: [name if kind == "author" else fold_text(name)]) -> dict:
    """{semantic_query, facets, year_from, year_to} of a question; groups(kind, name) gives a facet's equivalent terms.

    Without `groups` an author is the name as given, other terms are folded.  Weights are brought into 0 to 1; facets
    of weight 0 and generic document types are left out.  A year of 0, or that is no number, is none.  If the call
    fails the query stands as it is.
    """
    answer = structured(call, query, lambda v: isinstance(v, dict) and isinstance(v.get("semantic_query", ""), str))
    if answer is None:
        return {"semantic_query": query, "facets": [], "year_from": None, "year_to": None}
    facets = []
    for kind, key in (("tag", "tags"), ("author", "authors"), ("doctype", "doc_types")):
        for entry in answer.get(key) or []:
            name, weight = str(entry.get("name", "")).strip(), float(np.clip(_number(entry.get("weight")), 0, 1))
            if name and weight > 0 and not (kind == "doctype" and fold_text(name) in GENERIC_IN_QUERIES):
                facets.append({"terms": groups(kind, name), "weight": weight, "kind": kind})
    year = lambda k: int(_number(answer.get(k))) or None
    return {"semantic_query": answer.get("semantic_query") or query, "facets": facets, "year_from": year("year_from"), "year_to": year("year_to")}


def propose_ranking(call: Call, query: str, previews: list[str], length: int = 400) -> list[int] | None:
    """The order of previews that a model proposes, as zero-based positions; None if the call fails."""
    prompt = query + "\n" + "\n".join(f"[{i}] {p[:length]}" for i, p in enumerate(previews))
    answer = structured(call, prompt, lambda v: isinstance(v, dict) and isinstance(v.get("ranking"), list))
    return None if answer is None else [i for i in answer["ranking"] if isinstance(i, int)]


def adjudicator(call: Call) -> Callable[[str, str, list[str]], str | None]:
    """Decides whether a term is one of the candidates; anything else means a new entity."""

    def decide(kind: str, term: str, candidates: list[str]) -> str | None:
        answer = structured(call, f"{kind}: {term}\n" + "\n".join(candidates), lambda v: isinstance(v, dict) and "choice" in v)
        return answer["choice"] if answer and answer["choice"] in candidates else None

    return decide
