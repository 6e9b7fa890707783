"""Lossless chunking of ordered steps under a budget."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship_package

MAX_TOKENS, MAX_STEPS = 480, 3


def count_words(text: str) -> int:
    return len(_WORD.findall(text))


_WORD = re.compile(r"\S+")


def word_cuts(text: str, budget: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of the longest pieces of at most ``budget`` words, in one pass: a piece ends where the next begins."""
    starts = [m.start() for m in _WORD.finditer(text)]
    cuts = [0, *starts[budget::budget], len(text)]
    return [(a, b, min(budget, len(starts) - i * budget)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def fitting_end(text: str, start: int, budget: int, count: Callable[[str], int]) -> int:
    """Furthest end (code points) such that text[start:end] has at most budget tokens; at least one character.

    Ends are doubled until one does not fit, then halved: what is counted follows the piece, not the text.
    """
    low, step = start + 1, 64
    while start + step < len(text) and count(text[start : start + step]) <= budget:
        low, step = start + step, 2 * step
    high = min(start + step, len(text))
    while low < high:
        middle = (low + high + 1) // 2
        if count(text[start:middle]) <= budget:
            low = middle
        else:
            high = middle - 1
    return low


def counted_cuts(text: str, budget: int, count: Callable[[str], int]) -> list[tuple[int, int, int]]:
    """The same for any counter of tokens; the rest is not counted again at each cut."""
    out, at = [], 0
    while at < len(text):
        end = fitting_end(text, at, budget, count)
        out.append((at, end, count(text[at:end])))
        at = end
    return out


def pack_steps(steps: DataFrame, owner: str, order: str, text: str, max_tokens: int = MAX_TOKENS, max_steps: int = MAX_STEPS, count: Callable[[str], int] = count_words) -> DataFrame:
    """(owner, chunk, step, span_start, span_end, n_tokens): each owner's steps, packed greedily in order.

    A step that alone exceeds the budget is cut into the longest fitting pieces, so the fragments of a step
    cover it without gap or overlap. One owner is one text's steps and so bounded.
    """
    kind = steps.schema[owner].dataType.simpleString()
    ship_package(steps.sparkSession)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, chunk, used, held = [], 0, 0, 0
        for step, body in zip(pdf[order], pdf[text]):
            body = body or ""
            cuts = word_cuts(body, max_tokens) if count is count_words else counted_cuts(body, max_tokens, count)
            for k, (begin, end, n) in enumerate(cuts or [(0, 0, 0)]):
                more = k + 1 < len(cuts)  # what is left of the step does not fit any chunk whole
                if held and (held >= max_steps or more or used + n > max_tokens):
                    chunk, used, held = chunk + 1, 0, 0
                out.append((pdf[owner].iloc[0], chunk, int(step), begin, end, n))
                used, held = used + n, held + 1
        return pd.DataFrame(out, columns=[owner, "chunk", "step", "span_start", "span_end", "n_tokens"])

    return steps.select(owner, order, text).groupBy(owner).applyInPandas(pack, f"{owner} {kind}, chunk long, step long, span_start long, span_end long, n_tokens long")
