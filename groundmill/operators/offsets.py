"""Normalisation that can be undone: keys with a map from each of their characters to the text's."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAPPED = "struct<norm:string,map:array<int>>"
_KEPT = re.compile(r"[\w\s/+.-]")
#: White space by code point; the last one stands for all beyond.
_BLANK = np.array([chr(i).isspace() for i in range(0x3002)])


def squeezed(text: str) -> tuple[str, np.ndarray]:
    """White space collapsed to single blanks and trimmed: each run stands where it began."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(x, len(_BLANK) - 1)]
    kept = ~blank
    kept[1:] |= kept[:-1] & blank[1:]
    at = np.flatnonzero(kept)
    if len(at) and blank[at[-1]]:
        at = at[:-1]
    return np.where(blank[at], 32, x[at]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at


def keyed(text: str, toneless: bool = False) -> tuple[str, list[int]]:
    """The lookup key, character by character: NFKC, lower case, other signs and runs of blanks as one blank."""
    out, at = [], []
    for i, c in enumerate(text):
        unit = unicodedata.normalize("NFKC", c).lower()
        if toneless:
            unit = "".join(x for x in unicodedata.normalize("NFD", unit) if unicodedata.category(x) != "Mn").replace("đ", "d")
        for u in unit:
            u = u if _KEPT.fullmatch(u) and not u.isspace() else " "
            if u != " " or not out or out[-1] != " ":
                out.append(u)
                at.append(i)
    return "".join(out), at


def _mapped(f: Callable[[str], tuple[str, Sequence[int]]]):
    @F.arrow_udf(MAPPED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [None if x is None else f(x) for x in texts.to_pylist()]
            maps = [np.asarray([] if g is None else g[1], np.int32) for g in got]
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in maps])]).astype(np.int32)
            missing = pa.array([g is None for g in got], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*maps, np.zeros(0, np.int32)])), mask=missing)
            yield pa.StructArray.from_arrays([pa.array([g and g[0] for g in got], pa.string()), lists], ["norm", "map"])

    return run


def collapse_whitespace(text: Column) -> Column:
    """(norm, map) of ``squeezed``."""
    return _mapped(squeezed)(text)


def normalize_with_offsets(text: Column, toneless: bool = False) -> Column:
    """(norm, map) of ``keyed``."""
    return _mapped(lambda x: keyed(x, toneless))(text)


def original_span(mapped: Column, start: Column, end: Column) -> Column:
    """A span of the key as a span of the text; null if it is empty or out of range."""
    inside = (start >= 0) & (start < end) & (end <= F.size(mapped["map"]))
    span = F.struct(F.get(mapped["map"], start).alias("start"), (F.get(mapped["map"], end - 1) + 1).alias("end"))
    return F.when(inside, span)


def contract_issues(mapped: Column, text: Column, collapsed: Column | bool = True) -> Column:
    """What breaks the contract: a map of another length, positions out of range, or not rising (strictly, if ``collapsed``)."""
    m = mapped["map"]
    pairs = F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda a, b: F.when(F.lit(collapsed), a < b).otherwise(a <= b))
    return F.array_compact(F.array(
        F.when(F.size(m) != F.length(mapped["norm"]), "length"),
        F.when((F.array_min(m) < 0) | (F.array_max(m) >= F.length(text)), "range"),
        F.when(F.exists(pairs, lambda ok: F.coalesce(~ok, F.lit(False))), "order"),
    ))
