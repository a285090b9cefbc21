"""Arguments of tools: types, names and selectors, checked before a tool runs."""

from __future__ import annotations

import fnmatch
import inspect
import math
from collections.abc import Callable, Iterable

# The types of arguments, and the codes of refusals.
TYPES = ("string", "boolean", "integer", "number")
UNKNOWN_TOOL, BAD_ARGUMENTS = -32601, -32602
_DECLARED = {"str": "string", "bool": "boolean", "int": "integer", "float": "number"}


class Refused(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def coerce(key: str, value: object, declared: str) -> object:
    """The value as its type: whole floats and numeric text are integers, numeric text is a number, and a boolean is neither.
    Other declared types let anything through."""
    flag = isinstance(value, bool)
    fine = {"string": isinstance(value, str), "boolean": flag, "integer": isinstance(value, int) and not flag, "number": isinstance(value, (int, float)) and not flag}
    if fine.get(declared, True):
        return value
    if declared in ("integer", "number") and not flag and isinstance(value, (str, float)):
        try:
            number = float(value) if declared == "number" else value if isinstance(value, float) else int(value)
        except ValueError:
            number = math.nan
        if declared == "number" and (isinstance(value, float) or not math.isnan(number) or str(value).strip().lower() == "nan"):
            return number
        if declared == "integer" and isinstance(number, (int, float)) and math.isfinite(number) and number == int(number):
            return int(number)
    raise Refused(BAD_ARGUMENTS, f"{key} (expected {declared}, got {'null' if value is None else type(value).__name__})")


def call(tools: object, name: str, arguments: dict, shown: Iterable[str] | None = None):
    """Call a tool by name; unknown or hidden tools, undeclared, mistyped and missing arguments are refused, all at once."""
    method: Callable | None = None if name.startswith("_") else getattr(tools, name, None)
    if not callable(method) or (shown is not None and name not in set(shown)):
        raise Refused(UNKNOWN_TOOL, f"unknown tool {name}")
    declared = inspect.signature(method).parameters
    wrong = [f"{k} (not declared)" for k in arguments if k not in declared]
    wrong += [f"{k} (missing)" for k, p in declared.items() if p.default is p.empty and p.kind is not p.VAR_KEYWORD and k not in arguments]
    given = {}
    for k, v in arguments.items():
        if k in declared:
            kind = str(declared[k].annotation).split("|")[0].strip()
            optional = v is None and declared[k].default is None
            try:
                given[k] = v if optional else coerce(k, v, _DECLARED.get(kind, "any"))
            except Refused as e:
                wrong.append(str(e))
    if wrong:
        raise Refused(BAD_ARGUMENTS, "; ".join(wrong))
    return method(**given)


def select_tools(selectors: Iterable[str], names: Iterable[str]) -> list[str]:
    """Tools that any selector names, exactly or with ``*``; one that names none is an error."""
    known = sorted(names)
    found: set[str] = set()
    for s in selectors:
        hits = [n for n in known if fnmatch.fnmatchcase(n, s)] if "*" in s else [n for n in known if n == s]
        if not hits:
            raise ValueError(f"no tool is named {s!r}")
        found.update(hits)
    return sorted(found)
