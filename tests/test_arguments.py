"""Arguments of tools."""

from __future__ import annotations

import pytest

from tessellum.arguments import BAD_ARGUMENTS, UNKNOWN_TOOL, Refused, call, coerce, select_tools


class Some:
    def find(self, name: str, n: int = 5, wide: bool = False, share: float = 0.5, wing: str | None = None):
        return name, n, wide, share, wing


def test_coerce():
    assert [coerce("k", v, "integer") for v in (3, 3.0, "7", " 8 ")] == [3, 3, 7, 8] and coerce("k", "1.5", "number") == 1.5 and coerce("k", 2, "number") == 2 and coerce("k", [1], "array") == [1]
    for value, kind in ((True, "integer"), (None, "integer"), (1.5, "integer"), ("x", "integer"), (float("inf"), "integer"), (True, "number"), ("x", "number"), (1, "string"), (1, "boolean"), (None, "string")):
        with pytest.raises(Refused):
            coerce("k", value, kind)


def test_call():
    assert call(Some(), "find", {"name": "a", "n": "3", "wing": None}) == ("a", 3, False, 0.5, None)
    for name, arguments, code, said in (("gone", {}, UNKNOWN_TOOL, "gone"), ("_x", {}, UNKNOWN_TOOL, "_x"), ("find", {}, BAD_ARGUMENTS, "name (missing)"), ("find", {"name": "a", "q": 1, "n": True}, BAD_ARGUMENTS, "q (not declared); n (expected integer, got bool)")):
        with pytest.raises(Refused) as e:
            call(Some(), name, arguments)
        assert e.value.code == code and said in str(e.value)
    with pytest.raises(Refused):
        call(Some(), "find", {"name": "a"}, shown=["other"])


def test_selectors():
    names = ["search", "diary_read", "diary_write"]
    assert select_tools(["diary_*", "search"], names) == ["diary_read", "diary_write", "search"]
    with pytest.raises(ValueError):
        select_tools(["kg_*"], names)
