"""CSS selectors over a node array (checked on the driver, run on Spark).

Supported: tag, *, #id, .class, [attr], [attr=value] (also ^= $= *= ~= |=), :nth-of-type, :nth-child and :nth-last-child (a number, odd, even, or
an+b), :first-child, :last-child, :only-child, :first-of-type, :empty, :root, :not(...) with a list of simple selectors, the
four combinators, and comma lists.

A selector is matched part by part from the left. Of each part an array of flags by position says which elements complete it, and the next part
looks its combinator up in that array: the parent's flag, the flag of the sibling before, whether something on the way up is flagged, whether an earlier
sibling is. Each is one near-linear pass, whatever the depth of the page.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let
from .prefix import lies_in, running_sum

_PART = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)"
    r"|#(?P<id>(?:\\.|[\w-])+)"
    r"|\.(?P<cls>(?:\\.|[\w-])+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]"
    r"|:(?P<place>nth-of-type|nth-child|nth-last-child)\(\s*(?P<arg>[^)]*?)\s*\)"
    r"|:(?P<word>first-child|last-child|only-child|first-of-type|last-of-type|empty|root)"
    r"|:not\((?P<no>(?:[^()]|\([^()]*\))*)\)"
)
_AN_B = re.compile(r"(?:(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))$")


class BadSelector(ValueError):
    pass


def _compound(text: str) -> list[dict]:
    parts, pos = [], 0
    while pos < len(text):
        m = _PART.match(text, pos)
        if not m:
            raise BadSelector(f"unsupported selector: {text}")
        parts.append({k: v for k, v in m.groupdict().items() if v is not None})
        pos = m.end()
    if not parts:
        raise BadSelector("empty selector")
    return parts


def _split(selector: str, stops: str) -> list[str]:
    """Cut at any of ``stops`` outside brackets, quotes and escapes; the stops themselves are kept as pieces."""
    out, depth, quote, i = [""], 0, "", 0
    while i < len(selector):
        c = selector[i]
        if c == "\\":
            out[-1] += selector[i:i + 2]
            i += 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and depth:
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        if c in stops and not depth and not quote:
            out += [c, ""]
        else:
            out[-1] += c
        i += 1
    return out


def _steps(selector: str) -> list[tuple[str, list[dict]]]:
    """[(combinator before, compound)] from left to right."""
    out, comb = [], ""
    for piece in _split(selector.strip(), " \t\n>+~"):
        if piece in ("", " ", "\t", "\n"):
            comb = comb or (" " if out and piece else "")
        elif piece in (">", "+", "~"):
            if not out or comb.strip():
                raise BadSelector(f"unsupported selector: {selector}")
            comb = piece
        else:
            out.append((comb if out else "", _compound(piece)))
            comb = ""
    if not out or comb.strip():
        raise BadSelector(f"unsupported selector: {selector}")
    return out


def _an_b(arg: str) -> tuple[int, int]:
    """(a, b) of a place like 3, odd, 2n+1 or -n + 3."""
    known = {"odd": (2, 1), "even": (2, 0)}
    m = _AN_B.match(arg.lower().lstrip())
    if arg.lower() in known:
        return known[arg.lower()]
    if not m:
        raise BadSelector(f"unsupported place: {arg}")
    if m["only"]:
        return 0, int(m["only"])
    return int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"]), int((m["sign"] or "") + (m["b"] or "0"))


def _at_place(place: Column, arg: str) -> Column:
    a, b = _an_b(arg)
    if a == 0:
        return place == b
    return (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place >= b) if a > 0 else (place <= b))


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _word(n: Column, word: str) -> Column:
    return {
        "first-child": n["pos"] == 1, "last-child": n["pos"] == n["pos_n"], "only-child": n["pos_n"] == 1,
        "first-of-type": n["nth"] == 1, "last-of-type": n["nth"] == n["nth_n"],
        "empty": n["last"] == n["ord"], "root": n["parent"].isNull(),
    }[word]


def _test(n: Column, parts: list[dict]) -> Column:
    ok = n["kind"] == "element"
    for p in parts:
        if "tag" in p:
            if p["tag"] != "*":
                ok = ok & (n["tag"] == p["tag"].lower())
        elif "id" in p:
            ok = ok & (F.try_element_at(n["attrs"], F.lit("id")) == _plain(p["id"]))
        elif "cls" in p:
            classes = F.split(F.coalesce(F.try_element_at(n["attrs"], F.lit("class")), F.lit("")), "\\s+")
            ok = ok & F.array_contains(classes, _plain(p["cls"]))
        elif "place" in p:
            place = {"nth-of-type": n["nth"], "nth-child": n["pos"], "nth-last-child": n["pos_n"] - n["pos"] + 1}[p["place"]]
            ok = ok & _at_place(place, p["arg"])
        elif "word" in p:
            ok = ok & _word(n, p["word"])
        elif "no" in p:
            for other in _split(p["no"], ","):
                if other != ",":
                    ok = ok & ~_test(n, _compound(other.strip()))
        else:
            value = F.try_element_at(n["attrs"], F.lit(p["attr"].lower()))
            if "op" not in p:
                ok = ok & value.isNotNull()
                continue
            want = p["val"].strip("\"'")
            some = F.lit(bool(want))
            tests = {
                "=": value == want, "^=": value.startswith(want) & some, "$=": value.endswith(want) & some,
                "*=": value.contains(want) & some, "~=": F.array_contains(F.split(value, "\\s+"), want) & some,
                "|=": (value == want) | value.startswith(want + "-"),
            }
            ok = ok & tests[p["op"]]
    return F.coalesce(ok, F.lit(False))


def _earlier_sibling(nodes: Column, flags: Column) -> Column:
    """Whether a sibling before an element is flagged.

    In the order of (parent, place) elements stand beside their siblings; a running count of flags, less the count before the first sibling, tells.
    """
    rows = F.zip_with(nodes, flags, lambda n, f: F.struct(
        F.coalesce(n["parent"], F.lit(-1)).alias("parent"), F.coalesce(n["pos"], F.lit(0)).alias("pos"), n["ord"].alias("ord"), f.cast("bigint").alias("f")))

    def found(o: Column, count: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(count, i - 1)).otherwise(F.lit(0).cast("bigint"))
        hits = F.transform(o, lambda x, i: F.struct(x["ord"], ((x["pos"] > 0) & (before(i) > before(i - x["pos"] + 1))).alias("hit")))
        return F.transform(F.array_sort(hits), lambda x: x["hit"])

    return let(F.array_sort(rows), lambda o: let(running_sum(F.transform(o, lambda x: x["f"])), lambda count: found(o, count)))


def css_flags(selector: str) -> Callable[[Column], Column]:
    """``f(nodes)``: array<boolean>, which nodes of the (unstripped) array the selector matches."""
    groups = [_steps(s) for s in _split(selector, ",") if s != ","]
    for steps in groups:  # places are read here, before any job
        for _, parts in steps:
            for p in parts:
                if "place" in p:
                    _an_b(p["arg"])
                for other in _split(p.get("no", "*"), ","):
                    if other != ",":
                        _compound(other.strip())

    def looked_up(nodes: Column, flags: Column, comb: str) -> Column:
        if comb == ">":
            return F.transform(nodes, lambda n: F.coalesce(F.get(flags, n["parent"]), F.lit(False)))
        if comb == "+":
            return F.transform(nodes, lambda n: F.coalesce(F.get(flags, n["prev"]), F.lit(False)))
        return _earlier_sibling(nodes, flags) if comb == "~" else lies_in(nodes, flags)

    def chain(nodes: Column, steps: list[tuple[str, list[dict]]]) -> Column:
        comb, parts = steps[-1]
        here = F.transform(nodes, lambda n: _test(n, parts))
        if len(steps) == 1:
            return here
        return let(chain(nodes, steps[:-1]), lambda before: F.zip_with(here, looked_up(nodes, before, comb), lambda a, b: a & b))

    def flags(nodes: Column) -> Column:
        out = chain(nodes, groups[0])
        for steps in groups[1:]:
            out = F.zip_with(out, chain(nodes, steps), lambda a, b: a | b)
        return out

    return flags
