"""Literals that every match of a regex must hold.

They come from the regex's parse tree. A part that matches few strings only is known exactly, and
neighbours that are known so are joined; where something unknown stands between, the strings so
far are required by themselves. An alternation requires one string of one of its branches. What
is found is a list of groups: any match contains, of each group, one literal.

Only what Python's parser and Java read alike is used; from a regex with anything else nothing is
derived, and it runs on every text.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
import warnings
from dataclasses import dataclass
from itertools import product

#: Strings of a part that are told apart, their length, and literals that a group may have.
STRINGS, LENGTH, GROUP = 16, 64, 40
#: Characters of a class that are told apart.
CLASS = 6
#: Groups of an alternation's branches that are combined.
COMBINED = 12
#: Groups that a scan looks up for a rule.
ANCHORS = 2
#: Letters that the literals of a second group must have to be worth it.
LEAST = 3

Strings = frozenset[str]
NOTHING: Strings = frozenset([""])


@dataclass(frozen=True)
class Part:
    """What a part of a regex matches: all its strings if few; else the groups that it requires, and the
    strings that it begins and ends with, if known."""

    exact: Strings | None = None
    groups: tuple[Strings, ...] = ()
    first: Strings = NOTHING
    last: Strings = NOTHING


UNKNOWN = Part()


def _joined(a: Strings, b: Strings) -> Strings | None:
    if len(a) * len(b) > STRINGS or max(map(len, a)) + max(map(len, b)) > LENGTH:
        return None
    return frozenset(x + y for x, y in product(a, b))


def minimal(group: Strings) -> Strings:
    """Without literals that contain another one."""
    return frozenset(x for x in group if not any(y != x and y in x for y in group))


def _required(strings: Strings) -> tuple[Strings, ...]:
    found = minimal(strings)
    return () if "" in strings or len(found) > GROUP else (found,)


def _sequence(items, fold: bool) -> Part:
    known, groups, whole, first = NOTHING, [], True, None
    for op, value in items:
        part = _node(op, value, fold)
        both = _joined(known, part.exact if part.exact is not None else part.first)
        if part.exact is not None and both is not None:
            known = both
            continue
        if whole:  # what the sequence begins with
            first, whole = (known if both is None else both), False
        if part.exact is not None:
            groups += _required(known)
            known = part.exact
        else:
            groups += [*(_required(both) if both is not None else _required(known)), *part.groups]
            known = part.last
    if whole:
        return Part(known, _required(known), known, known)
    return Part(None, (*groups, *_required(known)), first, known)


def _branches(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        every = frozenset().union(*(p.exact for p in parts))
        if len(every) <= STRINGS:
            return Part(every, _required(every), every, every)
    options = [sorted(p.groups, key=_strength, reverse=True) for p in parts]
    if not all(options):
        return UNKNOWN
    combined = 1
    for o in options:
        combined *= len(o)
    chosen = product(*options) if combined <= COMBINED else [tuple(o[0] for o in options)]
    groups = [g for c in chosen for g in _required(frozenset().union(*c))]
    return Part(None, tuple(dict.fromkeys(groups)))


def _repeat(least: int, most: int, part: Part) -> Part:
    if least == 0:
        return Part(part.exact | NOTHING, (), part.exact | NOTHING, part.exact | NOTHING) if most == 1 and part.exact is not None else UNKNOWN
    if part.exact is None:
        return Part(None, part.groups, part.first, part.last)
    run: Strings | None = NOTHING
    for _ in range(min(least, LENGTH + 1)):
        longer = _joined(run, part.exact)
        if longer is None:
            return Part(None, (*_required(run), *part.groups), run, run)
        run = longer
    if least == most and least <= LENGTH:
        return Part(run, _required(run), run, run)
    return Part(None, _required(run), run, run)


def _class(members) -> Part:
    found = set()
    for op, value in members:
        if op is ops.LITERAL:
            found.add(value)
        elif op is ops.RANGE and value[1] - value[0] < CLASS:
            found.update(range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    return _characters(found)


def _characters(found: set[int]) -> Part:
    if len(found) > CLASS:
        return UNKNOWN
    exact = frozenset(map(chr, found))
    return Part(exact, _required(exact), exact, exact)


def _node(op, value, fold: bool) -> Part:
    if op is ops.LITERAL or op is ops.IN:
        part = _characters({value}) if op is ops.LITERAL else _class(value)
        if fold and part.exact is not None:
            # case folds simply among ASCII letters only
            exact = frozenset(x.lower() for x in part.exact)
            return Part(exact, _required(exact), exact, exact) if all(x.isascii() for x in exact) else UNKNOWN
        return part
    if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return Part(NOTHING)
    if op is ops.SUBPATTERN:
        _, added, removed, inner = value
        return UNKNOWN if added or removed else _sequence(inner, fold)
    if op is ops.ATOMIC_GROUP:
        return _sequence(value, fold)
    if op is ops.BRANCH:
        return _branches([_sequence(b, fold) for b in value[1]])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        least, most, inner = value
        return _repeat(least, most, _sequence(inner, fold))
    return UNKNOWN


def _differs(regex: str) -> bool:
    r"""Whether the two dialects may read the regex differently: classes in classes and their intersections, \v, \b{, and
    numbers that may be octal or a reference."""
    if re.search(r"\\(?:v|b\{|N|[0-9]{2})", regex.replace("\\\\", "")):
        return True
    inside, i = False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif not inside and c == "[":
            inside = True
            i += regex.startswith("^", i + 1)
            if regex.startswith("]", i + 1):
                return True
        elif inside and (c == "[" or regex.startswith("&&", i)):
            return True
        elif c == "]":
            inside = False
        i += 1
    return False


def required(regex: str, ignores_case: bool = False) -> list[Strings]:
    """Groups of literals of which any match of ``regex`` (without its leading ``(?i)``) holds one each; in lower case if
    it ignores case, where it may instead hold other letters that fold to them."""
    if _differs(regex):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            # a named group is written differently
            tree = parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", regex))
    except (re.error, Warning, OverflowError, RecursionError, ValueError):
        return []
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE | re.LOCALE):
        return []
    found = list(dict.fromkeys(_sequence(tree, ignores_case).groups))
    return [g for g in found if not any(h != g and _implies(h, g) for h in found)]


def _implies(a: Strings, b: Strings) -> bool:
    """Whether a text with a literal of ``a`` has one of ``b``."""
    return all(any(y in x for y in b) for x in a)


def _strength(group: Strings) -> tuple[int, int]:
    return min(map(len, group)), -len(group)


def anchors(regex: str, ignores_case: bool = False) -> tuple[tuple[str, ...], ...]:
    """The groups most worth looking up: those with the longest literals, the best first."""
    first, *others = sorted(required(regex, ignores_case), key=_strength, reverse=True) or [None]
    chosen = [first, *(g for g in others if _strength(g)[0] >= LEAST)][:ANCHORS] if first else []
    return tuple(tuple(sorted(g)) for g in chosen)
