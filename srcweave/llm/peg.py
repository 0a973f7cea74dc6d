"""A small packrat parser: PEG text in, memoised matching at any offset, captures out.

``Name <- expression`` per line; ``/`` ordered choice, ``? * +``, ``! &`` predicates, ``( )``; terminals are regular
expressions between slashes' place-holders ``~...~`` or literals in single quotes; ``name:Rule`` captures the
matched range. Each (rule, offset) is evaluated once, so matching is linear in the text it looks at. Rules may also be
functions (text, offset) -> end or None: what nests is matched by them, so that its depth takes no calls.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(r"\s*(~(?:[^~])*~|'[^']*'|<-|\w+:|\w+|[()/?*+!&])")


class Grammar:
    def __init__(self, text: str, calls: dict[str, Callable[[str, int], int | None]] | None = None):
        self.rules = {name: ("call", f) for name, f in (calls or {}).items()}
        for line in text.strip().splitlines():
            name, _, body = line.partition("<-")
            toks = _TOKEN.findall(body)
            self.rules[name.strip()], rest = self._choice(toks, 0)
            if rest != len(toks):
                raise ValueError(f"cannot read {line!r} at {toks[rest:]}")

    def _choice(self, t: list[str], i: int):
        options = []
        while True:
            seq, i = self._sequence(t, i)
            options.append(seq)
            if i < len(t) and t[i] == "/":
                i += 1
                continue
            return (options[0] if len(options) == 1 else ("choice", options)), i

    def _sequence(self, t: list[str], i: int):
        items = []
        while i < len(t) and t[i] not in ("/", ")"):
            prefix = None
            if t[i] in "!&":
                prefix, i = t[i], i + 1
            label = None
            if t[i][-1] == ":" and t[i][0] not in "'~":
                label, i = t[i][:-1], i + 1
            if t[i] == "(":
                x, i = self._choice(t, i + 1)
                i += 1
            else:
                w = t[i]
                x = ("re", re.compile(w[1:-1])) if w[0] == "~" else ("re", re.compile(re.escape(w[1:-1]))) if w[0] == "'" else ("rule", w)
                i += 1
            if i < len(t) and t[i] in "?*+":
                x = (t[i], x)
                i += 1
            if label:
                x = ("label", label, x)
            items.append((prefix, x) if prefix else x)
        return ("seq", items), i

    def match(self, text: str, rule: str, pos: int) -> tuple[int, dict[str, tuple[int, int]]] | None:
        """(end, captures) or None; later captures of a name win."""
        memo: dict[tuple[str, int], tuple[int, tuple] | None] = {}

        def run(x, p: int):
            kind = x[0]
            if kind == "re":
                m = x[1].match(text, p)
                return (m.end(), ()) if m else None
            if kind == "call":
                e = x[1](text, p)
                return None if e is None else (e, ())
            if kind == "rule":
                key = (x[1], p)
                if key not in memo:
                    memo[key] = None  # a left recursion fails
                    memo[key] = run(self.rules[x[1]], p)
                return memo[key]
            if kind == "seq":
                caps = ()
                for y in x[1]:
                    r = run(y, p)
                    if r is None:
                        return None
                    p = r[0]
                    caps += r[1]
                return p, caps
            if kind == "choice":
                for y in x[1]:
                    r = run(y, p)
                    if r is not None:
                        return r
                return None
            if kind == "label":
                r = run(x[2], p)
                return None if r is None else (r[0], r[1] + ((x[1], p, r[0]),))
            if kind == "!":
                return (p, ()) if run(x[1], p) is None else None
            if kind == "&":
                return (p, ()) if run(x[1], p) is not None else None
            if kind == "?":
                return run(x[1], p) or (p, ())
            caps, n = (), 0
            while (r := run(x[1], p)) is not None and r[0] > p:
                p, caps, n = r[0], caps + r[1], n + 1
            return None if kind == "+" and not n else (p, caps)

        r = run(("rule", rule), pos)
        return None if r is None else (r[0], {n: (a, b) for n, a, b in r[1]})
