"""Credentials embedded in source code and settings.

A multi-pattern automaton finds the lines that speak of secrets; their literals, comment values, URL parts
and connection-string parts become candidates with the identifiers around them. Weak labels come from
patterns (well-known token shapes, stand-ins, names). A logistic regression over the character Markov
likelihood of the value, its shape, the identifiers and the path is trained on all distinct labelled candidates but
a fifth and calibrated on that held-out fifth; letter pairs and Newton steps are summed over the tasks, so only sums
of a fixed size reach the driver. The calibrated score decides, and only the value's characters are masked.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcweave.session import Scratch

THRESHOLD = 0.5
#: Labelled candidates below which none are held out, and features of a candidate.
LEAST_HELD, WIDTH = 100, 25

#: Words that bring a line into question, lower case. Fixed values.
HINTS = (
    "pass", "pwd", "secret", "key", "credential", "private", "signing", "signature", "token", "bearer", "basic", "auth", "login", "signin", "sign_in", "connect", "conn", "dsn", "://", "begin",
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat", "xox", "pat_", "pat-", "tok-", "tok_", "svc-", "svc_", "_live_", "sk-", "eyj", "aiza", "owm", "appid", "salt", "sas", "sharedaccess", "hmac", "jwt", "sig=",
)
SECRET_NAME = re.compile(r"(?i)pass(?!ive|enger|port|ing|ed\b|age)(?:w(?:or)?d|phrase|_phrase|code|$|_?\d*$)|passwd|pwd|secret|api[-_ ]?key|apikey|credential|private[-_ ]?key|(?:access|auth|signing|shared|account|client|master|session|encryption|storage|sas|owm|service|webhook|deploy|license|hmac|jwt)[-_ ]?(?:access[-_ ]?)?key|token|authoriz|auth[-_]?(?:header)?$|bearer|basic$|_?dsn$|conn(?:ection)?(?:[-_]?str(?:ing)?)?$|salt$|\bsas\b|^key$|appid")
CALLEE = re.compile(r"(?i)(?:login|log_in|signin|sign_in|authenticate|connect|auth|authorize|with_?credentials|set_?password)\s*\((?:[^()]*,)?\s*$")
PLAIN_NAME = re.compile(r"(?i)commit|sha\d*\b|sha$|checksum|digest|hash|etag|chunk|(?:^|_)id$|Id$|uuid|guid|revision|png|icon|image|img|logo|label|title|message|prompt|placeholder|hint|url$|path|file|verify|public|fingerprint|integrity|nonce|version|limit|name$|count|getenv|environ")
STANDIN = re.compile(
    r"(?i)^\s*$|^[*x.\-_•?0#]{3,}$|^<.*>$|^\[.*\]$|^\$\{?\{?.*\}?$|^\$[a-z_]\w*$|^#\{.*\}#?$|^\{\{.*\}\}$|^%\w*%$|^%[sdv]$|^\{[\w.]*\}$|^__.*__$|^(?:env|vault|ssm|secret|secrets|secretsmanager|keyvault|aws|gcp|azure|file|op|kms|config|ref)[:/]|^@microsoft|process\.env|getenv|environ|"
    r"^(?:your|my|the|some|enter|insert|add|put|paste)[-_ ]|\byour[-_ ]|changeme|change[-_]me|placeholder|goes[-_ ]here|not[-_ ]configured|set[-_ ](?:me|in)|to[-_ ]?be[-_ ]?set|dummy|redacted|replace[-_ ]?(?:me|this)|fill[-_ ]?in|^(?:example|sample|todo|tbd|none|null|nil|undefined|true|false|test|string|password|passwd|secret|token|key|value|redis|user|username|root|admin|localhost)$"
)
CAPS = re.compile(r"^[A-Z]+(?:_[A-Z]+)*$")
KNOWN = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bglpat-[\w-]{20,}|\bxox[abprs]-[\w-]{10,}|\b\w{2}_live_[A-Za-z0-9]{10,}|\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|\bAIza[\w-]{35}|\b(?:tok|pat|svc|key)[-_.][A-Za-z0-9]{16,}")
LITERAL = re.compile(r"(?:[rRbBuUfF$@]{0,2})(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)")
JOIN = re.compile(r"\s*(?:\+|\.\.|\.|\\)?\s*$")
PART = re.compile(r"(?i)(?<![a-z])(password|passwd|pwd|pass|sharedaccesskey|accountkey|accesskey|secretkey|clientsecret|apikey|api_key|token|sig|secret)\s*=\s*(\"[^\"]*\"|'[^']*'|\{\{[^}]*\}\}|\$?#?\{[^}]*\}#?|<[^>]*>|[^;&\s\"'`,]*)")
URL = re.compile(r"[a-z][a-z0-9+.-]*://[^/\s:@\"'`]*:([^/\s\"'`]+?)@(?=[\w.\[-])", re.I)
QUERY = re.compile(r"(?i)[?&](?:token|api_?key|apikey|appid|access_token|secret|password|pwd|sig)=([^&\s\"'`<>{}$%]+)")
HEADER = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9._~+/=-]+)")
REMARK = re.compile(r"(?i)\b(passw(?:or)?d|passwd|pwd|passphrase|key|token|secret|credential|pass|pw)\b(?:\s+(?:is|was|for \w+|of \w+))?\s*[:=]?\s+?[\"'`]?([^\s\"'`,;)]+)|\b(passw(?:or)?d|key|token|secret)\s*[:=]\s*[\"'`]?([^\s\"'`,;)]+)")
COMMENT = re.compile(r"^\s*(?://+|#+|\*+|/\*+|--|;|<!--)(.*)$|(?:\s//\s|\s#\s|/\*)(.*)$")
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_PART = re.compile(r"[A-Za-z0-9+/=]+")
_BLOCK_LINE = re.compile(r"\n[ \t\"'+,*#/]*[A-Za-z0-9+/=]{16,}(?:\\[rn])*[ \t\"'+,;\\]*\r?(?=\n|$)")
HEX = re.compile(r"^[0-9a-fA-F]{16,}$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


#: Kinds whose place alone speaks of a secret, whatever the name.
SURE = ("url", "part", "header", "call", "pem", "query")


@dataclass
class Candidate:
    start: int  # of the value in the text
    spans: list[tuple[int, int]]  # all parts of the value
    value: str
    name: str  # the identifier next to it
    kind: str  # pem, url, part, header, query, literal, call, remark


@lru_cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for h in HINTS:
        a.add_word(h, h)
    a.make_automaton()
    return a


def _name_before(before: str) -> tuple[str, str]:
    """(identifier or key that the literal after ``before`` belongs to, kind)."""
    if CALLEE.search(before):
        return "login", "call"
    m = re.search(r"[\"'`]([\w. -]+)[\"'`]\s*[\])]?\s*(?:[:,=]|=>|:=)\s*$", before)
    if m:
        return m[1], "literal"
    m = re.search(r"([A-Za-z_$][\w$-]*)\s*[\"']?\s*\]?\s*(?::\s*[\w<>\[\], .|?]+?)?\s*(?::=|=>|==?|:|\()\s*\(?\s*$", before)
    return (m[1], "literal") if m else ("", "literal")


def candidates(text: str) -> list[Candidate]:
    """All values in ``text`` that may be secrets, on the lines that a hint brings up."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[Candidate] = []
    done = -1
    for end, _ in automaton().iter(low):
        if end < done:
            continue
        a = low.rfind("\n", 0, end) + 1
        b = low.find("\n", end)
        b = len(low) if b < 0 else b
        done = b
        _line(text, a, b, out)
    return out


def _block_end(text: str, at: int) -> int:
    """End of the key lines from ``at`` on, for blocks without an end mark."""
    while m := _BLOCK_LINE.match(text, at):
        at = m.end()
    return at


def _line(text: str, a: int, b: int, out: list[Candidate]) -> None:
    line = text[a:b].rstrip("\r")
    if (m := BEGIN.search(line)):
        stop = END.search(text, b)
        last = stop.start() if stop and not BEGIN.search(text, b, stop.start()) else _block_end(text, b)
        spans = [x.span() for x in _BLOCK_PART.finditer(text, a + m.end(), last)]
        if any(y - x >= 30 for x, y in spans):
            out.append(Candidate(a + m.start(), spans, "PRIVATE KEY", "private key", "pem"))
        return
    taken: list[tuple[int, int]] = []

    def add(s: int, e: int, name: str, kind: str, spans: list[tuple[int, int]] | None = None, value: str | None = None) -> None:
        if any(s < y and e > x for x, y in taken):
            return
        taken.append((s, e))
        out.append(Candidate(a + s, [(a + x, a + y) for x, y in (spans or [(s, e)])], line[s:e] if value is None else value, name, kind))

    for m in URL.finditer(line):
        add(m.start(1), m.end(1), "url", "url")
    for m in QUERY.finditer(line):
        if "://" in line[: m.start()]:
            add(m.start(1), m.end(1), "query", "query")
    quoted = list(LITERAL.finditer(line))
    for m in PART.finditer(line):
        s, e = m.span(2)
        inside = next((q for q in quoted if q.start() < m.start() and e <= q.end()), None)
        conn = ";" in line[max(0, s - 200) : e + 200] or "jdbc:" in line or "&" in line or "?" in line[: m.start()]
        if not (inside and conn) and not (not quoted and conn):
            continue
        if s < e and line[s] in "\"'{" and not line[s : e].startswith("{{"):
            s, e = s + 1, e - 1
        add(s, e, m[1], "part")
    for m in HEADER.finditer(line):
        if any(c.isdigit() or c.isupper() for c in m[1][1:]):
            add(m.start(1), m.end(1), "authorization", "header")
    comment = COMMENT.match(line) if not quoted else COMMENT.match(line) if line.lstrip()[:1] in "/#*" else None
    if not comment:
        k = 0
        while k < len(quoted):
            q = quoted[k]
            parts = [q]
            while k + 1 < len(quoted) and re.fullmatch(r"\s*[+.\\]\s*", line[parts[-1].end() : quoted[k + 1].start()]):
                k += 1
                parts.append(quoted[k])
            k += 1
            spans = [(p.start(1) + 1, p.end(1) - 1) for p in parts]
            value = "".join(line[x:y] for x, y in spans)
            if not value or any(spans[0][0] <= x and y <= spans[-1][1] for x, y in taken) or re.match(r"\s*(?:[:\]]|=>|,\s*[\"'])", line[parts[-1].end() :]) and "," not in line[: q.start()] and re.match(r"\s*,\s*[\"'`]", line[parts[-1].end() :]):
                continue
            before = line[: q.start()]
            if not before.strip() and a > 1:
                before = text[max(0, text.rfind("\n", 0, a - 1) + 1) : a - 1].rstrip() + " "
            name, kind = _name_before(before)
            add(spans[0][0], spans[-1][1], name, kind, spans, value)
    else:
        for m in REMARK.finditer(line):
            g = 2 if m[2] else 4
            v = m[g].rstrip(".")
            if v:
                add(m.start(g), m.start(g) + len(v), m[g - 1], "remark")
    for m in KNOWN.finditer(line):
        add(m.start(), m.end(), "", "known")


def is_standin(v: str) -> bool:
    v = v.strip()
    return bool(STANDIN.search(v)) or bool(CAPS.match(v)) and len(v) < 40 and not re.search(r"[A-Z]{9}", v.replace("_", " ")) or len(set(v)) <= 2


class Markov:
    """Letter transitions of the plain words next to the candidates, with add-half smoothing."""

    def __init__(self, counts: dict[str, float] | None = None):
        self.counts = dict(counts or {})
        self.rows: dict[str, float] = defaultdict(float)
        for k, n in self.counts.items():
            self.rows[k[0]] += n

    @classmethod
    def of(cls, words: list[str]) -> Markov:
        counts: dict[str, float] = defaultdict(float)
        for w in words:
            w = f"^{w}"
            for x, y in zip(w, w[1:]):
                counts[x + y] += 1
        return cls(counts)

    def per_char(self, v: str) -> float:
        """Mean log-likelihood of the transitions inside the runs of letters and digits."""
        total, n = 0.0, 0
        for w in re.findall(r"[A-Za-z0-9]+", v):
            w = f"^{w}"
            for x, y in zip(w, w[1:]):
                total += math.log((self.counts.get(x + y, 0) + 0.5) / (self.rows.get(x, 0) + 32))
                n += 1
        return total / n if n else 0.0


def weak_label(value: str, name: str, kind: str) -> int | None:
    """1, 0 or None by patterns alone."""
    if kind == "pem":
        return 1
    if is_standin(value) or kind not in ("header",) and " " in value.strip() and kind != "part":
        return 0
    if KNOWN.search(value):
        return 1
    if kind not in SURE and PLAIN_NAME.search(name) and not SECRET_NAME.search(name):
        return 0
    digits, mixed = any(c.isdigit() for c in value), any(c.isupper() for c in value) and any(c.islower() for c in value)
    if kind in ("url", "part", "header", "query"):
        return 1 if len(value) >= 6 and (digits or mixed) else None
    if SECRET_NAME.search(name) or kind == "call":
        return 1 if digits and len(value) >= 6 else 0 if value.isalpha() and value.islower() else None
    return 0


def features(value: str, name: str, kind: str, path: str, words: Markov) -> list[float]:
    v = value.strip()
    n = max(1, len(v))
    up, lo, di = (sum(f(c) for c in v) / n for f in (str.isupper, str.islower, str.isdigit))
    secret = bool(SECRET_NAME.search(name)) or kind in SURE
    plain = bool(PLAIN_NAME.search(name)) and not secret
    flips = sum((x.isdigit() != y.isdigit()) or (x.isupper() != y.isupper()) for x, y in zip(v, v[1:])) / n
    return [
        1.0, words.per_char(v), min(n, 64) / 16, n < 6, up, lo, di, flips, di > 0, up > 0 and lo > 0, bool(HEX.match(v)), bool(UUID.match(v)), bool(KNOWN.search(v)), 3.0 * is_standin(v), " " in v and kind != "header", v.isalpha() and v.islower(),
        secret, plain, not name and kind == "literal", kind == "pem", kind == "remark", kind == "remark" and di == 0 and (up == 0 or v[1:].islower()), kind in ("url", "part"), kind == "header", bool(re.search(r"(?i)(^|/)(tests?|samples?|examples?|fixtures?|docs?)/", path)),
    ]


def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss at ``w``; those of parts of the rows add up."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; ``sums`` gives the moments over all rows."""
    w = np.zeros(width)
    for _ in range(steps):
        g, h = sums(w)
        step = np.linalg.solve(h + ridge * np.eye(width), g + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def targets(y: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Labels smoothed by their counts, for the calibration."""
    return np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))


def calibrated(w: np.ndarray, a: float, b: float) -> np.ndarray:
    """Weights whose logistic is the probability measured on the held-out candidates, by slope and offset of their scores."""
    if a <= 0:
        return w
    w = a * w
    w[0] += b  # the first feature is constant
    return w


def plain_words(value: str, name: str) -> list[str]:
    """Words next to a candidate that is no secret."""
    return [w.lower() for w in re.findall(r"[A-Za-z]{3,}", name + " " + value if value.islower() or " " in value else name)]


def own_view(words: Markov) -> tuple[np.ndarray, np.ndarray]:
    """Rows for tables that give labels of one kind only: the patterns' own view."""
    rows = [("8fK2mZq9Lx4TnB7v", "api_key", 1), ("lexer patch", "title", 0), ("${KEY}", "api_key", 0)]
    return np.array([features(v, n, "literal", "", words) for v, n, _ in rows], dtype=float), np.array([y for _, _, y in rows], dtype=float)


def train(sample: list[tuple[str, str, str, str]]) -> tuple[np.ndarray, dict[str, float]]:
    """Weights and Markov counts from a list of (value, name, kind, path) candidates by their weak labels; ``learn`` does the same over a table."""
    labels = [weak_label(v, n, k) for v, n, k, _ in sample]
    words = Markov.of([w for (v, n, k, _), y in zip(sample, labels) if y == 0 for w in plain_words(v, n)])
    rows = [(features(*s, words), y) for s, y in zip(sample, labels) if y is not None]
    x, y = np.array([r for r, _ in rows], dtype=float).reshape(len(rows), WIDTH), np.array([y for _, y in rows], dtype=float)
    if len(set(y)) < 2:  # nothing to learn from
        x, y = (np.concatenate(c) for c in zip((x, y), own_view(words)))
    held = np.arange(len(y)) % 5 == 4
    if len(y) < LEAST_HELD or len(set(y[~held])) < 2:
        return newton(lambda w: moments(x, y, w), WIDTH), words.counts
    w = newton(lambda w: moments(x[~held], y[~held], w), WIDTH)
    pos, neg = int(y[held].sum()), int((1 - y[held]).sum())
    if pos and neg:
        z, t = np.column_stack([x[held] @ w, np.ones(held.sum())]), targets(y[held], pos, neg)
        w = calibrated(w, *newton(lambda c: moments(z, t, c), 2, 1e-6))
    return w, words.counts


def learn(found: DataFrame, scratch: Scratch) -> tuple[np.ndarray, dict[str, float]]:
    """Like ``train`` over all distinct (value, name, kind, path) of ``found``; the held-out fifth is picked by hash.

    The driver gets the letter pairs (27 x 26 at most), four label counts and WIDTH x (WIDTH + 1) sums per Newton step.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(v, n, k, p, h, y) for v, n, k, p, h in zip(b["value"], b["name"], b["kind"], b["path"], b["held"]) if (y := weak_label(v, n, k)) is not None]
            yield pd.DataFrame(out, columns=[*key, "held", "y"], dtype=object)

    key = ["value", "name", "kind", "path"]
    distinct = found.select(key).distinct().withColumn("held", F.pmod(F.xxhash64(*key), F.lit(5)) == 4)
    schema = "value string, name string, kind string, path string, held boolean, y int"
    path = scratch.write(distinct.mapInPandas(label, schema))
    labelled = scratch.read(T._parse_datatype_string(schema), path)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Markov.of([])
        for b in batches:
            for k, n in Markov.of([w for v, n in zip(b["value"], b["name"]) for w in plain_words(v, n)]).counts.items():
                counts.counts[k] = counts.counts.get(k, 0) + n
        yield pd.DataFrame({"pair": pd.Series(list(counts.counts), dtype=object), "n": pd.Series(list(counts.counts.values()), dtype=float)})

    rows = labelled.where("y = 0").select("value", "name").mapInPandas(pairs, "pair string, n double").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    words = Markov({r["pair"]: r["n"] for r in rows})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(*c, words) for c in zip(*(b[c] for c in key))], dtype=float).reshape(len(b), WIDTH)
            y, held = b["y"].to_numpy(dtype=float), b["held"].to_numpy(dtype=bool)
            out = [(bool(h), int(y[held == h].sum()), int((1 - y[held == h]).sum()), x[held == h].tobytes(), y[held == h].tobytes()) for h in (False, True) if (held == h).any()]
            yield pd.DataFrame(out, columns=["held", "pos", "neg", "x", "y"], dtype=object)

    kept = scratch.keep(labelled.mapInPandas(blocks, "held boolean, pos long, neg long, x binary, y binary"))
    scratch.drop(path)
    n = {r["held"]: (r["pos"], r["neg"]) for r in kept.groupBy("held").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    (pos, neg), (held_pos, held_neg) = n.get(False, (0, 0)), n.get(True, (0, 0))

    def over(rows: DataFrame, w: np.ndarray, view=lambda x, y: (x, y)) -> tuple[np.ndarray, np.ndarray]:
        """The moments over all blocks of ``rows``, added up in the tasks and then by position."""
        d = len(w)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, h = np.zeros(d), np.zeros((d, d))
            for b in batches:
                for xb, yb in zip(b["x"], b["y"]):
                    more = moments(*view(np.frombuffer(xb).reshape(-1, WIDTH), np.frombuffer(yb)), w)
                    g, h = g + more[0], h + more[1]
            yield pd.DataFrame({"i": np.arange(d + d * d), "v": np.concatenate([g, h.ravel()])})

        total = np.zeros(d + d * d)
        for r in rows.select("x", "y").mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r["i"]] = r["v"]
        return total[:d], total[d:].reshape(d, d)

    if not pos + held_pos or not neg + held_neg:  # nothing to learn from
        fixed = own_view(words)
        return newton(lambda w: tuple(a + b for a, b in zip(over(kept, w), moments(*fixed, w))), WIDTH), words.counts
    if pos + neg + held_pos + held_neg < LEAST_HELD or not pos or not neg:
        return newton(lambda w: over(kept, w), WIDTH), words.counts
    fitted, rest = kept.where("not held"), kept.where("held")
    w = newton(lambda w: over(fitted, w), WIDTH)
    if held_pos and held_neg:
        w = calibrated(w, *newton(lambda c: over(rest, c, lambda x, y: (np.column_stack([x @ w, np.ones(len(x))]), targets(y, held_pos, held_neg))), 2, 1e-6))
    return w, words.counts


SCHEMA = "place string, record_id string, text_hash long, line_no int, value string, name string, kind string, path string, spans array<struct<a:int,b:int>>"


def _rows(place: str, record: str, h: int, text: str, path: str, found: list[Candidate]):
    breaks = np.array([i for i, c in enumerate(text) if c == "\n"]) if found else None
    for c in found:
        line = 0 if place != "chunk" else int(np.searchsorted(breaks, c.start))
        yield place, record, h, line, c.value, c.name, c.kind, path, [(int(x), int(y)) for x, y in c.spans]


def settings_candidates(place: str, text: str) -> list[Candidate]:
    if place == "apikey":
        m = re.match(r"\s*(?:[A-Za-z_-]+=)?(.*?)\s*$", text, re.S)
        if re.match(r"\s*[A-Za-z0-9+/]{20,}={1,2}\s*$", text):
            m = re.match(r"\s*(.*?)\s*$", text, re.S)
        return [Candidate(m.start(1), [m.span(1)], m[1], "api_key", "part")] if m[1] else []
    out: list[Candidate] = []
    for m in URL.finditer(text):
        out.append(Candidate(m.start(1), [m.span(1)], m[1], "url", "url"))
    for m in PART.finditer(text):
        s, e = m.span(2)
        if s < e and text[s] in "\"'{" and not text[s:e].startswith("{{"):
            s, e = s + 1, e - 1
        if s < e:
            out.append(Candidate(s, [(s, e)], text[s:e], m[1], "part"))
    return out


def credentials(chunks: DataFrame, settings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(place, record_id, text_hash, line_no, score, spans): each secret value once, with the offsets of its characters.

    ``chunks`` has (id, content, file_path), ``settings`` (settings_id, openweatherapi, connectionstrings).
    Null texts, ids, structs and fields hold no secrets. Repeated rows count once; an id with several texts
    counts for each, told apart by the hash of the text. The classifier is fitted on all labelled candidates, and every candidate is scored.
    The candidates' values are deleted from the shared folder before this returns; only places and offsets stay.
    """
    scratch = Scratch(chunks.sparkSession)
    texts = chunks.select(F.lit("chunk").alias("place"), F.col("id").cast("string").alias("record_id"), F.col("content").alias("t"), F.coalesce("file_path", F.lit("")).alias("path"))
    for place, field in (("apikey", "openweatherapi.apikey"), ("defaultconnection", "connectionstrings.defaultconnection")):
        texts = texts.unionByName(settings.select(F.lit(place).alias("place"), F.col("settings_id").cast("string").alias("record_id"), F.col(field).alias("t"), F.lit("").alias("path")))
    texts = texts.where("record_id is not null and t is not null").withColumn("h", F.xxhash64("t"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for place, record, h, t, path in zip(b["place"], b["record_id"], b["h"], b["t"], b["path"]):
                found = candidates(t) if place == "chunk" else settings_candidates(place, t)
                if found:
                    out.extend(_rows(place, record, h, t, path, found))
            f = pd.DataFrame(out, columns=["place", "record_id", "text_hash", "line_no", "value", "name", "kind", "path", "spans"])
            f["spans"] = pd.Series([[{"a": x, "b": y} for x, y in s] for s in f["spans"]], index=f.index, dtype=object)
            yield f

    raw = scratch.write(texts.mapInPandas(scan, SCHEMA))
    found = scratch.read(T._parse_datatype_string(SCHEMA), raw)
    weights, counts = learn(found, scratch)
    model = chunks.sparkSession.sparkContext.broadcast((weights, counts))  # letter pairs and weights: of a fixed size

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, c = model.value
        words, seen = Markov(c), {}
        for b in batches:
            out = []
            for key in zip(b["value"], b["name"], b["kind"], b["path"]):
                if key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[key] = float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(w, features(*key, words))))))))
                out.append(seen[key])
            b = b.assign(score=out)
            yield b.loc[b["score"] >= threshold, ["place", "record_id", "text_hash", "line_no", "score", "spans"]]

    scored = found.mapInPandas(score, "place string, record_id string, text_hash long, line_no int, score double, spans array<struct<a:int,b:int>>")
    out = scratch.keep(scored.groupBy("place", "record_id", "text_hash", "line_no", "spans").agg(F.max("score").alias("score")))
    scratch.drop(raw)
    return out


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(place, record_id, text): the texts that hold secrets with only the secrets' characters as ``*``.

    ``texts`` has (place, record_id, text); ``found`` comes from ``credentials`` over the same texts. Offsets apply to the very
    text they were found in, also where an id has several.
    """
    spans = found.groupBy("place", "record_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    joined = texts.where("text is not null").withColumn("text_hash", F.xxhash64("text")).distinct().join(spans, ["place", "record_id", "text_hash"])

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, spans in zip(b["text"], b["spans"]):
                chars = list(t)
                for s in spans:
                    chars[s["a"] : s["b"]] = "*" * (min(s["b"], len(chars)) - s["a"])
                out.append("".join(chars))
            yield pd.DataFrame({"place": b["place"], "record_id": b["record_id"], "text": out})

    return joined.mapInPandas(mask, "place string, record_id string, text string")
