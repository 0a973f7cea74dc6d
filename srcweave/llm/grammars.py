"""Grammars and the pairs of adjacent tokens they permit.

A rule lists alternatives of sequences; ``x?``, ``x*``, ``x+`` and groups have their usual meaning. Upper-case
names are rules, others are token kinds or keywords. The pairs come from FIRST and LAST sets by fixpoint.
"""

from __future__ import annotations

import re
from functools import lru_cache

from srcweave.llm.lexing import kinds

JAVA = """
UNIT = PACKAGE? (IMPORT | TYPEDECL | semi)*
PACKAGE = ANN* package NAME semi
IMPORT = import static? NAME (dot star)? semi
NAME = id (dot id)*
ANN = at NAME (lp (E | ARRAY) (comma (E | ARRAY))* rp | lp rp)?
MOD = public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | ANN
PRIM = boolean | byte | char | short | int | long | float | double
TYPE = ANN* (PRIM | id TARGS? (dot ANN* id TARGS?)*) (lb rb)*
TARGS = lt gt | lt TARG (comma TARG)* gt
TARG = TYPE | q ((extends | super) TYPE)? | TYPE amp TYPE
TPARAMS = lt id (extends TYPE (amp TYPE)*)? (comma id (extends TYPE (amp TYPE)*)?)* gt
TYPEDECL = MOD* id? (class | interface | at interface | enum | id) id TPARAMS? (lp PARAMS? rp)? (extends TYPES)? (implements TYPES)? (id TYPES)? BODY
TYPES = TYPE (comma TYPE)*
BODY = lc (ENUMS semi?)? MEMBER* rc
ENUMS = ANN* id ARGS? BODY? (comma ANN* id ARGS? BODY?)* comma?
MEMBER = TYPEDECL | METHOD | VARS semi | static? BLOCK | semi
METHOD = MOD* TPARAMS? (TYPE | void)? id lp PARAMS? rp (lb rb)* (throws TYPES)? (BLOCK | (default E)? semi) | MOD* id BLOCK
PARAMS = PARAM (comma PARAM)*
PARAM = MOD* TYPE dots? (id | this) (lb rb)* | id
VARS = MOD* TYPE id (lb rb)* (eq INIT)? (comma id (lb rb)* (eq INIT)?)*
INIT = E | ARRAY
ARRAY = lc (INIT (comma INIT)*)? comma? rc
BLOCK = lc STMT* rc
STMT = BLOCK | semi | VARS semi | TYPEDECL | E semi | if lp E rp STMT (else STMT)? | while lp E rp STMT | do STMT while lp E rp semi | for lp FOR rp STMT | return E? semi | throw E semi | break id? semi | continue id? semi | id colon STMT | try (lp RES (semi RES)* semi? rp)? BLOCK (catch lp MOD* TYPE (bin TYPE)* id rp BLOCK)* (finally BLOCK)? | SWITCH | synchronized lp E rp BLOCK | assert E (colon E)? semi | yield E semi
RES = VARS | E
FOR = (VARS | E (comma E)*)? semi E? semi (E (comma E)*)? | MOD* TYPE id colon E
SWITCH = switch lp E rp lc (LABEL (STMT* | E semi))* rc
LABEL = case (E | TYPE id | null | default) (comma (E | null | default))* (id E)? (colon | arrow) | default (colon | arrow)
E = T (OP T)* (q E colon E)? | T instanceof final? TYPE (id | lp PARAMS? rp)?
OP = bin | add | amp | star | lt | gt | gt gt | gt gt gt | gt eq | eq | set | bin
T = PRE* ATOM POST*
PRE = add | not | tilde | inc | lp TYPE (amp TYPE)* rp
ATOM = id | num | str | this | super | null | true | false | lp E rp | NEW | LAMBDA | TYPE dot class | void dot class | TYPE pair (id | new) | SWITCH
NEW = new TARGS? TYPE (ARGS BODY? | (lb E? rb)+ ARRAY?)
LAMBDA = (id | lp (PARAMS | id (comma id)*)? rp) arrow (E | BLOCK)
POST = dot TARGS? (id | new | class | this | super | yield) | ARGS | lb E rb | inc | pair TARGS? (id | new)
ARGS = lp (E (comma E)*)? rp
"""

CSHARP = """
UNIT = ITEM*
ITEM = USING | NS | TYPEDECL | STMT | ATTR
USING = id? using (static | id eq)? TYPE semi
NAME = id (dot id | pair id)*
NS = namespace NAME (semi | lc ITEM* rc)
ATTR = lb (id colon | return colon)? NAME ARGS? (comma NAME ARGS?)* comma? rb
MOD = public | private | protected | internal | static | readonly | abstract | sealed | virtual | override | extern | new | unsafe | volatile | const | id | ATTR | event | params | ref | out | in | this
PRIM = bool | byte | char | decimal | double | float | int | long | object | sbyte | short | string | uint | ulong | ushort | void
TYPE = (PRIM | NAME TARGS? (dot NAME TARGS?)* | TUPLE | ref TYPE) SUFFIX*
SUFFIX = lb comma* rb | q | star
TUPLE = lp TYPE id? (comma TYPE id?)+ rp
TARGS = lt (TYPE | in TYPE | out TYPE)? (comma TYPE?)* gt
TYPEDECL = MOD* (class | struct | interface | enum | id (class | struct)?) id TARGS? (lp PARAMS? rp)? (colon TYPE ARGS? (comma TYPE)*)? WHERE* (BODY | semi) semi? | MOD* delegate TYPE id TARGS? lp PARAMS? rp WHERE* semi
WHERE = where id colon (TYPE | class q? | struct | new lp rp | default) (comma (TYPE | class | struct | new lp rp))*
BODY = lc (MEMBER* | ENUMS) rc
ENUMS = ATTR* id (eq E)? (comma ATTR* id (eq E)?)* comma?
MEMBER = TYPEDECL | METHOD | FIELD | PROP | semi
FIELD = MOD* TYPE id (eq INIT)? (comma id (eq INIT)?)* semi | MOD* fixed TYPE id lb E rb semi
METHOD = MOD* TYPE? (NAME TARGS? | operator (bin | add | star | amp | lt | gt | not | inc | true | false | TYPE) | this | (implicit | explicit) operator TYPE) (lp PARAMS? rp | lb PARAMS rb) (colon (this | base) ARGS)? WHERE* (BLOCK | arrow E semi | semi) | tilde id lp rp BLOCK
PROP = MOD* TYPE (NAME TARGS? | this lb PARAMS rb) (lc (MOD* id (semi | BLOCK | arrow E semi))* rc (eq INIT semi)? | arrow E semi)
PARAMS = PARAM (comma PARAM)*
PARAM = MOD* TYPE id (eq E)? | id
INIT = E | ARRAY
ARRAY = lc (INIT (comma INIT)*)? comma? rc
BLOCK = lc STMT* rc
VARS = (const | id | using | ref)* TYPE id (eq INIT)? (comma id (eq INIT)?)*
STMT = BLOCK | semi | VARS semi | METHOD | E semi | if lp E rp STMT (else STMT)? | while lp E rp STMT | do STMT while lp E rp semi | id? for lp (VARS | E)? semi E? semi (E (comma E)*)? rp STMT | id? foreach lp (TYPE id | TYPE TUPLE) in E rp STMT | return E? semi | throw E? semi | break semi | continue semi | goto (id | case E | default) semi | id colon STMT | try BLOCK (catch (lp TYPE id? rp)? (when lp E rp)? BLOCK)* (finally BLOCK)? | SWITCH | lock lp E rp STMT | id? using lp (VARS | E) rp STMT | (checked | unchecked | unsafe) BLOCK | fixed lp VARS rp STMT | id (return | break) E? semi
SWITCH = switch lp E rp lc (LABEL+ STMT*)* rc
LABEL = case PATTERN (when E)? colon | default colon
PATTERN = E | TYPE id? | lc PROPS? rc id? | TYPE lc PROPS? rc id? | not? null | (lt | gt | bin) E | id PATTERN | PATTERN id PATTERN
PROPS = id colon PATTERN (comma id colon PATTERN)*
E = T (OP T)* (q E colon E)? | T (is | as) PATTERN | E SWITCHX | E id lc PAIRS? rc
SWITCHX = switch lc (PATTERN (when E)? arrow E comma?)* rc
OP = bin | add | amp | star | lt | gt | gt gt | gt eq | eq | set | is | as | in | dots
T = PRE* ATOM POST*
PRE = add | not | tilde | inc | amp | star | lp TYPE rp | id | ref | out | dots | throw
ATOM = id TARGS? | num | str | this | base | null | true | false | lp E rp | lp E (comma E)+ rp | NEW | LAMBDA | PRIM | (typeof | default | sizeof | checked | unchecked) lp TYPE rp | default | stackalloc TYPE | lb (E (comma E)*)? rb | FROM | delegate (lp PARAMS? rp)? BLOCK | out TYPE id | id id
FROM = id id in E (id id in E | id E | id id eq E)* 
NEW = new (TYPE (ARGS OBJ? | OBJ | lb E (comma E)* rb ARRAY? | ARRAY) | ARGS OBJ? | lb comma* rb ARRAY | lc PAIRS? rc)
OBJ = lc ((id eq (E | OBJ) | lb E rb eq E | E | ARRAY) (comma (id eq (E | OBJ) | lb E rb eq E | E | ARRAY))* comma?)? rc
PAIRS = (id eq)? E (comma (id eq)? E)* comma?
LAMBDA = (id | static)* (id | lp (PARAMS | id (comma id)*)? rp) arrow (E | BLOCK)
POST = dot id TARGS? | pair id | ARGS | lb (E (comma E)*)? rb | q lb E rb | inc | not
ARGS = lp ((id colon)? ARG (comma (id colon)? ARG)*)? rp
ARG = E | (ref | out | in) (E | TYPE id) | TYPE id
"""

GO = """
UNIT = package id semi (import (SPEC | lp (SPEC semi)* SPEC? rp) semi)* (TOP semi)* TOP?
SPEC = (dot | id)? str
TOP = func id TPARAMS? SIG BLOCK? | func lp PARAMS? rp id SIG BLOCK? | DECL
DECL = var (VSPEC | lp (VSPEC semi)* VSPEC? rp) | const (VSPEC | lp (VSPEC semi)* VSPEC? rp) | type (TSPEC | lp (TSPEC semi)* TSPEC? rp)
VSPEC = IDS TYPE? (eq ES)?
TSPEC = id TPARAMS? eq? TYPE
TPARAMS = lb PARAM (comma PARAM)* rb
IDS = id (comma id)*
SIG = lp PARAMS? rp (TYPE | lp PARAMS? rp)?
PARAMS = PARAM (comma PARAM)* comma?
PARAM = IDS? dots? CONSTRAINT
CONSTRAINT = tilde? TYPE (bin tilde? TYPE)*
TYPE = id (dot id)? (lb TYPE (comma TYPE)* rb)? | star TYPE | lb (E | dots)? rb TYPE | map lb TYPE rb TYPE | chan recv? TYPE | recv chan TYPE | func SIG | struct lc (FIELD semi)* FIELD? rc | interface lc ((id SIG | CONSTRAINT) semi)* (id SIG | CONSTRAINT)? rc | lp TYPE rp
FIELD = IDS TYPE str? | star? id (dot id)? str?
BLOCK = lc STMT* S? rc
STMT = S semi | semi
S = DECL | SIMPLE | return ES? | break id? | continue id? | goto id | fallthrough | BLOCK | IF | FOR | SWITCH | select lc (COMM colon STMT*)* S? rc | go E | defer E | id colon STMT
COMM = case SIMPLE | default
SIMPLE = ES ((eq | set | define | recv) ES)? | E inc | ES define range E | ES eq range E
IF = if (SIMPLE? semi)? E BLOCK (else (IF | BLOCK))?
FOR = for (E | SIMPLE? semi E? semi SIMPLE? | (ES (define | eq))? range E)? BLOCK
SWITCH = switch (SIMPLE? semi)? SIMPLE? lc ((case (ES | TYPE (comma TYPE)*) | default) colon STMT*)* S? rc
ES = E (comma E)*
E = T (OP T)*
OP = bin | add | amp | star | lt | gt | gt gt | gt eq
T = PRE* ATOM POST*
PRE = add | not | amp | star | recv | bin
ATOM = id | num | str | lp E rp | func SIG BLOCK | TYPE LIT | TYPE lp E rp | lp TYPE rp
LIT = lc (KV (comma KV)* comma?)? rc
KV = (EL colon)? EL
EL = E | LIT
POST = dot id | dot lp (TYPE | type) rp | lb E? (colon E?)? (colon E)? rb | lp ((E | TYPE) (comma E)* dots? comma?)? rp | LIT | lb TYPE (comma TYPE)* rb
"""

SCRIPT = """
UNIT = STMT* TAIL?
STMT = SIMPLE semi | COMPOUND semi? | semi
SIMPLE = VARS | ES | IMPORT | EXPORT | return ES? | throw ES | break id? | continue id? | debugger
COMPOUND = BLOCK | FUNC | CLASS | EXPORTED | if lp ES rp STMT (else STMT)? | while lp ES rp STMT | do STMT while lp ES rp | for await? lp FOR rp STMT | W colon STMT | try BLOCK (catch (lp BIND rp)? BLOCK)? (finally BLOCK)? | switch lp ES rp lc (CASE STMT*)* TAIL? rc | with lp E rp STMT | DECO
TAIL = SIMPLE | if lp ES rp TAIL | if lp ES rp STMT else TAIL | while lp ES rp TAIL | for lp FOR rp TAIL
EXPORTED = export default? (FUNC | CLASS)
CASE = case ES colon | default colon
BLOCK = lc STMT* TAIL? rc
VARS = (var | let | const) BIND (eq E)? (comma BIND (eq E)?)*
BIND = W | OBJPAT | ARRPAT
OBJPAT = lc (PROP (comma PROP)* comma?)? rc
PROP = KEY (colon (BIND | E))? (eq E)? | dots E
ARRPAT = lb comma* (dots? BIND (eq E)? (comma+ dots? BIND (eq E)?)*)? comma* rb
FOR = (VARS | ES)? semi ES? semi ES? | (VARS | (var | let | const) BIND | E) (of | in) ES
ES = E (comma E)*
FUNC = async? function star? W? lp PARAMS? rp BLOCK
PARAMS = PARAM (comma PARAM)* comma?
PARAM = dots? BIND (eq E)?
CLASS = class W? (extends T)? lc MEMBER* FIELD? rc
MEMBER = (static | async | get | set)* star? KEY lp PARAMS? rp BLOCK | FIELD semi | static BLOCK | semi | DECO
FIELD = (static)? KEY (eq E)?
DECO = at ARGS?
KEY = W | KW | str | num | lb E rb
KW = get | set | from | as | await | break | case | catch | class | const | continue | debugger | default | delete | do | else | export | extends | finally | for | function | if | import | in | instanceof | new | return | switch | throw | try | typeof | var | void | while | with | yield | null | true | false | this | super
W = id | of | async | static | let | await | yield | get | set | from | as
IMPORT = import (str | (W (comma (star as W | NAMED))? | NAMED | star as W) from str) ((with | id) lc (KEY colon str (comma KEY colon str)* comma?)? rc)?
NAMED = lc (NAME1 (comma NAME1)* comma?)? rc
NAME1 = (W | default | str) (as (W | default | str))?
EXPORT = export (NAMED (from str)? | star (as W)? from str | default E | VARS)
E = T (OP T)* (q E colon E)? | ARROW | yield star? E?
OP = bin | add | amp | star | lt | gt | gt gt | gt gt gt | gt eq | eq | set | in | instanceof
T = PRE* ATOM POST*
PRE = add | not | tilde | inc | typeof | void | delete | await | new | dots
ATOM = W | num | str | this | super | null | true | false | lp ES rp | OBJ | ARR | FUNC | CLASS | import lp E rp | import dot id | new dot id | ARROW
OBJ = lc (OPROP (comma OPROP)* comma?)? rc
OPROP = KEY colon E | W | dots E | (async | get | set)* star? KEY lp PARAMS? rp BLOCK | W eq E
ARR = lb comma* (dots? E (comma+ dots? E)*)? comma* rb
ARROW = async? (W | lp PARAMS? rp) arrow (E | BLOCK)
POST = dot (W | KW) | dot ARGS | dot lb ES rb | ARGS | lb ES rb | inc | str
ARGS = lp (dots? E (comma dots? E)*)? comma? rp
"""

TYPES = """
COMPOUND = (declare | abstract | export | DECO | default)* (interface W TPARAMS? (extends TYPE (comma TYPE)*)? OBJT | const? enum W lc (ENUM1 (comma ENUM1)* comma?)? rc | (namespace | module | global) (W (dot W)* | str)? BLOCK | TCLASS | TFUNC)
SIMPLE = (declare | export | default)* (type W TPARAMS? eq TYPE | VARST | TSIG) | import type? (W | NAMED | star as W) from str | import type NAMED from str | export type NAMED (from str)? | import W eq E
ENUM1 = KEY (eq E)?
VARST = (var | let | const) TBIND (eq E)? (comma TBIND (eq E)?)* | (var | let | const) TBIND (of | in) ES
TBIND = BIND not? (colon TYPE)?
TPARAMS = lt const? W (extends TYPE)? (eq TYPE)? (comma W (extends TYPE)? (eq TYPE)?)* comma? gt
TARGS = lt TYPE (comma TYPE)* gt
TSIG = async? function star? W? TPARAMS? lp TPARAMLIST? rp RET?
TFUNC = TSIG BLOCK
RET = colon (TYPE | ASSERTS | W is TYPE | this is TYPE)
ASSERTS = asserts W (is TYPE)?
TPARAMLIST = TPARAM (comma TPARAM)* comma?
TPARAM = DECO* MODT* dots? (BIND | this) q? (colon TYPE)? (eq E)?
MODT = public | private | protected | readonly | static | abstract | declare | async | override | accessor | out | in | get | set
TCLASS = class W? TPARAMS? (extends T TARGS?)? (implements TYPE (comma TYPE)*)? lc TMEMBER* TFIELD? rc
TMEMBER = (DECO | MODT)* star? KEY (q | not)? TPARAMS? lp TPARAMLIST? rp RET? (BLOCK | semi) | TFIELD semi | semi
TFIELD = (DECO | MODT)* KEY (q | not)? (colon TYPE)? (eq E)? | MODT* lb W colon TYPE rb colon TYPE
TYPE = UNARY ((bin | amp) UNARY)* (extends TYPE q TYPE colon TYPE)? | (bin | amp) TYPE | new? TPARAMS? lp TPARAMLIST? rp arrow (TYPE | W is TYPE)
UNARY = (keyof | readonly | typeof | infer | unique)? PRIMARY (lb TYPE? rb)* (lb TYPE rb)*
PRIMARY = W (dot W)* TARGS? | str | num | add num | null | true | false | void | this | lp TYPE rp | OBJT | lb (TUP (comma TUP)* comma?)? rb | import lp str rp (dot W)* | typeof W (dot W)*
TUP = dots? (W q? colon)? TYPE q?
OBJT = lc (OBJ1 ((semi | comma) OBJ1)* (semi | comma)?)? rc
OBJ1 = (readonly | add readonly | get | set)* (KEY q? (colon TYPE)? | KEY? q? TPARAMS? lp TPARAMLIST? rp RET? | lb W (colon | in) TYPE (as TYPE)? rb (add? q)? colon TYPE | new lp TPARAMLIST? rp RET?)
W = type | as | is | declare | namespace | abstract | keyof | infer | readonly | override | asserts | satisfies | module | global | accessor | unique | out
KW = enum | implements | interface | private | protected | public
E = T as (TYPE | const) | T satisfies TYPE | T not | lt TYPE gt T | TFUNC | TARROW | TCLASS
TARROW = async? TPARAMS? lp TPARAMLIST? rp RET? arrow (E | BLOCK)
POST = not | TARGS ARGS | TARGS
OPROP = (async | get | set)* star? KEY TPARAMS? lp TPARAMLIST? rp RET? BLOCK
ATOM = TFUNC | TCLASS | TARROW
PARAMS = TPARAMLIST
NAME1 = type (W | default) (as W | as default)?
"""

PYTHON = """
NAME = id | match | case | type
UNIT = nl* STMT*
STMT = SIMPLE (semi SIMPLE)* semi? nl | COMPOUND
SIMPLE = STARS ((eq | set) (YIELD | STARS))* | TARGET colon E (eq (STARS | YIELD))? | pass | break | continue | return STARS? | raise (E (from E)?)? | global id (comma id)* | nonlocal id (comma id)* | del STARS | assert E (comma E)? | import DOTTED (as id)? (comma DOTTED (as id)?)* | from (dot | dots)* DOTTED? import (star | NAMES | lp NAMES comma? rp) | YIELD | type id TPARAMS? eq E
YIELD = yield (from E | STARS)?
TARGET = NAME | T | lp T rp
NAMES = NAME (as NAME)? (comma NAME (as NAME)?)*
DOTTED = NAME (dot NAME)*
BLOCK = nl STMT+ | SIMPLE (semi SIMPLE)* semi? nl
COMPOUND = (at E nl)* (async? def NAME TPARAMS? lp PARAMS? rp (arrow E)? colon BLOCK | class id TPARAMS? (lp ARGS? rp)? colon BLOCK) | async? for STARS in STARS colon BLOCK (else colon BLOCK)? | while E colon BLOCK (else colon BLOCK)? | if E colon BLOCK (elif E colon BLOCK)* (else colon BLOCK)? | try colon BLOCK (except star? (E (as id)?)? colon BLOCK)* (else colon BLOCK)? (finally colon BLOCK)? | async? with (WITEM (comma WITEM)* | lp WITEM (comma WITEM)* comma? rp) colon BLOCK | match STARS colon nl (case PATTERN (if E)? colon BLOCK)+
WITEM = E (as T)?
PATTERN = STARS (as id)? | T bin T | star id | lc (E colon PATTERN (comma E colon PATTERN)* comma?)? rc
TPARAMS = lb id (colon E)? (comma id (colon E)?)* rb
PARAMS = PARAM (comma PARAM)* comma?
PARAM = NAME (colon E)? (eq E)? | star (NAME (colon E)?)? | bin NAME (colon E)?
ARGS = ARG (comma ARG)* comma?
ARG = NAME eq E | star E | bin E | E | E COMP
STARS = star? E (comma star? E)* comma?
E = LAMBDA | D (if D else E)? | NAME WALRUS E
WALRUS = define
D = C ((and | or) C)*
C = not* A (CMP A)*
CMP = lt | gt | bin | in | not in | is not? 
A = T (OP T)*
OP = bin | add | star | amp | gt gt | at
T = PRE* ATOM POST*
PRE = add | tilde | await | not
ATOM = NAME | num | str+ | True | False | None | dots | lp (STARS | YIELD | E COMP)? rp | lb (STARS | E COMP)? rb | lc ((DICT | STARS) | E COMP | E colon E COMP)? rc
DICT = (E colon E | bin E) (comma (E colon E | bin E))* comma?
COMP = (async? for STARS in D | if D)+
LAMBDA = lambda PARAMS? colon E
POST = dot NAME | lp ARGS? rp | lb SLICES rb
SLICES = SLICE (comma SLICE)* comma?
SLICE = E | star E | E? colon E? (colon E?)?
"""

SOURCES = {"java": [JAVA], "csharp": [CSHARP], "go": [GO], "javascript": [SCRIPT], "typescript": [SCRIPT, TYPES], "python": [PYTHON]}


def _parse(rule: str):
    toks = re.findall(r"\w+|[()|?*+]", rule)
    at = 0

    def alternatives():
        nonlocal at
        out = [sequence()]
        while at < len(toks) and toks[at] == "|":
            at += 1
            out.append(sequence())
        return ("alt", out)

    def sequence():
        nonlocal at
        out = []
        while at < len(toks) and toks[at] not in "|)":
            if toks[at] == "(":
                at += 1
                x = alternatives()
                at += 1
            else:
                x = ("sym", toks[at])
                at += 1
            if at < len(toks) and toks[at] in "?*+":
                x = (toks[at], x)
                at += 1
            out.append(x)
        return ("seq", out)

    return alternatives()


@lru_cache
def permitted_pairs(language: str) -> frozenset[tuple[str, str]]:
    """All (token, token) that the language's grammar lets stand next to each other, as class characters."""
    rules: dict[str, list] = {}
    for text in SOURCES[language]:
        for line in text.strip().splitlines():
            name, _, rule = line.partition(" = ")
            rules.setdefault(name, []).append(_parse(rule))
    first = {r: set() for r in rules}
    last = {r: set() for r in rules}
    empty = {r: False for r in rules}
    pairs: set[tuple[str, str]] = set()

    def walk(x) -> tuple[bool, set, set]:
        kind, body = x
        if kind == "sym":
            return (empty[body], first[body], last[body]) if body in rules else (False, {body}, {body})
        if kind == "alt":
            parts = [walk(y) for y in body]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind == "seq":
            void, f, tail = True, set(), set()
            for y in body:
                e, yf, yl = walk(y)
                pairs.update((a, b) for a in tail for b in yf)
                if void:
                    f |= yf
                tail = tail | yl if e else set(yl)
                void = void and e
            return void, f, tail
        e, f, tail = walk(body)
        if kind in "*+":
            pairs.update((a, b) for a in tail for b in f)
        return e or kind != "+", set(f), set(tail)

    before = -1
    while before != (now := len(pairs) + sum(map(len, first.values())) + sum(map(len, last.values())) + sum(empty.values())):
        before = now
        for r, bodies in rules.items():
            for b in bodies:
                e, f, t = walk(b)
                empty[r] |= e
                first[r] |= f
                last[r] |= t
    char = {name: c for c, name in kinds(language).names.items()}
    return frozenset((char[a], char[b]) for a, b in pairs)
