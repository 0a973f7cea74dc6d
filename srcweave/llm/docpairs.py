"""Functions paired with their documentation.

Comments and strings are found as islands of the text, so that doc comments inside strings don't count. From
each doc comment (for Python: each ``def``) a packrat grammar of the language parses annotations, modifiers and
signature, keeping source offsets; its captures give the pair. Groups are matched with a stack, at any depth. Descriptions that say nothing are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.llm.peg import Grammar
from srcweave.llm.syntax import language_of

COMMON = r"""
S <- ~(?:[ \t\r\n]|/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*)*+~
Sep <- ~(?:[ \t\r\n]|/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*)++~
Name <- ~(?:[^\W\d]|[$])[\w$]*~
Dotted <- Name ('.' Name)*
Next <- ~[ \t]*\r?\n(?![ \t]*\r?\n)[ \t]*~
Gap <- Next / ~[ \t]+~
"""
SCRIPT = COMMON + r"""
Start <- ~[ \t]*~ Gap? (Annotation Gap)* (Annotation ~[ \t]*~)? (Function / Arrow / Method / Assigned / Property)
Annotation <- '@' Dotted Parens?
Function <- (~(?:export|default|declare|async)\b~ Sep)* 'function' S ~\*?~ S name:Name S (Angles S)? params:Parens S (':' ~[^{;]*~)? &~[{;]~
Arrow <- (~(?:export|default|declare)\b~ Sep)* ~(?:const|let|var)\b~ Sep name:Name (~\s*(?::[^=\n]*(?:=>[^=\n]*)*)?~ '=' / S ':' S Type S '=') S Value
Value <- ~(?:async\b\s*)?~ (~function\b~ S ~\*?~ S Name? S (Angles S)? params:Parens / (Angles S)? params:Parens S (':' ~[^={;]*~ '=>' / ':' S Result S '=>' / '=>') / Name S '=>')
Modifier <- ~(?:public|private|protected|static|readonly|abstract|override|async|get|set|declare|accessor)\b(?!\s*[(<=:?])~ S
Method <- Modifier* ~\*?\s*~ !Reserved name:(~#?~ Name / Str / Brackets) ~[?!]?~ S (Angles S)? (params:Parens S (':' ~(?:[^{;\n]|\{[^{}\n]*\})*~)? &~[{;]|\r?\n~ / (':' S Type S)? '=' S Value)
Assigned <- !Reserved ~(?:(?:[^\W\d]|[$])[\w$]*\s*\.\s*)+~ name:(~#?~ Name) S '=' S Value
Type <- ~[|&]?\s*~ TypePart (S ~[|&?:]|(?:is|extends|in)\b~ S TypePart)*
TypePart <- ~(?:(?:asserts|keyof|typeof|readonly|unique|infer|abstract)\s+)*(?:new\b\s*)?~ ((Angles S)? Parens S '=>' S)* Plain
Result <- ~[|&]?\s*~ ~(?:(?:asserts|keyof|typeof|readonly|unique)\s+)*~ Plain (S ~[|&?:]|(?:is|extends|in)\b~ S Plain)*
Plain <- (Parens / Braces / Brackets / Str / ~-?\d[\w.]*~ / Dotted (S Angles)?) (~[ \t]*~ Brackets)*
Reserved <- ~(?:if|for|while|switch|catch|return|new|throw|await|typeof|delete|import|export|class|interface|super|function|const|let|var|type|enum)\b~
"""
GRAMMARS = {
    "java": COMMON + r"""
Start <- ~[ \t]*~ Gap? (Annotation Gap)* (Annotation ~[ \t]*~)? (Signature / Compact)
Annotation <- '@' !'interface' Dotted ~[ \t]*~ Parens?
Modifier <- ~(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp)\b~ S
Type <- Dotted (S Angles)? ('.' (Annotation S)* Dotted (S Angles)?)* (S (Annotation S)* '[' S ']')*
Signature <- Modifier* (Annotation S)* Modifier* (Angles S)? (Annotation S)* (!Reserved Type Sep)? !Reserved name:Name S params:Parens ~\s*(?:\[\s*\])*~ S ('throws' ~[^{;]*~)? &~[{;]|default\b~
Compact <- Modifier* (Annotation S)* Modifier* !Reserved record:Name S &'{'
Reserved <- ~(?:class|interface|enum|record|return|new|if|for|while|switch|catch|else|throw|import|package)\b(?!\s*\()~ / ~(?:if|for|while|switch|catch|return|new|throw|synchronized)\b~
""",
    "csharp": COMMON.replace("Name <- ~", "Name <- ~@?").replace("('.' Name)*", r"(~\.|::~ Name)*") + r"""
Start <- ~[ \t]*~ Gap? (Brackets Gap)* (Brackets ~[ \t]*~)? Signature
Modifier <- ~(?:public|private|protected|internal|static|async|virtual|override|abstract|sealed|extern|new|unsafe|partial|readonly|required|ref|file|scoped)\b~ S
Type <- (Parens / 'delegate' S '*' S ~(?:(?:un)?managed\b)?~ S (Brackets S)? Angles / Dotted (S Angles)? (~\.|::~ Dotted (S Angles)?)*) ~(?:\s*(?:\?|\*|\[[\s,]*\]))*~
Owner <- Name (S Angles)? '.'
Signature <- Modifier* (Operator / '~' S name:Name S params:Parens / (!Reserved Type Sep)? Owner* !Reserved name:Name S (Angles S)? params:Parens) S (':' S ~(?:base|this)~ S Parens S)? (~where\b[^{;=]*~)? &~[{;]|=>~
Operator <- (~(?:implicit|explicit)\b~ S Owner* name:(~operator\b~ S ~(?:checked\b)?~ S Type) / !Reserved Type Sep Owner* name:(~operator\b~ S ~(?:checked\b)?~ S ~(?:true|false)\b|[-+*/%&|^!<>=]+~ / ~operator~ '~')) S params:Parens
Reserved <- ~(?:class|interface|enum|record|struct|return|new|if|for|foreach|while|switch|catch|using|lock|throw|event|namespace|implicit|explicit|operator)\b|delegate\b(?!\s*\*)~
""",
    "javascript": SCRIPT + r"""
Property <- !Reserved name:(Name / Str / Brackets) S ':' S Value
""",
    # an arrow after a colon may be a type: only with a body, which doesn't start like the members of one
    "typescript": SCRIPT + r"""
Property <- !Reserved name:(Name / Str / Brackets) S ':' S (&~(?:async\b\s*)?function\b|async\b~ Value / Value S &~\{(?!\s*(?:readonly\b|[\w$]+\??\s*:|\[))~)
""",
    "go": COMMON + r"""
Start <- 'func' ~[ \t]+~ S (receiver:Parens S)? name:Name S (Brackets S)? params:Parens
""",
    "python": r"""
Name <- ~[^\W\d]\w*~
Comment <- ~#[^\n]*~
S <- ~(?:[ \t\f]|\\\r?\n)*~
Line <- ~[ \t\f]*(?:#[^\n]*)?\r?\n~
Wide <- ~(?:\s|\\\r?\n|#[^\n]*)*~
Start <- 'def' S name:Name S (&'[' Group S)? params:Group S ('->' (Str / Group / ~(?:[^:()\[\]{}"'#\n\\]|\\\r?\n)+~)*)? ':' Body
Body <- S (Comment? ~\r?\n~ Line*)? ~[ \t\f]*~ (doc:(Part (S Part)*) / '(' Wide doc:(Part (Wide Part)*) Wide ')') &~[ \t\f]*(?:#|;|\r?\n|\Z)~
Part <- ~[rRuU]?~ Quoted
""",
}


_SHORT = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_REGEX = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*"
_AFTER = r"[=(,:\[!&|?{};]"
_LITERALS = {
    "java": r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|" + _SHORT,
    "csharp": r"\"\"\".*?\"\"\"(?!\")|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*+\"|" + _SHORT,
    "javascript": rf"{_SHORT}|(?:(?<={_AFTER})|(?<={_AFTER}[ \t])|(?<={_AFTER}[ \t][ \t])){_REGEX}",
    "go": r"`[^`]*`|" + _SHORT,
    "python": r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" + _SHORT,
}
_LITERALS["typescript"] = _LITERALS["javascript"]
_CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">", "${": "}"}
_TEMPLATE = re.compile(r"(?s)(?:[^`\\$]++|\\.|\$(?!\{))*+")


def nested(language: str, opening: str):
    """Matcher of the group that ``opening`` begins, strings, comments, templates and inner groups included, of any depth; (text, offset) -> end or None."""
    if language == "python":
        code = re.compile(rf"(?s){_LITERALS[language]}|#[^\n]*|([()\[\]{{}}])|[^()\[\]{{}}\"'#]++")
    else:
        code = re.compile(rf"(?s){_LITERALS[language]}|/\*.*?\*/|//[^\n]*|([()\[\]{{}}`])|[^()\[\]{{}}\"'`/@$]++|[/@$]")
    angled = re.compile(rf"(?s){_LITERALS[language]}|/\*.*?\*/|//[^\n]*|([()\[\]{{}}<>`])|=>?|[^<>()\[\]{{}}\"'`;=/@$]++|[/@$]")

    def end(text: str, p: int) -> int | None:
        if not text.startswith(opening, p):
            return None
        open_, p = [opening], p + 1
        while open_:
            if open_[-1] == "`":
                p = _TEMPLATE.match(text, p).end()
                if text.startswith("`", p):
                    open_.pop()
                    p += 1
                elif p < len(text):
                    open_.append("${")
                    p += 2
                else:
                    return None
                continue
            m = (angled if open_[-1] == "<" else code).match(text, p)
            if m is None:
                return None
            p = m.end()
            if m[1] is None:
                continue
            if m[1] in "([{<`":
                open_.append(m[1])
            elif _CLOSES[open_.pop()] != m[1]:
                return None
        return p

    return end


def literal(language: str, prefix: str = ""):
    """Matcher of a string, for scripts also of a template."""
    string = re.compile(rf"(?s){prefix}(?:{_LITERALS[language]})")
    template = nested(language, "`") if language in ("javascript", "typescript") else lambda text, p: None

    def end(text: str, p: int) -> int | None:
        m = string.match(text, p)
        return m.end() if m else template(text, p)

    return end


_PEG: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _PEG:
        calls = {name: nested(language, opening) for name, opening in (("Parens", "("), ("Brackets", "["), ("Braces", "{"), ("Angles", "<"))}
        if language == "python":
            calls["Group"] = lambda text, p: calls[{"(": "Parens", "[": "Brackets"}.get(text[p : p + 1], "Braces")](text, p)
            calls["Quoted"] = literal(language)
        _PEG[language] = Grammar(GRAMMARS[language], calls | {"Str": literal(language, "[rRbBuUfF]{0,2}" if language == "python" else "")})
    return _PEG[language]


_QUOTES = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SCRIPT = r"(?s)(/\*\*(?!/).*?\*/)|/\*.*?\*/|//[^\n]*|" + _QUOTES + rf"|(?:[=(,:\[!&|?{{}};\n]|return(?<![\w$]return)|typeof(?<![\w$]typeof)|case(?<![\w$]case))[ \t]*{_REGEX}"
ISLANDS = {
    "java": re.compile(r"(?s)(/\*\*(?!/).*?\*/)|/\*.*?\*/|//[^\n]*|\"\"\"(?:[^\\]|\\.)*?\"\"\"|" + _QUOTES),
    "script": re.compile(_SCRIPT + r"|`(?:[^`\\]|\\.)*`"),
    "csharp": re.compile(r"(?s)((?:(?<=\n)|(?<=^))[ \t]*///[^\n]*(?:\n[ \t]*///[^\n]*)*)|/\*.*?\*/|//[^\n]*|\"\"\".*?\"\"\"|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|" + _QUOTES),
    "go": re.compile(r"(?s)((?:(?<=\n)|(?<=^))//[^\n]*(?:\n//[^\n]*)*)\n(?=func[ \t])|/\*.*?\*/|//[^\n]*|`[^`]*`|" + _QUOTES),
    "python": re.compile(r"(?s)#[^\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?<![\w.])(def)(?=[ \t\\\f])"),
}
_OUTER = re.compile(_SCRIPT + r"|(`)")
_INNER = re.compile(r"(?s)(/\*\*(?!/).*?\*/)|/\*.*?\*/|//[^\n]*|" + _QUOTES + rf"|(?<={_AFTER})[ \t]*{_REGEX}|([`{{}}])")


def islands(key: str, text: str) -> Iterator[re.Match]:
    """The comments, strings and heads of a text; in scripts the code inside templates is read as code."""
    if key != "script" or "`" not in text:
        yield from ISLANDS[key].finditer(text)
        return
    found: list[re.Match] = []
    open_, p, first = [], 0, 0  # templates and braces around the code, and the outermost template
    while True:
        if open_ and open_[-1] == "`":
            p = _TEMPLATE.match(text, p).end()
            if p >= len(text):
                break
            if text[p] == "`":
                open_.pop()
                p += 1
            else:
                open_.append("{")
                p += 2
            continue
        m = (_INNER if open_ else _OUTER).search(text, p)
        if m is None:
            break
        p = m.end()
        if m[2] == "}":
            open_.pop()
        elif m[2]:
            first = first if open_ else m.start()
            open_.append(m[2])
        else:
            found.append(m)
    yield from (m for m in found if not open_ or m.start() < first)
    if open_:  # a template without end: what follows is read without nesting
        yield from ISLANDS[key].finditer(text, first)


_PARTS = re.compile(rf"(?s){_LITERALS['python']}|#[^\n]*")


def functions(language: str, text: str) -> list[tuple[int, str, str, str]]:
    """(offset of the name, name, signature, raw documentation) of the documented functions."""
    key = "script" if language in ("javascript", "typescript") else language
    g, out = grammar(language), []
    for m in islands(key, text):
        if m[1] is None:
            continue
        if key == "python":
            r = g.match(text, "Start", m.start(1))
            if r and "doc" in r[1]:
                a, b = r[1]["name"]
                parts = [p[0] for p in _PARTS.finditer(text, *r[1]["doc"]) if p[0][0] != "#"]
                out.append((a, text[a:b], " ".join(text[m.start(1) : r[1]["params"][1]].split()), "".join(d[3:-3] if d[:3] in ('"""', "'''") else d[1:-1] for d in parts)))
            continue
        at = m.end() if key == "go" else m.end(1)
        r = g.match(text, "Start", at)
        if r and "record" in r[1]:  # the constructor of a record without parameters looks like a constant of an enum
            a, b = r[1]["record"]
            if re.search(rf"\brecord\s+{re.escape(text[a:b])}\b", text):
                out.append((a, text[a:b], " ".join(text[at:b].split()), m[1]))
        elif r and "name" in r[1]:
            a, b = r[1]["name"]
            out.append((a, text[a:b], " ".join(text[at : r[1].get("params", (0, r[0]))[1]].split()), m[1]))
    return out


_TAGS = re.compile(r"(?ms)^[ \t]*[@\\](?:param|arg|argument|return|returns|throws|exception|see|since|author|version|deprecated|type|template|typeparam|example|default|yields?)\b.*?(?=^[ \t]*[@\\]\w|\Z)")
_XML = re.compile(r"(?s)<(param|returns|exception|typeparam|value|example|code|seealso|permission)\b[^>]*?(?:/>|>.*?</\1>)")
_SECTIONS = re.compile(r"(?ms)^[ \t]*(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Attributes|Examples?|Keyword Args)\s*:?[ \t]*(?:\n[ \t]*-{3,})?[ \t]*\n.*|^[ \t]*:(?:param|type|returns?|rtype|raises?|arg|keyword|yields?)\b[^\n]*(?:\n[ \t]+[^\n]*)*")
_STUB = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack|wip)\b|auto-?generated (?:method )?(?:stub|comment)|fill in before|\bto be (?:documented|written|described)\b|^\W*(?:documentation|description) (?:missing|pending|goes here)|write (?:the )?(?:documentation|docs) |undocumented|no (?:description|documentation)\b|lorem ipsum|\bplaceholder\b\.?$")
_INHERIT = re.compile(r"(?i)\{@inheritdoc\}|<inheritdoc\b|@inheritdoc|@override\b|^\W*(?:inherited|inherits doc|\(non-javadoc\))|^\W*(?:see|cf\.?) (?:the )?(?:base|super|parent|overridden|interface|also)\b|^\W*see (?:also )?[\w.#:()]+\W*$|same as (?:the )?(?:base|super|parent)")
_CODE = re.compile(r"(?m)^[ \t]*(?:[\w.$]+(?:\.[\w$]+)*\([^()\n]*(?:\([^()]*\)[^()\n]*)*\)\s*[;{]?|(?:return|var|let|const|if|for|while|def|func|import|throw|await|new)\b[^\n]*[;{)]|[\w.$\[\]]+\s*:?=\s*[^=\n]+;?|[{}]+;?|.*;)[ \t]*$")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}_'’-]*|\p{N}+")
_GLUE = frozenset("a an the of to for and or in on by with from this that its it is are be get gets getter set sets setter return returns given function method".split())


def plain(language: str, raw: str) -> str:
    """The description without comment markers, tags, XML and described parameters."""
    if language == "python":
        t = _SECTIONS.sub("", raw)
    elif language == "go":
        t = re.sub(r"(?m)^[ \t]*// ?(?:go:\S.*)?", "", raw)
    elif language == "csharp":
        t = re.sub(r"(?m)^[ \t]*/// ?", "", raw)
        t = re.sub(r"<[^<>\n]*>", " ", _XML.sub(" ", t)) if not _INHERIT.search(t) else t
    else:
        t = re.sub(r"(?m)^[ \t]*\*+ ?", "", re.sub(r"^/\*\*+|\*+/$", "", raw))
        t = _TAGS.sub("", re.sub(r"\{@(?!inherit)\w+ ([^}]*)\}", r"\1", t))
    return t.strip()


def split_name(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def _stem(w: str) -> str:
    return re.sub(r"(?:ings?|ers?|ed|es|s|e)$", "", w) if len(w) > 3 else w


def informative(text: str, name: str) -> bool:
    """At least five words that say more than the name, and no note, reference, rule or code."""
    text = re.sub(rf"^{re.escape(name)}(?:\(\))?\s*[:\-–]?\s+", "", text)
    if not text or _STUB.search(text) or _INHERIT.search(text):
        return False
    if re.fullmatch(r"[\W_]*", text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if sum(1 for x in lines if _CODE.match(x)) * 2 >= len(lines):
        return False
    lines = [x for x in lines if not re.fullmatch(r"[\W_]*", x)]
    words = _WORDS.findall(" ".join(lines))
    glyphs = len(_CJK.findall(text))
    if len(words) + glyphs // 2 < 5:
        return False
    own = {_stem(w) for w in split_name(name)}
    return glyphs >= 6 or any(_stem(w.lower()) not in own and w.lower() not in _GLUE for w in words)


SCHEMA = "line_no int, name string, signature string, description string"


def documented_functions(files: DataFrame, key: str = "file_id", path_col: str = "file_path", language_col: str = "language", text_col: str = "content") -> DataFrame:
    """(key, line_no, name, signature, description): functions with a real description.

    ``line_no`` is the line, counted from 0, on which the name is declared. Files of other or unknown languages and
    null texts give nothing. Repeated rows count once; of a key with several texts each gives its functions.
    """
    rows = files.select(F.col(key).alias("key"), language_of(F.col(path_col), F.col(language_col)).alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")
    key_type = rows.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, lang, t in zip(b["key"], b["lang"], b["t"]):
                found = [(a, n, s, d) for a, n, s, raw in functions(lang, t) if informative(d := plain(lang, raw), n)]
                if found:
                    breaks = np.flatnonzero(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) == 10)
                    out += [(k, int(np.searchsorted(breaks, a)), n, s, d) for a, n, s, d in found]
            yield pd.DataFrame(out, columns=["key", "line_no", "name", "signature", "description"])

    return rows.mapInPandas(scan, f"key {key_type}, {SCHEMA}").distinct().withColumnRenamed("key", key)
