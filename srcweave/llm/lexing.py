"""Lexers that turn a source text into a string with one character per token.

Comments and blanks vanish; newlines stay where the language gives them meaning. What no token of
the language matches becomes the kind ``bad``. Keyword lists are fixed values of the languages.
"""

from __future__ import annotations

import re

#: Kinds of tokens and their characters; keywords get characters of their own after these.
KINDS = {
    "id": "i", "num": "n", "str": "s", "bin": "o", "add": "+", "amp": "&", "star": "*", "inc": "u", "not": "!", "set": "a", "eq": "=", "lt": "<", "gt": ">", "q": "?", "colon": ":",
    "dot": ".", "comma": ",", "semi": ";", "lp": "(", "rp": ")", "lb": "[", "rb": "]", "lc": "{", "rc": "}", "arrow": "A", "at": "@", "dots": "D", "pair": "C", "recv": "h", "define": "d", "bad": "X", "nl": "\n", "tilde": "~",
}

WORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null yield",
    "javascript": "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async of get set from as",
    "typescript": "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async of enum implements interface private protected public readonly abstract declare type keyof as is infer namespace get set from override asserts satisfies module global accessor unique out",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while where when",
}

_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_LINE = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_ID = r"[^\W\d]\w*"
_TAIL = r"\n|[^\s]"

#: Tokens in order of preference; a single character that no kind knows is bad.
PATTERNS = {
    "python": r"#[^\n]*|(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|" + _NUM + r"[jJ]?(?!\w)|" + _ID + r"|\\\n|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=|\n[ \t\f]*|[^\s]",
    "go": _LINE + r"|`[^`]*`|" + _DQ + r"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'|" + _NUM + r"i?(?!\w)|" + _ID + r"|&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|&\^|<<|>>|[-+*/%&|^]=|" + _TAIL,
    "java": _LINE + r'|"""(?:[^\\]|\\.)*?"""|' + _DQ + r"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'|" + _NUM + r"[lLfFdD]?(?!\w)|[^\W\d$]?[\w$]+|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[-+*/%&|^]=|[^\s]",
    "javascript": _LINE + r"|@[A-Za-z_$][\w.$]*|`(?:[^`\\]|\\.)*`|" + _DQ + r"|'(?:[^'\\\n]|\\.)*'|(?<=[=(,:\[!&|?{};\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|" + _NUM + r"n?(?![\w$])|#?[^\W\d]?[\w$]+|>>>=|\*\*=|&&=|\|\|=|\?\?=|<<=|>>=|===|!==|\.\.\.|=>|\?\.|\?\?|\+\+|--|&&|\|\||==|!=|<=|>=|\*\*|<<|[-+*/%&|^]=|" + _TAIL,
    "csharp": _LINE + r'|^[ \t]*#[a-z][^\n]*|"""(?:[^"]|"(?!""))*"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?' + _DQ + r"|'(?:[^'\\\n]|\\[xuU][0-9a-fA-F]+|\\.)'|" + _NUM + r"[lLuUfFdDmM]{0,2}(?!\w)|@?" + _ID + r"|\?\?=|<<=|>>=|\?\.|\?\?|=>|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|\.\.|[-+*/%&|^]=|[^\s]",
}
PATTERNS["typescript"] = PATTERNS["javascript"]

OPERATORS = {
    "bin": "/ % ^ | && || ?? == != === !== <= >= << >> >>> ** // &^", "add": "+ -", "amp": "&", "star": "*", "inc": "++ --", "not": "!", "tilde": "~", "set": "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= //= &&= ||= ??= @= &^=", "eq": "=",
    "lt": "<", "gt": ">", "q": "?", "colon": ":", "dot": ". ?.", "comma": ",", "semi": ";", "lp": "(", "rp": ")", "lb": "[", "rb": "]", "lc": "{", "rc": "}", "arrow": "-> =>", "at": "@", "dots": "... ..", "pair": "::", "recv": "<-", "define": ":=",
}


class Kinds(dict):
    """Token -> character, filled as tokens appear."""

    def __init__(self, language: str):
        super().__init__()
        self.language = language
        self.words = {w: chr(0x100 + i) for i, w in enumerate(WORDS[language].split())}
        self.fixed = {op: KINDS[k] for k, ops in OPERATORS.items() for op in ops.split()} | self.words
        self.names = {c: k for k, c in KINDS.items()} | {c: w for w, c in self.words.items()}
        python = language == "python"
        if python:
            for bad in "? $ ! ++ -- && || ?? ?. =>".split():
                self.fixed[bad] = KINDS["bad"]
        if language == "go":
            self.fixed["?"] = self.fixed["@"] = KINDS["bad"]
        if language == "java":
            self.fixed["#"] = KINDS["bad"]
        self.comments = ("#",) if python else ("//", "/*")

    def __missing__(self, t: str) -> str:
        c = t[0]
        if t in self.fixed:
            k = self.fixed[t]
        elif t.startswith(self.comments) and (self.language == "python" or len(t) > 1):
            k = "\n" if "\n" in t and self.language not in ("python", "java", "csharp") else ""
            return k
        elif c == "\n":
            return "\n"
        elif t[-1] in "\"'`" and len(t) > 1:
            return "s"
        elif c.isdigit() or c == "." and len(t) > 1:
            return "n"
        elif c == "\\" and t[-1] == "\n":
            k = ""
        elif c.isalpha() or c in "_$" or c in "@#" and len(t) > 1:
            if self.language == "csharp" and c == "#":
                return ""
            k = "@" if c == "@" and self.language in ("javascript", "typescript") else "i" if all(x.isalnum() or x in "_$@#" for x in t) else "X"
        elif c == "/" or t.lstrip(" \t")[:1] == "/" and len(t) > 2:
            return "s"  # regular expression
        elif self.language == "csharp" and t.lstrip(" \t")[:1] == "#" and len(t) > 1:
            return ""
        else:
            k = "X"
        if len(self) < 200_000:
            self[t] = k
        return k


_FIND = {lang: re.compile(p, re.S | (re.M if lang == "csharp" else 0)) for lang, p in PATTERNS.items()}
_KINDS = {lang: Kinds(lang) for lang in PATTERNS}


def kinds(language: str) -> Kinds:
    return _KINDS[language]


def tokens(language: str, text: str) -> list[str]:
    return _FIND[language].findall(text)


def classes(language: str, toks: list[str]) -> str:
    """One character per token; for Python, newlines come with their indentation in ``toks`` only."""
    k = _KINDS[language]
    return "".join([k[t] for t in toks])


def semicolons(language: str, s: str) -> str:
    """Replace newlines by the semicolons the language inserts, drop the others."""
    w = _KINDS[language].words
    if language == "go":
        end = "ins)]}u" + "".join(w[x] for x in ("break", "continue", "fallthrough", "return"))
        s = re.sub(f"(?<=[{re.escape(end)}])\n+", ";", s)
        return s.replace("\n", "")
    end = "ins)]}u>" + "".join(w[x] for x in ("break", "continue", "return", "this", "true", "false", "null", "super", "debugger", "void", "of", "static", "async") if x in w) + "".join(w[x] for x in ("type", "as", "is", "declare", "namespace", "abstract", "readonly") if x in w)
    stop = "ins([{@!u~D+*" + "".join(c for x, c in w.items() if x not in ("in", "instanceof", "of", "extends", "implements", "as", "is", "else", "catch", "finally", "from", "satisfies"))
    s = re.sub(f"(?<=[{re.escape(end)}])\n+(?=[{re.escape(stop)}}}])", ";", s)
    return s.replace("\n", "")
