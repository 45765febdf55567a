"""Syntax check of Java and C++ sources: lexer, bracket matching and a recursive-descent grammar over token kinds.

Names and types need not resolve, so the grammar looks at kinds only; that lets the verdict on a simple statement or
header be remembered by its kinds. Raises Bad where the text is no sentence of the grammar.
"""

from __future__ import annotations

import re


class Bad(Exception):
    pass


_JAVA_LEX = re.compile(
    r'[ \t\r\n\f]+|//[^\n]*|/\*.*?\*/'
    r'|(?P<l>"""[ \t\f]*\n(?:[^"\\]|\\.|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")'
    r"|'(?:[^'\\\n]|\\(?:[0-7]{1,3}|u+[0-9a-fA-F]{4}|.))'"
    r"|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?(?!\w)|0[bB][01_]+[lL]?(?!\w)"
    r"|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?(?![\w]))"
    r"|(?P<w>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<o>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^!<=]=|[-+*/%&|^!<>=~?:;,.@(){}\[\]])",
    re.S,
)
_CPP_LEX = re.compile(
    r"[ \t\r\n\f\v]+|\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\.)*|/\*.*?\*/"
    r'|(?P<l>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"|(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r?\n|.))*"'
    r"|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'"
    r"|0[xX][0-9a-fA-F'.]+(?:[pP][+-]?\d+)?[uUlLzZfF]*(?!\w)|0[bB][01']+[uUlLzZ]*(?!\w)"
    r"|(?:\d[\d']*(?:\.[\d']*)?|\.\d[\d']*)(?:[eE][+-]?\d+)?(?:[uUlLzZfF]{0,3}|_\w+)(?!\w))"
    r"|(?P<w>[^\W\d]\w*)"
    r"|(?P<o>\.\.\.|->\*?|::|\+\+|--|&&|\|\||<<=|<=>|<<|\.\*|[-+*/%&|^!<=]=|[-+*/%&|^!<>=~?:;,.(){}\[\]])",
    re.S,
)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:[^\n\\]|\\\r?\n|\\.)*", re.M)
_GOOD_DIRECTIVE = re.compile(
    r'[ \t]*#[ \t]*(?:include[ \t]*(?:<[^>\n]+>|"[^"\n]+"|[A-Za-z_]\w*)\s*(?://.*|/\*.*)?\s*\Z|define[ \t]+[A-Za-z_]'
    r"|undef[ \t]+[A-Za-z_]|if(?:n?def[ \t]+[A-Za-z_]|[ \t(!])|el(?:if[ \t(!]|se\b)|endif\b|pragma\b|error\b|warning\b|line\b|\s*\Z)", re.S)

JAVA_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while _".split())
CPP_KEYWORDS = frozenset(
    "alignas alignof asm auto bool break case catch char char8_t char16_t char32_t class concept const consteval constexpr constinit const_cast continue "
    "decltype default delete do double dynamic_cast else enum explicit extern false float for friend goto if inline int long mutable namespace new "
    "noexcept nullptr operator private protected public register reinterpret_cast requires return short signed sizeof static static_assert static_cast "
    "struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while".split())
_LITERAL_WORDS = frozenset(("true", "false", "null", "nullptr"))
#: Where a statement may begin, yield is one.
_BEFORE_YIELD = frozenset(("{", "}", ";", "->", ")", ":"))
#: A closing angle, alone or right after another.
_CLOSE = frozenset((">", ">g"))
_OPEN = {"(": ")", "[": "]", "{": "}"}


def lex(text: str, java: bool, names: dict[int, str] | None = None) -> list[str]:
    """Kinds: i for identifiers, l for literals, keywords and signs as themselves, then eof. names gets identifiers by place."""
    if not java:
        for m in _DIRECTIVE.finditer(text) if "#" in text else ():
            if not _GOOD_DIRECTIVE.match(m.group()):
                # inside a comment or raw string a # is no directive
                if not _inside_comment(text, m.start()):
                    raise Bad("directive")
        text = _DIRECTIVE.sub(lambda m: m.group() if _inside_comment(text, m.start()) else " ", text) if "#" in text else text
    keywords = JAVA_KEYWORDS if java else CPP_KEYWORDS
    kinds: list[str] = []
    add = kinds.append
    at, string, greater = 0, False, -1
    for m in (_JAVA_LEX if java else _CPP_LEX).finditer(text):
        if m.start() != at:
            raise Bad("character")
        at = m.end()
        g = m.lastgroup
        if g is None:
            continue
        after_string, string = string, False
        if g == "w":
            w = m.group()
            if java and w == "yield" and kinds and kinds[-1] in _BEFORE_YIELD:
                add("yield")
            else:
                if names is not None:
                    names[len(kinds)] = w
                add("l" if w in _LITERAL_WORDS else w if w in keywords else "i")
        elif g == "o":
            o = m.group()
            if o[0] in ">=" and greater == m.start():  # part of >> >= and the like; closing angles go one by one
                if o == "==":
                    raise Bad("sign")
                o += "g"
            if o[0] == ">":
                greater = at
            add(o)
        else:
            string = not java and text[at - 1] == '"'
            if not (string and after_string):  # adjacent strings are one
                add("l")
    if at != len(text):
        raise Bad("character")
    add("eof")
    return kinds


def _inside_comment(text: str, at: int) -> bool:
    a = text.rfind("/*", 0, at)
    return a >= 0 and text.find("*/", a + 2, at) < 0


def brackets(kinds: list[str]) -> dict[int, int]:
    match: dict[int, int] = {}
    open_: list[int] = []
    for p, k in enumerate(kinds):
        if k in ("(", "[", "{"):
            open_.append(p)
        elif k in (")", "]", "}"):
            if not open_ or _OPEN[kinds[open_[-1]]] != k:
                raise Bad("bracket")
            match[open_.pop()] = p
    if open_:
        raise Bad("bracket")
    return match


_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="))
_BINARY = _ASSIGN | frozenset(("+", "-", "*", "/", "%", "&", "|", "^", "<", "<=", "==", "!=", "&&", "||", "<<", "<=>", ".*", "->*"))
_JAVA_PRIMITIVE = frozenset("boolean byte char short int long float double void".split())
_CPP_PRIMITIVE = frozenset("bool char char8_t char16_t char32_t wchar_t short int long float double void signed unsigned auto".split())
_CPP_SPECIFIER = frozenset(
    "const volatile static constexpr consteval constinit inline extern mutable register virtual explicit friend thread_local typename typedef".split())
_JAVA_MODIFIER = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
def _sane(words: list[str]) -> bool:
    """Whether primitive words make one type, such as unsigned long long int."""
    base = [w for w in words if w not in ("signed", "unsigned", "short", "long")]
    longs = words.count("long")
    return len(base) <= 1 and longs <= 2 and words.count("short") <= 1 and words.count("signed") + words.count("unsigned") <= 1 and not (
        base and base[0] not in ("int", "char", "double")) and not (longs and "short" in words)


_SEEN: dict[tuple[bool, str], bool] = {}
_SEEN_LIMIT = 200_000


class Parser:
    def __init__(self, kinds: list[str], java: bool, names: dict[int, str] | None = None):
        self.k, self.m, self.java, self.names = kinds, brackets(kinds), java, names or {}
        self.primitive = _JAVA_PRIMITIVE if java else _CPP_PRIMITIVE

    def need(self, p: int, kind: str) -> int:
        if self.k[p] != kind:
            raise Bad(f"{kind} expected")
        return p + 1

    # ---- types ----
    def type(self, p: int) -> int:
        q = self.try_type(p)
        if q < 0:
            raise Bad("type expected")
        return q

    def annotations(self, p: int) -> int:
        k = self.k
        while k[p] == "@" and k[p + 1] == "i":
            p += 2
            while k[p] == "." and k[p + 1] == "i":
                p += 2
            if k[p] == "(":
                p = self.m[p] + 1
        return p

    def try_type(self, p: int, pointers: bool = True) -> int:
        k = self.k
        if self.java:
            p = self.annotations(p)
            if k[p] in _JAVA_PRIMITIVE:
                p += 1
            elif k[p] == "i":
                p = self.targs(p + 1)
                while p > 0 and k[p] == "." and k[p + 1] == "i":
                    p = self.targs(p + 2)
                if p < 0:
                    return -1
            else:
                return -1
            while k[p] == "[" and k[p + 1] == "]":
                p += 2
            return p
        start = p
        core = False
        words: list[str] = []
        while True:
            if k[p] in _CPP_SPECIFIER:
                p += 1
                if k[p - 1] == "explicit" and k[p] == "(":
                    p = self.m[p] + 1
            elif k[p] in _CPP_PRIMITIVE and (core is False or core is True and words):
                words.append(k[p])
                core, p = True, p + 1
            elif k[p] in ("struct", "class", "enum", "union") and not core and k[p + 1] == "i":
                p += 1
            elif k[p] == "decltype" and k[p + 1] == "(" and not core:
                core, p = True, self.m[p + 1] + 1
            elif not core and (k[p] == "i" or k[p] == "::" and k[p + 1] == "i"):
                p = self.targs(p + 1 + (k[p] == "::"))
                while k[p] == "::" and k[p + 1] in ("i", "template"):
                    p = self.targs(p + 2 + (k[p + 1] == "template"))
                core = True
            else:
                break
        if not core or len(words) > 1 and not _sane(words):
            return -1
        if pointers:
            while k[p] in ("*", "&", "&&", "const", "volatile", "..."):
                p += 1
        return p if p > start else -1

    def targs(self, p: int, diamond: bool = False) -> int:
        """Position after <...> at p; p where there is none or, for C++, where it is no argument list; Java: -1."""
        k, start = self.k, p
        none = -1 if self.java else start
        if k[p] != "<":
            return p
        p += 1
        if k[p] in _CLOSE:
            return p + 1 if diamond or not self.java else -1
        while True:
            if self.java:
                p = self.annotations(p)
                if k[p] == "?":
                    p += 1
                    if k[p] not in ("extends", "super"):
                        q = p
                    else:
                        q = self.try_type(p + 1)
                else:
                    q = self.try_type(p)
                    if q > 0 and k[q] == "extends":
                        q = self.try_type(q + 1)
                while q > 0 and k[q] == "&":
                    q = self.try_type(q + 1)
            else:
                q = self.try_type(p)
                if q > 0 and k[q] == "(":
                    q = self.m[q] + 1
                elif q > 0 and k[q] in ("+", "-", "/", "%") and k[q + 1] in ("i", "l"):
                    q += 2
                elif q < 0 and (k[p] == "l" or k[p] == "-" and k[p + 1] == "l"):
                    q = p + 1 + (k[p] == "-")
                    while k[q] in ("+", "-", "*", "/", "%", "<<") and k[q + 1] in ("l", "i"):
                        q += 2
                elif q < 0 and k[p] == "(":
                    q = self.m[p] + 1
            if q < 0:
                return none
            if k[q] == ",":
                p = q + 1
            elif k[q] in _CLOSE:
                return q + 1
            else:
                return none

    # ---- expressions ----
    def expr(self, p: int, comma: bool = False) -> int:
        k = self.k
        while True:
            p = self.unary(p)
            while True:
                t = k[p]
                if t == ">":
                    n = 1
                    while k[p + n] == ">g":
                        n += 1
                    if n > 2 + self.java:
                        raise Bad("sign")
                    p += n + (k[p + n] == "=g")
                elif t in _BINARY:
                    p += 1
                    if t in _ASSIGN and k[p] == "{" and not self.java:
                        p = self.braces(p)
                        continue
                elif t == "?":
                    p = self.expr(p + 1, not self.java)
                    p = self.need(p, ":")
                    if not self.java and k[p] == "throw":
                        return self.expr(p + 1)
                elif t == "instanceof" and self.java:
                    p += 1
                    if k[p] == "final":
                        p += 1
                    p = self.type(p)
                    if k[p] == "(":
                        p = self.m[p] + 1
                    elif k[p] == "i":
                        p += 1
                    continue
                elif t == "," and comma:
                    p += 1
                else:
                    return p
                break

    def args(self, p: int) -> int:
        """A parenthesised or bracketed list that opens at p."""
        end = self.m[p]
        p += 1
        if p == end:
            return end + 1
        while True:
            if self.k[p] == "{" and not self.java:
                p = self.braces(p)
            else:
                p = self.expr(p)
            if self.k[p] == "..." and not self.java:
                p += 1
            if p == end:
                return end + 1
            p = self.need(p, ",")

    def braces(self, p: int) -> int:
        """Initialiser list; a last comma may stand, designators are C++."""
        end = self.m[p]
        p += 1
        while p < end:
            if self.k[p] == "." and self.k[p + 1] == "i" and not self.java:
                p += 2
                if self.k[p] == "=":
                    p += 1
            p = self.braces(p) if self.k[p] == "{" else self.expr(p)
            if self.k[p] == "..." and not self.java:
                p += 1
            if p < end:
                p = self.need(p, ",")
        return end + 1

    def unary(self, p: int) -> int:
        k, java = self.k, self.java
        while k[p] in ("+", "-", "!", "~", "++", "--") or not java and (k[p] in ("*", "&", "&&", "throw") or k[p] in ("sizeof", "alignof") and k[p + 1] != "("):
            p += 1
            if k[p - 1] == "sizeof" and k[p] == "...":
                p += 1
            if k[p - 1] == "throw" and k[p] in (";", ")", ":"):
                return p
        t = k[p]
        if t == "(":
            end = self.m[p]
            if java and k[end + 1] == "->":
                self.java_params(p, bare=True)
                return self.lambda_body(end + 2)
            q = self.try_type(p + 1)
            while java and q > 0 and k[q] == "&":
                q = self.try_type(q + 1)
            if q == end:
                after = k[end + 1]
                primitive = k[p + 1] in self.primitive or k[p + 1] in _CPP_SPECIFIER or k[end - 1] in ("*", "]")
                if after in ("i", "l", "(", "!", "~", "this", "super", "new", "switch", "sizeof") or after in self.primitive or \
                        (primitive or not java and k[end - 1] in ("*", "&")) and after in ("+", "-", "++", "--", "*", "&") or \
                        not java and after in ("static_cast", "{", "["):
                    if not (after == "(" and not primitive and not java) and not (after == "[" or after == "{") or primitive and after == "{":
                        if after == "{":
                            return self.postfix(self.braces(end + 1))
                        return self.unary(end + 1)
            if not java and (k[p + 1] == "..." or k[p + 1] == "{"):
                return self.postfix(end + 1)
            q = self.expr(p + 1, not java)
            if q != end:
                if not java and k[q] == "..." or not java and k[q] in _BINARY and k[q + 1] == "...":
                    return self.postfix(end + 1)
                raise Bad("parenthesis")
            return self.postfix(end + 1)
        if t == "i":
            if java:
                if k[p + 1] == "->":
                    return self.lambda_body(p + 2)
                if k[p + 1] == "<":
                    q = self.try_type(p)
                    if q > 0 and k[q] == "::":
                        return self.postfix(q)
                elif k[p + 1] == "[" and k[p + 2] == "]":
                    q = self.try_type(p)
                    return self.postfix(q) if k[q] == "::" else self.postfix(self.need(self.need(q, "."), "class"))
                return self.postfix(p + 1)
            return self.cpp_name(p)
        if t == "l":
            return self.postfix(p + 1)
        if t in ("this", "super"):
            return self.postfix(p + 1)
        if t == "new":
            return self.new(p + 1)
        if java:
            if t in _JAVA_PRIMITIVE:
                q = self.type(p)
                if k[q] == "::":
                    return self.postfix(q)
                return self.postfix(self.need(self.need(q, "."), "class"))
            if t == "switch" and k[p + 1] == "(":
                self.header(p + 1)
                return self.postfix(self.switch_body(self.m[p + 1] + 1))
            if t == "@":
                return self.unary(self.annotations(p))
            raise Bad("expression expected")
        if t == "::":
            return self.cpp_name(p + 1)
        if t == "[":
            return self.cpp_lambda(p)
        if t == "delete":
            p += 1
            if k[p] == "[" and k[p + 1] == "]":
                p += 2
            return self.unary(p)
        if t in ("sizeof", "alignof", "typeid", "decltype", "noexcept"):
            q = self.need(p + 1, "(") - 1
            if self.try_type(q + 1) != self.m[q] and self.expr(q + 1, True) != self.m[q]:
                raise Bad("operand")
            return self.postfix(self.m[q] + 1)
        if t in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"):
            q = self.targs(p + 1)
            if q == p + 1:
                raise Bad("cast")
            return self.postfix(self.args(self.need(q, "(") - 1))
        if t in _CPP_PRIMITIVE or t == "typename":
            q = self.try_type(p, pointers=False)
            if q > 0 and k[q] == "(":
                return self.postfix(self.args(q))
            if q > 0 and k[q] == "{":
                return self.postfix(self.braces(q))
        if t == "operator":
            return self.postfix(self.operator_name(p))
        raise Bad("expression expected")

    def cpp_name(self, p: int) -> int:
        k = self.k
        p = self.need(p, "i")
        while True:
            if k[p] == "<":
                q = self.targs(p)
                if q > p and k[q] in ("(", "::", "{", ")", ",", ";"):
                    p = q
            if k[p] == "::" and k[p + 1] in ("i", "~", "template", "operator"):
                if k[p + 1] == "operator":
                    return self.postfix(self.operator_name(p + 1))
                p += 2 + (k[p + 1] == "~") + (k[p + 1] == "template")
            else:
                break
        if k[p] == "l" and k[p - 1] == "i":
            raise Bad("operator expected")
        if k[p] == "{":
            return self.postfix(self.braces(p))
        return self.postfix(p)

    def operator_name(self, p: int) -> int:
        k = self.k
        p += 1
        if k[p] in ("(", "["):
            return self.m[p] + 1
        if k[p] in ("new", "delete"):
            return p + 1 + 2 * (k[p + 1] == "[")
        if k[p] == "l":
            return p + 1 + (k[p + 1] == "i")
        q = self.try_type(p)
        if q > 0:
            return q
        while k[p] not in ("(", "eof"):
            p += 1
        return p

    def postfix(self, p: int) -> int:
        k, java = self.k, self.java
        while True:
            t = k[p]
            if t == ".":
                n = k[p + 1]
                if n == "i":
                    p += 2
                elif java:
                    if n == "<":
                        p = self.need(self.targs(p + 1), "i")
                    elif n in ("this", "class", "super"):
                        p += 2
                    elif n == "new":
                        p = self.new(p + 2)
                    else:
                        raise Bad("member")
                else:
                    p = self.cpp_member(p + 1)
                if not java and k[p] == "<":
                    q = self.targs(p)
                    if q > p and k[q] == "(":
                        p = q
            elif t == "->" and not java:
                p = self.cpp_member(p + 1)
            elif t == "(":
                p = self.args(p)
            elif t == "[":
                if k[p + 1] == "]":
                    return p
                q = self.braces(p + 1) if k[p + 1] == "{" and not java else self.expr(p + 1, not java)
                if q != self.m[p]:
                    raise Bad("index")
                p = q + 1
            elif t in ("++", "--"):
                p += 1
            elif t == "::" and java:
                p += 1
                if k[p] == "<":
                    p = self.targs(p)
                if k[p] not in ("i", "new"):
                    raise Bad("reference")
                p += 1
            else:
                return p

    def cpp_member(self, p: int) -> int:
        k = self.k
        if k[p] == "template":
            p += 1
        if k[p] == "operator":
            return self.operator_name(p)
        if k[p] == "~":
            p += 1
        p = self.need(p, "i")
        while k[p] == "::" and k[p + 1] == "i":
            p += 2
        return p

    def new(self, p: int) -> int:
        k = self.k
        if self.java:
            p = self.annotations(p)
            if k[p] == "<":
                p = self.targs(p)
            if k[p] in _JAVA_PRIMITIVE:
                p += 1
            else:
                p = self.targs(self.need(p, "i"), diamond=True)
                while p > 0 and k[p] == ".":
                    p = self.targs(self.need(p + 1, "i"), diamond=True)
                if p < 0:
                    raise Bad("type")
            if k[p] == "(":
                p = self.args(p)
                if k[p] == "{":
                    p = self.class_body(p)
                return self.postfix(p)
            if k[p] != "[":
                raise Bad("new")
            sized = False
            while k[p] == "[":
                if k[p + 1] == "]":
                    p += 2
                else:
                    if self.expr(p + 1) != self.m[p]:
                        raise Bad("size")
                    sized, p = True, self.m[p] + 1
            if k[p] == "{" and not sized:
                p = self.braces(p)
            elif not sized:
                raise Bad("size")
            return self.postfix(p)
        if k[p] == "(":
            p = self.m[p] + 1
        p = self.type(p)
        while k[p] == "[":
            if k[p + 1] != "]" and self.expr(p + 1) != self.m[p]:
                raise Bad("size")
            p = self.m[p] + 1
        if k[p] == "(":
            p = self.args(p)
        elif k[p] == "{":
            p = self.braces(p)
        return self.postfix(p)

    def lambda_body(self, p: int) -> int:
        return self.block(p) if self.k[p] == "{" else self.expr(p)

    def cpp_lambda(self, p: int) -> int:
        k = self.k
        p = self.m[p] + 1
        if k[p] == "<":
            p = self.targs(p)
        if k[p] == "(":
            p = self.cpp_params(p)
        while k[p] in ("mutable", "constexpr", "noexcept", "static"):
            p += 1
            if k[p - 1] == "noexcept" and k[p] == "(":
                p = self.m[p] + 1
        if k[p] == "->":
            p = self.type(p + 1)
        if k[p] != "{":
            raise Bad("lambda")
        return self.postfix(self.block(p))

    # ---- parameters and declarators ----
    def java_params(self, p: int, bare: bool = False) -> int:
        """Typed parameters, or the bare names of a lambda."""
        k, end = self.k, self.m[p]
        p += 1
        if p == end:
            return end + 1
        while True:
            while k[p] in ("final", "@"):
                p = p + 1 if k[p] == "final" else self.annotations(p)
            if bare and k[p] == "i" and k[p + 1] in (",", ")"):
                p += 1
            else:
                p = self.type(p)
                if k[p] == "...":
                    p += 1
                if k[p] == "this":
                    p += 1
                else:
                    p = self.need(p, "i")
                while k[p] == "[" and k[p + 1] == "]":
                    p += 2
            if p == end:
                return end + 1
            p = self.need(p, ",")

    def cpp_params(self, p: int) -> int:
        k, end = self.k, self.m[p]
        p += 1
        if p == end:
            return end + 1
        while True:
            if k[p] == "...":
                p += 1
            else:
                p = self.type(p)
                if k[p] == "(" and k[p + 1] in ("*", "&"):
                    p = self.m[p] + 1
                    if k[p] == "(":
                        p = self.cpp_params(p)
                elif k[p] == "i":
                    p += 1
                elif k[p] == "(":
                    p = self.cpp_params(p)
                while k[p] == "[":
                    p = self.m[p] + 1
                if k[p] == "=":
                    p = self.braces(p + 1) if k[p + 1] == "{" else self.expr(p + 1)
            if p == end:
                return end + 1
            p = self.need(p, ",")

    def java_declarators(self, p: int) -> int:
        k = self.k
        while True:
            p = self.need(p, "i")
            while k[p] == "[" and k[p + 1] == "]":
                p += 2
            if k[p] == "=":
                p = self.braces(p + 1) if k[p + 1] == "{" else self.expr(p + 1)
            if k[p] != ",":
                return p
            p += 1

    def cpp_declarators(self, p: int, first: bool = True) -> int:
        """Declarators after the type up to ; : or )."""
        k = self.k
        while True:
            while k[p] in ("*", "&", "&&", "const"):
                p += 1
            if k[p] == "[":  # structured binding
                p = self.m[p] + 1
            elif k[p] == "(" and k[p + 1] in ("*", "&"):
                p = self.m[p] + 1
                if k[p] == "(":
                    p = self.cpp_params(p)
            else:
                p = self.need(p, "i")
                p = self.targs(p)
                while k[p] == "::" and k[p + 1] == "i":
                    p += 2
            while k[p] == "[":
                if k[p + 1] != "]" and self.expr(p + 1) != self.m[p]:
                    raise Bad("size")
                p = self.m[p] + 1
            if k[p] == "=":
                p = self.braces(p + 1) if k[p + 1] == "{" else self.expr(p + 1)
            elif k[p] == "(":
                try:
                    p = self.args(p)
                except Bad:
                    p = self.cpp_params(p)
            elif k[p] == "{":
                p = self.braces(p)
            elif k[p] == ":" and k[p + 1] == "l":
                p += 2
            if k[p] != ",":
                return p
            p += 1

    # ---- statements ----
    def block(self, p: int) -> int:
        end = self.m[self.need(p, "{") - 1]
        p += 1
        while p < end:
            p = self.statement(p)
        if p != end:
            raise Bad("block")
        return end + 1

    def header(self, p: int, check=None) -> int:
        """A parenthesised condition at p, remembered by its kinds."""
        end = self.m[self.need(p, "(") - 1]
        words = self.k[p:end + 1]
        key = None if "{" in words else (self.java, f"{check.__name__ if check else ''} {' '.join(words)}")
        if key is None or key not in _SEEN:
            (check or self.condition)(p, end)
            if key is not None:
                remember(key)
        return end + 1

    def condition(self, p: int, end: int) -> None:
        k = self.k
        p += 1
        if not self.java:
            q = self.try_type(p)
            if q > 0 and (k[q] == "i" or k[q] == "[" and q > p) and k[q] != "[" and k[q + 1] in ("=", "{", ";"):
                q = self.cpp_declarators(q)
                if k[q] == ";":
                    q = self.expr(q + 1, True)
                if q == end:
                    return
                raise Bad("condition")
            q = self.expr(p, True)
            if k[q] == ";":
                q = self.expr(q + 1, True)
        else:
            q = self.expr(p)
        if q != end:
            raise Bad("condition")

    def for_header(self, p: int, end: int) -> None:
        k, java = self.k, self.java
        p += 1
        while java and k[p] in ("final", "@"):
            p = p + 1 if k[p] == "final" else self.annotations(p)
        if k[p] != ";":
            q = self.try_type(p)
            if q > 0 and (k[q] == "i" or not java and k[q] == "[" and k[p] in ("auto", "const")):
                if java and k[q + 1] == ":":
                    if self.expr(q + 2) != end:
                        raise Bad("for")
                    return
                if not java:
                    r = self.m[q] + 1 if k[q] == "[" else q + 1
                    if k[r] == ":":
                        if (self.braces(r + 1) if k[r + 1] == "{" else self.expr(r + 1)) != end:
                            raise Bad("for")
                        return
                p = self.java_declarators(q) if java else self.cpp_declarators(q)
                if not java and k[p] == ";" and k[p + 1] not in (";",) and self.for_range_after(p + 1, end):
                    return
            else:
                p = self.expr_list(p)
        p = self.need(p, ";")
        if k[p] != ";":
            p = self.expr(p, not java)
        p = self.need(p, ";")
        if p != end:
            p = self.expr_list(p)
        if p != end:
            raise Bad("for")

    def for_range_after(self, p: int, end: int) -> bool:
        q = self.try_type(p)
        if q > 0 and self.k[q] == "i" and self.k[q + 1] == ":":
            if self.expr(q + 2) != end:
                raise Bad("for")
            return True
        return False

    def expr_list(self, p: int) -> int:
        if not self.java:
            return self.expr(p, True)
        while True:
            p = self.expr_statement(p)
            if self.k[p] != ",":
                return p
            p += 1

    def expr_statement(self, p: int) -> int:
        """Java allows only assignments, steps, calls and creations as statements."""
        q = self.expr(p, not self.java)
        if not self.java:
            return q
        k, at, assign, binary = self.k, p, False, False
        compared = False
        while at < q:
            t = k[at]
            if t in ("(", "[", "{"):
                at = self.m[at]
            elif t == "<" and k[at - 1] == ".":
                at = self.targs(at) - 1
            elif t in _ASSIGN or t == "=g" and k[at - 1] == ">g":
                if binary or compared:
                    raise Bad("not a variable")
                assign = True
                break
            elif t == ">" and k[at + 1] == ">g":
                binary = binary or k[at + 2] != "=g" and (k[at + 2] != ">g" or k[at + 3] != "=g")
            elif t in ("<", ">"):
                compared = True
            elif t in _BINARY or t in ("?", "instanceof"):
                binary = True
            at += 1
        if assign or k[p] in ("++", "--") or k[q - 1] in ("++", "--") or k[p] == "switch":
            return q
        if binary or k[q - 1] not in (")", "}") or k[p] in ("!", "-", "+", "~") or k[p] == "(" and self.m[p] == q - 1:
            raise Bad("not a statement")
        return q

    def statement(self, p: int) -> int:
        k = self.k
        t = k[p]
        if t == "{":
            return self.block(p)
        if t == ";":
            return p + 1
        f = self.STATEMENTS.get(t)
        if f is not None:
            return f(self, p)
        # simple statement: remembered by its kinds
        try:
            end = k.index(";", p)
        except ValueError:
            raise Bad("; expected") from None
        words = k[p:end + 1]
        if "{" in words or "}" in words or t in ("class", "struct", "enum", "union", "interface", "abstract", "@"):
            return self.simple(p)
        key = (self.java, " ".join(words))
        if key not in _SEEN:
            if self.simple(p) != end + 1:
                raise Bad("statement")
            remember(key)
        return end + 1

    def simple(self, p: int) -> int:
        k, java = self.k, self.java
        t = k[p]
        if java:
            while k[p] in ("final", "@", "abstract", "static"):
                p = self.annotations(p) if k[p] == "@" and k[p + 1] == "i" else p + 1
            if k[p] in ("class", "interface", "enum"):
                return self.java_type(p)
            if k[p] == "i" and k[p + 1] == "i" and k[p + 2] in ("(", "<") and self.record_at(p):
                return self.java_type(p)
            if k[p] == "i" and k[p + 1] == ":":
                return self.statement(p + 2)
            q = self.try_type(p)
            if q > 0 and k[q] == "i":
                return self.need(self.java_declarators(q), ";")
            return self.need(self.expr_statement(p), ";")
        if t in ("class", "struct", "union", "enum") and self.defines(p):
            return self.cpp_class(p)
        if t == "using" or t == "namespace":
            return self.cpp_declaration(p)
        if t == "typedef":
            return self.need(self.cpp_declarators(self.type(p)), ";")
        if t == "static_assert":
            return self.need(self.args(p + 1), ";")
        if t == "i" and k[p + 1] == ":" and k[p + 2] != ":":
            return self.statement(p + 2)
        q = self.try_type(p)
        if q > 0 and (k[q] == "i" or k[q] == "[" and k[q - 1] in ("auto", "&", "&&") or k[q] == "(" and k[q + 1] in ("*", "&")):
            try:
                return self.need(self.cpp_declarators(q), ";")
            except Bad:
                if k[p] != "i":
                    raise
        return self.need(self.expr(p, True), ";")

    def record_at(self, p: int) -> bool:
        q = p + 2
        if self.k[q] == "<":
            q = self.targs(q)
        if q < 0 or self.k[q] != "(":
            return False
        after = self.m[q] + 1
        return self.k[after] in ("{", "implements")

    def defines(self, p: int) -> bool:
        """Whether class-like keyword at p opens a definition or forward declaration."""
        q = p + 1
        while self.k[q] in ("class", "struct", "i", "::", ",", ":", "public", "private", "protected", "virtual", "<", ">", "int", "long", "char", "short", "unsigned"):
            q += 1
        return self.k[q] == "{" or self.k[p + 2] == ";"

    def s_if(self, p: int) -> int:
        k = self.k
        p += 1
        if not self.java and k[p] == "constexpr":
            p += 1
        p = self.statement(self.header(p))
        return self.statement(p + 1) if k[p] == "else" else p

    def s_for(self, p: int) -> int:
        return self.statement(self.header(p + 1, self.for_header))

    def s_while(self, p: int) -> int:
        return self.statement(self.header(p + 1))

    def s_do(self, p: int) -> int:
        p = self.statement(p + 1)
        return self.need(self.header(self.need(p, "while")), ";")

    def s_switch(self, p: int) -> int:
        q = self.switch_body(self.header(p + 1))
        return q

    def switch_body(self, p: int) -> int:
        k = self.k
        end = self.m[self.need(p, "{") - 1]
        p += 1
        while p < end:
            if k[p] == "case":
                p += 1
                while True:
                    if k[p] == "default":
                        p += 1
                    elif k[p] == "i" and k[p + 1] in ("->", ":", ","):
                        p += 1
                    elif self.java and self.try_type(p) > 0 and k[self.try_type(p)] == "i":
                        p = self.try_type(p) + 1
                        if k[p] == "i":
                            p = self.expr(p + 1)
                    else:
                        p = self.ternary_free(p)
                    if k[p] != ",":
                        break
                    p += 1
                p = self.label_end(p)
            elif k[p] == "default" and k[p + 1] in (":", "->"):
                p = self.label_end(p + 1)
            else:
                p = self.statement(p)
        if p != end:
            raise Bad("switch")
        return end + 1

    def ternary_free(self, p: int) -> int:
        return self.expr(p)

    def label_end(self, p: int) -> int:
        k = self.k
        if k[p] == "->" and self.java:
            p += 1
            if k[p] == "{":
                return self.block(p)
            if k[p] == "throw":
                return self.statement(p)
            return self.need(self.expr(p), ";")
        return self.need(p, ":")

    def s_return(self, p: int) -> int:
        k = self.k
        p += 1
        if k[p] == ";":
            return p + 1
        if k[p] == "{" and not self.java:
            return self.need(self.braces(p), ";")
        try:
            end = k.index(";", p)
        except ValueError:
            raise Bad("; expected") from None
        words = k[p:end + 1]
        if "{" in words:
            return self.need(self.expr(p, not self.java), ";")
        key = (self.java, "return " + " ".join(words))
        if key not in _SEEN:
            if self.need(self.expr(p, not self.java), ";") != end + 1:
                raise Bad("return")
            remember(key)
        return end + 1

    def s_jump(self, p: int) -> int:
        k = self.k
        p += 1
        if self.java and k[p] == "i":
            p += 1
        return self.need(p, ";")

    def s_goto(self, p: int) -> int:
        return self.need(self.need(p + 1, "i"), ";")

    def s_throw(self, p: int) -> int:
        if not self.java and self.k[p + 1] == ";":
            return p + 2
        return self.need(self.expr(p + 1), ";")

    def s_try(self, p: int) -> int:
        k = self.k
        p += 1
        resources = False
        if self.java and k[p] == "(":
            end = self.m[p]
            q = p + 1
            while q < end:
                if k[q] == "final":
                    q += 1
                r = self.try_type(q)
                q = self.java_declarators(r) if r > 0 and k[r] == "i" else self.expr(q)
                if q < end:
                    q = self.need(q, ";")
            resources, p = True, end + 1
        p = self.block(p)
        n = 0
        while k[p] == "catch":
            end = self.m[self.need(p + 1, "(") - 1]
            q = p + 2
            if self.java:
                while k[q] == "final":
                    q += 1
                q = self.type(q)
                while k[q] == "|":
                    q = self.type(q + 1)
                q = self.need(q, "i")
            elif k[q] == "...":
                q += 1
            else:
                q = self.type(q)
                if k[q] == "i":
                    q += 1
            if q != end:
                raise Bad("catch")
            p, n = self.block(end + 1), n + 1
        if self.java and k[p] == "finally":
            p, n = self.block(p + 1), n + 1
        if not n and not resources:
            raise Bad("try")
        return p

    def s_synchronized(self, p: int) -> int:
        return self.block(self.header(p + 1))

    def s_assert(self, p: int) -> int:
        p = self.expr(p + 1)
        if self.k[p] == ":":
            p = self.expr(p + 1)
        return self.need(p, ";")

    def s_yield(self, p: int) -> int:
        if self.k[p + 1] in ("=", ".", "[", "++", "--") or self.k[p + 1] in _ASSIGN:
            self.k[p] = "i"
            return self.simple(p)
        return self.need(self.expr(p + 1), ";")

    def s_bad(self, p: int) -> int:
        raise Bad("statement")

    STATEMENTS = {
        "if": s_if, "for": s_for, "while": s_while, "do": s_do, "switch": s_switch, "return": s_return, "break": s_jump,
        "continue": s_jump, "goto": s_goto, "throw": s_throw, "try": s_try, "else": s_bad, "catch": s_bad, "eof": s_bad,
    }

    # ---- Java declarations ----
    def java_unit(self) -> None:
        k, p = self.k, 0
        q = self.annotations(p)
        if k[q] == "package":
            p = self.need(self.dotted(q + 1), ";")
        while k[p] in ("import", ";"):
            if k[p] == ";":
                p += 1
                continue
            p += 1
            if k[p] == "static":
                p += 1
            p = self.dotted(p)
            if k[p] == "." and k[p + 1] == "*":
                p += 2
            p = self.need(p, ";")
        while k[p] != "eof":
            p = p + 1 if k[p] == ";" else self.java_type(self.modifiers(p))

    def dotted(self, p: int) -> int:
        p = self.need(p, "i")
        while self.k[p] == "." and self.k[p + 1] == "i":
            p += 2
        return p

    def modifiers(self, p: int) -> int:
        k, seen = self.k, set()
        while True:
            if k[p] in _JAVA_MODIFIER and not (k[p] == "default" and k[p + 1] in (":", "->")):
                if k[p] in seen:
                    raise Bad("repeated modifier")
                seen.add(k[p])
                p += 1
            elif k[p] == "@" and k[p + 1] == "i":
                p = self.annotations(p)
            elif k[p] == "i" and k[p + 1] in ("class", "interface", "public", "abstract", "static") or k[p] == "i" and k[p + 1] == "-":
                p += 1 if k[p + 1] != "-" else 3  # sealed, non-sealed
            else:
                return p

    def java_type(self, p: int) -> int:
        k = self.k
        if k[p] == "@" and k[p + 1] == "interface":
            p += 1
        kind, own = k[p], self.names.get(p + 1)
        if kind in ("class", "interface", "enum"):
            p = self.need(p + 1, "i")
        elif kind == "i" and k[p + 1] == "i":  # record
            p = self.need(p + 1, "i")
            kind = "record"
        else:
            raise Bad("type declaration")
        p = self.targs(p)
        if p < 0:
            raise Bad("type parameters")
        if kind == "record":
            p = self.java_params(self.need(p, "(") - 1)
        while k[p] in ("extends", "implements") or k[p] == "i":
            p = self.type(p + 1)
            while k[p] == ",":
                p = self.type(p + 1)
        return self.class_body(p, kind == "enum", own)

    def class_body(self, p: int, enum: bool = False, own: str | None = None) -> int:
        k = self.k
        end = self.m[self.need(p, "{") - 1]
        p += 1
        if enum:
            while k[p] in ("i", "@"):
                p = self.need(self.annotations(p), "i")
                if k[p] == "(":
                    p = self.args(p)
                if k[p] == "{":
                    p = self.class_body(p)
                if k[p] != ",":
                    break
                p += 1
            if p == end:
                return end + 1
            p = self.need(p, ";")
        while p < end:
            p = self.java_member(p, own)
        if p != end:
            raise Bad("class body")
        return end + 1

    def java_member(self, p: int, own: str | None) -> int:
        k = self.k
        if k[p] == ";":
            return p + 1
        if k[p] == "{" or k[p] == "static" and k[p + 1] == "{":
            return self.block(p + (k[p] == "static"))
        p = self.modifiers(p)
        if k[p] in ("class", "interface", "enum") or k[p] == "@" or k[p] == "i" and k[p + 1] == "i" and k[p + 2] in ("(", "<") and self.record_at(p):
            return self.java_type(p)
        if k[p] == "<":
            p = self.targs(p)
            if p < 0:
                raise Bad("type parameters")
        if k[p] == "i" and k[p + 1] in ("(", "{") and self.names.get(p) != own:
            raise Bad("return type")
        if k[p] == "i" and k[p + 1] == "(":  # constructor
            return self.block(self.throws(self.java_params(p + 1)))
        if k[p] == "i" and k[p + 1] == "{":  # compact constructor
            return self.block(p + 1)
        p = self.type(p)
        if k[p] == "i" and k[p + 1] == "(":
            p = self.java_params(p + 1)
            while k[p] == "[" and k[p + 1] == "]":
                p += 2
            p = self.throws(p)
            if k[p] == "default":
                p = self.braces(p + 1) if k[p + 1] == "{" else self.expr(p + 1)
            return self.block(p) if k[p] == "{" else self.need(p, ";")
        return self.need(self.java_declarators(p), ";")

    def throws(self, p: int) -> int:
        if self.k[p] == "throws":
            p = self.type(p + 1)
            while self.k[p] == ",":
                p = self.type(p + 1)
        return p

    # ---- C++ declarations ----
    def cpp_unit(self) -> None:
        p = 0
        while self.k[p] != "eof":
            p = self.cpp_declaration(p)

    def angle(self, p: int) -> int:
        """Position after the template parameter list at p."""
        k, depth = self.k, 0
        while k[p] != "eof":
            if k[p] in ("(", "[", "{"):
                p = self.m[p]
            elif k[p] == "<":
                depth += 1
            elif k[p] in _CLOSE:
                depth -= 1
                if not depth:
                    return p + 1
            elif k[p] in (";", ")", "}"):
                break
            p += 1
        raise Bad("template")

    def cpp_declaration(self, p: int, owner: bool = False) -> int:
        k = self.k
        while k[p] == "[" and k[p + 1] == "[":
            p = self.m[p] + 1
        t = k[p]
        if t == ";":
            return p + 1
        if t == "inline" and k[p + 1] == "namespace":
            p, t = p + 1, "namespace"
        if t == "namespace":
            p += 1
            while k[p] in ("i", "::"):
                p += 1
            if k[p] == "=":
                return self.need(self.type(p + 1), ";")
            end = self.m[self.need(p, "{") - 1]
            p += 1
            while p < end:
                p = self.cpp_declaration(p)
            if p != end:
                raise Bad("namespace")
            return end + 1
        if t == "using":
            if k[p + 1] == "namespace":
                p += 2
                if k[p] == "::":
                    p += 1
                p = self.need(p, "i")
                while k[p] == "::":
                    p = self.need(p + 1, "i")
                return self.need(p, ";")
            if k[p + 1] == "i" and k[p + 2] == "=":
                p = self.type(p + 3)
                if k[p] == "(":
                    p = self.cpp_params(p)
                return self.need(p, ";")
            p = self.type(p + 1)
            return self.need(p, ";")
        if t == "template":
            p = self.angle(self.need(p + 1, "<") - 1) if k[p + 1] == "<" else p + 1
            if k[p] == "requires":
                p = self.unary(p + 1)
            if k[p] == "concept":
                return self.need(self.expr(self.need(self.need(p + 1, "i"), "=")), ";")
            return self.cpp_declaration(p, owner)
        if t == "extern" and k[p + 1] == "l":
            if k[p + 2] != "{":
                return self.cpp_declaration(p + 2)
            end, p = self.m[p + 2], p + 3
            while p < end:
                p = self.cpp_declaration(p)
            return end + 1
        if t == "static_assert":
            return self.need(self.args(p + 1), ";")
        if t == "friend" and k[p + 1] in ("class", "struct"):
            return self.need(self.type(p + 2), ";")
        if t in ("class", "struct", "union", "enum") and self.defines(p):
            return self.cpp_class(p)
        if t == "typedef" and k[p + 1] in ("struct", "union", "enum", "class") and self.defines(p + 1):
            return self.cpp_class(p + 1)
        if owner and t in ("public", "private", "protected") and k[p + 1] == ":":
            return p + 2
        # constructor, destructor, conversion
        q = p
        while k[q] in ("explicit", "inline", "virtual", "constexpr", "static"):
            q += 1
        r = q
        while k[r] == "i" and k[r + 1] == "::":
            r += 2
        if k[r] == "~" and k[r + 1] == "i":
            return self.cpp_function(self.need(r + 2, "(") - 1)
        if k[r] == "operator" and (owner or r > q):
            return self.cpp_function(self.need(self.operator_name(r), "(") - 1)
        if k[q] == "i" and k[r] == "i" and k[r + 1] == "(" and (owner or r > q) and self.is_body(self.m[r + 1] + 1):
            return self.cpp_function(r + 1)
        p = self.type(p)
        if k[p] == ";" and t in ("class", "struct", "enum", "union"):
            return p + 1
        if k[p] == "operator" or k[p] == "i" and k[p + 1] == "::" and k[p + 2] == "operator":
            return self.cpp_function(self.need(self.operator_name(p if k[p] == "operator" else p + 2), "(") - 1)
        if k[p] == "i":
            q = self.targs(p + 1)
            while k[q] == "::" and k[q + 1] in ("i", "~", "operator"):
                q = self.targs(q + 2) if k[q + 1] != "operator" else self.operator_name(q + 1)
            if k[q] == "(" and (self.is_body(self.m[q] + 1) or self.params_at(q)):
                return self.cpp_function(q)
        return self.need(self.cpp_declarators(p), ";")

    def params_at(self, p: int) -> bool:
        try:
            self.cpp_params(p)
        except Bad:
            return False
        return self.k[self.m[p] + 1] != ","

    def is_body(self, p: int) -> bool:
        return self.k[p] in ("{", ":", "const", "noexcept", "->", "try") or self.is_virtual_mark(p)

    def is_virtual_mark(self, p: int) -> bool:
        return self.k[p] == "i" and self.names.get(p) in ("override", "final")

    def cpp_function(self, p: int) -> int:
        k = self.k
        p = self.cpp_params(p)
        while k[p] in ("const", "noexcept", "volatile", "&", "&&", "throw", "requires") or self.is_virtual_mark(p):
            p += 1
            if k[p] == "(":
                p = self.m[p] + 1
        if k[p] == "->":
            p = self.type(p + 1)
        if k[p] == "=":
            if k[p + 1] not in ("default", "delete", "l"):
                raise Bad("function")
            return self.need(p + 2, ";")
        if k[p] == ":":
            p += 1
            while True:
                p = self.type(p)
                if k[p] == "(":
                    p = self.args(p)
                elif k[p] == "{":
                    p = self.braces(p)
                else:
                    raise Bad("initialiser")
                if k[p] != ",":
                    break
                p += 1
        return self.block(p) if k[p] == "{" else self.need(p, ";")

    def cpp_class(self, p: int) -> int:
        k = self.k
        enum = k[p] == "enum"
        p += 1
        if enum and k[p] in ("class", "struct"):
            p += 1
        if k[p] == "i" or k[p] == "::":
            p = self.type(p)
        if k[p] == "i":  # final
            p += 1
        if k[p] == ";":
            return p + 1
        if k[p] == ":":
            p += 1
            while True:
                while k[p] in ("public", "private", "protected", "virtual"):
                    p += 1
                p = self.type(p)
                if k[p] != ",":
                    break
                p += 1
        end = self.m[self.need(p, "{") - 1]
        p += 1
        if enum:
            while p < end:
                p = self.need(p, "i")
                if k[p] == "=":
                    p = self.expr(p + 1)
                if p < end:
                    p = self.need(p, ",")
        else:
            while p < end:
                p = self.cpp_declaration(p, owner=True)
        if p != end:
            raise Bad("class body")
        p = end + 1
        return p + 1 if k[p] == ";" else self.need(self.cpp_declarators(p), ";")


Parser.JAVA_STATEMENTS = Parser.STATEMENTS | {"synchronized": Parser.s_synchronized, "assert": Parser.s_assert, "yield": Parser.s_yield}


class JavaParser(Parser):
    STATEMENTS = Parser.JAVA_STATEMENTS


def remember(key: tuple[bool, str]) -> None:
    if len(_SEEN) >= _SEEN_LIMIT:
        _SEEN.clear()
    _SEEN[key] = True


def parses(text: str, java: bool) -> bool:
    try:
        names: dict[int, str] = {}
        kinds = lex(text, java, names)
        kinds += ["eof"] * 4
        if java:
            JavaParser(kinds, True, names).java_unit()
        else:
            Parser(kinds, False, names).cpp_unit()
    except (Bad, RecursionError, KeyError):
        return False
    return True
