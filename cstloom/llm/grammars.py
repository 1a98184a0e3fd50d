"""Lexical classes and productions of nine languages, for judging syntax.

A token is one letter.  n name, d number, s string, u prefix operator, o infix
operator, a assignment, x postfix operator, . member access, and a letter for
each group of keywords (see KEYWORDS).  What brackets enclose is judged on its
own and stands as p (), b [] or c {} in what encloses it, so that every
production is a regular expression.  ! is what the lexer can't read.
"""

from __future__ import annotations

import re
from functools import lru_cache

_COMMON = {"if": "I", "else": "L", "for": "R", "while": "W", "do": "O", "switch": "S", "case": "J", "default": "Q", "return": "T", "break": "B", "continue": "B", "true": "n", "false": "n"}
_TRY = {"try": "Y", "catch": "Z", "finally": "V", "throw": "T", "new": "u", "this": "n", "super": "n", "null": "n"}
_JS = _COMMON | _TRY | {"function": "F", "class": "C", "let": "D", "const": "D", "var": "D", "import": "A", "from": "f", "export": "M", "async": "M", "static": "m", "extends": "e", "typeof": "u", "void": "u", "delete": "u", "await": "u", "yield": "u", "instanceof": "o", "in": "o", "of": "o", "as": "o", "undefined": "n"}
#: The keywords of each language by group.
KEYWORDS: dict[str, dict[str, str]] = {
    "python": {"if": "I", "elif": "J", "else": "L", "for": "R", "while": "W", "def": "D", "class": "C", "return": "T", "raise": "T", "import": "A", "from": "f", "as": "g", "pass": "B", "break": "B", "continue": "B", "try": "Y", "except": "Z", "finally": "V", "with": "H", "global": "G", "nonlocal": "G", "del": "T", "assert": "T", "lambda": "l", "yield": "u", "await": "u", "not": "N", "and": "o", "or": "o", "is": "o", "in": "i", "async": "y", "True": "n", "False": "n", "None": "n"},
    "javascript": _JS,
    "typescript": _JS | {"interface": "C", "enum": "C", "namespace": "C", "type": "t", "public": "m", "private": "m", "protected": "m", "readonly": "m", "abstract": "M", "declare": "M", "implements": "e", "keyof": "u"},
    "java": _COMMON | _TRY | {"class": "C", "interface": "C", "enum": "C", "import": "A", "package": "P", "extends": "e", "implements": "e", "throws": "e", "instanceof": "i", "assert": "E", "yield": "T"} | dict.fromkeys("public private protected static final abstract synchronized native transient volatile strictfp".split(), "M"),
    "csharp": _COMMON | _TRY | {"foreach": "R", "using": "A", "class": "C", "struct": "C", "interface": "C", "enum": "C", "namespace": "C", "record": "C", "is": "o", "as": "o", "in": "o", "base": "n", "await": "u", "lock": "W"} | dict.fromkeys("public private protected internal static readonly sealed override virtual abstract async const partial extern unsafe ref out params".split(), "M"),
    "c": _COMMON | {"struct": "C", "union": "C", "enum": "C", "goto": "B", "sizeof": "u"} | dict.fromkeys("const static extern inline volatile register typedef restrict".split(), "M"),
    "cpp": _COMMON | _TRY | {"struct": "C", "union": "C", "enum": "C", "class": "C", "namespace": "C", "goto": "B", "sizeof": "u", "delete": "u", "using": "A", "template": "M", "public": "m", "private": "m", "protected": "m", "nullptr": "n"} | dict.fromkeys("const static extern inline volatile register typedef virtual explicit constexpr mutable friend override noexcept".split(), "M"),
    "go": {k: v for k, v in _COMMON.items() if k not in ("do", "while")} | {"package": "P", "import": "A", "func": "F", "type": "C", "struct": "k", "interface": "k", "map": "k", "chan": "k", "var": "D", "const": "D", "select": "S", "goto": "B", "fallthrough": "B", "go": "u", "defer": "u", "range": "r", "nil": "n"},
    "rust": {"if": "I", "else": "L", "for": "R", "while": "W", "loop": "O", "match": "S", "return": "T", "break": "B", "continue": "B", "fn": "F", "let": "D", "const": "D", "static": "D", "pub": "M", "unsafe": "M", "async": "M", "move": "M", "extern": "M", "use": "A", "mod": "C", "struct": "C", "enum": "C", "impl": "C", "trait": "C", "type": "C", "union": "C", "in": "o", "as": "o", "where": "h", "true": "n", "false": "n", "self": "n"},
}

_STRING = r'"(?:\\.|[^"\\\n])*"'
_QUOTED = r"'(?:\\.|[^'\\\n])*'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*\*/"
_NUMBER = r"\d(?:[\w.]|(?<=[eEpP])[+-](?=\d))*|\.\d[\w]*"
_OPERATORS = r"\.\.\.|\.\.=|\?\?=|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|//=|=>|->|::|:=|\+\+|--|<-|\.\.|\?\.|\?\?|\*\*|==|!=|<=|>=|&&|\|\||<<|>>|[+\-*/%&|^!~]=|[-+*/%&|^!~<>=.,;:?@#()\[\]{}]"
_NAME = r"[^\W\d]\w*"


def _lexer(*special: str) -> re.Pattern:
    """Groups: c what is skipped, l a line end, s strings, n names, d numbers, o operators, x anything else."""
    comments, strings = special
    marks = r"^(?:<<<<<<<|>>>>>>>|\|\|\|\|\|\|\|)(?!\S*=)[^\n]*|^@@ [^\n]*"
    return re.compile(rf"(?P<x>{marks})|(?P<c>[ \t\f\r]+|{comments})|(?P<l>\n)|(?P<s>{strings})|(?P<n>{_NAME})|(?P<d>{_NUMBER})|(?P<o>{_OPERATORS})|(?P<y>.)", re.S | re.M)


_C_COMMENT = rf"{_LINE}|{_BLOCK}"
_DIRECTIVE = r"^[ \t]*\#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|undef|pragma|error|warning|line|region|endregion|nullable)\b(?:\\\r?\n|[^\n])*"
LEXERS = {
    "python": _lexer(r"\#[^\n]*|\\\r?\n", rf"""(?i:[rbuf]{{0,2}})(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|{_STRING}|{_QUOTED})"""),
    "javascript": _lexer(rf"{_C_COMMENT}|\A\#![^\n]*", rf"{_STRING}|{_QUOTED}|`(?:\\.|[^`\\])*`"),
    "typescript": _lexer(rf"{_C_COMMENT}|\A\#![^\n]*|(?<=\w)<[A-Za-z_][\w., <>\[\]|&?:\"']*>(?=[\s({{\[,;)>=|&]|$)|@{_NAME}", rf"{_STRING}|{_QUOTED}|`(?:\\.|[^`\\])*`"),
    "java": _lexer(rf"{_C_COMMENT}|(?<=\w)<(?:[A-Za-z_?][\w., <>\[\]?&]*)?>|@(?!interface\b){_NAME}(?:\.{_NAME})*(?![\w.]|\s*\()", rf'"""(?:\\.|[^\\])*?"""|{_STRING}|{_QUOTED}'),
    "csharp": _lexer(rf"{_C_COMMENT}|{_DIRECTIVE}|(?<=\w)<[A-Za-z_][\w., <>\[\]?]*>(?=[\s(\[,;)>{{.]|$)", rf'[$@]{{1,2}}"(?:""|[^"])*"|"""(?:[^"]|"(?!""))*"""|{_STRING}|{_QUOTED}'),
    "c": _lexer(rf"{_C_COMMENT}|{_DIRECTIVE}", rf"(?:L|u8?|U)?(?:{_STRING}|{_QUOTED})"),
    "cpp": _lexer(rf"{_C_COMMENT}|{_DIRECTIVE}|(?<=\w)<[A-Za-z_][\w.:, <>\[\]*&]*>(?=[\s(\[,;)>{{:*&]|$)|\btemplate\s*<[^;{{]*?>(?=\s*(?:class|struct|\w))", rf'R"\((?:[^)]|\)(?!"))*\)"|(?:L|u8?|U)?(?:{_STRING}|{_QUOTED})'),
    "go": _lexer(_C_COMMENT, rf"{_STRING}|{_QUOTED}|`[^`]*`"),
    "rust": _lexer(rf"{_C_COMMENT}|\#!?\[[^\]\n]*\]|\b(?:mut|dyn|ref)\b|'[a-z_]\w*(?!')|(?<=[\w:])<[A-Za-z_&'][\w:, <>\[\]&']*>(?=[\s(\[,;)>{{:]|$)", rf'b?r"[^"]*"|b?r\#"(?:[^"]|"(?!\#))*"\#|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.|[^\'\\\n])\''),
}

_PREFIX_OR_INFIX = set("+ - * & ~ ! ** ... <- ++ -- .. ..= | || ^ <".split())
_ENDS = set("ndsxpbc")  # what an operand can end with


def operator(text: str, before: str, language: str) -> str:
    """The class of an operator after a token of class before ('' at a start)."""
    if text in "()[]{},;:?@#" and len(text) == 1:
        return text
    ends = before in _ENDS
    if text == "::":
        return "." if ends else "u"
    if text in (".", "?.") or text == "->" and language in ("c", "cpp"):
        return "."
    if text in ("++", "--"):
        return "x" if ends else "u"
    if text == "=>":
        return "w" if language == "rust" else "o"
    if text == "->":
        return ">" if language in ("rust", "python") else "o"
    if text in (":=", "=") or text[-1] == "=" and text not in ("==", "!=", "<=", ">=", "===", "!==", "..="):
        return "a"
    if text == "!" and language == "rust" and before == "n":
        return ""  # a macro's name
    if text in ("!", "~", "..."):
        return "u"
    if not ends and text in _PREFIX_OR_INFIX:
        return "u"
    return "k" if language == "c" and text in ("*", "**") else "o"


def _expression(atoms: str, suffix: str, cast: bool = False, between: str = "o") -> str:
    unit = rf"(?:(?:u|p(?=[ndspuF]))*(?:{atoms})(?:{suffix})*)" if cast else rf"(?:u*(?:{atoms})(?:{suffix})*)"
    infix = rf"{unit}(?:{between}{unit})*"
    whole = rf"{infix}(?:\?{infix}:{infix})*"
    return rf"(?:{whole}(?:a{whole})*)"


class Grammar:
    """Productions by context: top and block hold statements one after another, p, b and c what brackets enclose."""

    def __init__(self, top: list[str], block: list[str], p: list[str], b: list[str], c: list[str]):
        self.sources = {"top": top, "block": block, "p": p, "b": b, "c": c}
        self.rules = {k: re.compile("|".join(f"(?:{x})" for x in v)) for k, v in self.sources.items()}

    @lru_cache(1 << 16)  # noqa: B019
    def allows(self, context: str, shape: str) -> bool:
        return bool(self.rules[context].fullmatch(shape))


def _list(e: str) -> str:
    return rf"(?:{e}(?:,{e})*,?)?"


def _javascript(typed: bool) -> Grammar:
    one = r"(?:u*(?:n|s|d|c|p(?:on)?|b)(?:\.n|b)*)"
    kind = rf"{one}(?:o{one})*"
    note = rf"(?:\??:{kind})?" if typed else ""
    e = _expression(rf"n|f|d|s|p|b|c|M?Fo?u?n?p{note}c|Cn?(?:en(?:\.n|p)*)?c", r"\.[nfABCDIJLMQRSTYZVWOmetu]|p|b|x|s")
    many = rf"{e}(?:,{e})*"
    name = rf"(?:n|f|c|b){note}"
    let = rf"D{name}(?:a{e})?(?:,{name}(?:a{e})?)*"
    class_ = r"M*Cn(?:e(?:n(?:\.n)*p?)(?:,n(?:\.n)*)*)*c"
    simple = [r"c", r";", rf"{let};?", rf"T(?:{many})?;?", r"Bn?;?", rf"{many};?", rf"M*Fo?u?np{note}c;?", rf"{class_};?"]
    lead = rf"(?:L?Ip|L|Rp|Wp|Sp|O|n:|J{e}:|Q:)*"
    block = [rf"{lead}(?:{'|'.join(simple)})", r"Yc", r"Zp?c", r"Vc", r"O?cWp;?", r"Spc", lead[:-1] + "+"]
    member = rf"(?:m|M)*u?(?:[nsdf]|b|Q|T|R|Z|I)(?:n)?p{note}(?:c|;)" if typed else r"(?:m|M)*u?(?:[nsdf]|b|Q|T|R|Z|I)n?pc"
    block += [member, rf"(?:m|M)*(?:n|s|b){note}(?:a{e})?;?"]
    top = block + [r"A(?:[ncuo,fQ]*f)?s;?", rf"MQ?(?:{many}|{let}|M?Fn?p{note}c|Cn?(?:en)?c|c(?:fs)?|u(?:on)?fs);?", r"MQC.*|MQM?F.*"]
    if typed:
        top += [rf"M*tna(?:o)?{kind};?"]
        block += [rf"M*tna(?:o)?{kind};?"]
    parameter = rf"(?:m*u?(?:n|f|c|b){note}(?:a{e})?)"
    p = [_list(e), rf"(?:{let}|{many})?;(?:{many})?;(?:{many})?", rf"D?(?:n|c|b)o{e}", many]
    if typed:
        p += [rf"(?:{parameter}(?:,{parameter})*,?)?", kind]
    prop = rf"(?:(?:[nsdfABCDIJLMQRSTYZVWOmet]|b)(?::{e})?|u{e}|M?u?(?:[nsf]|b)n?pc|{e})"
    b = [rf",*(?:{e},+)*(?:{e})?"] + ([kind, rf"n:{kind}"] if typed else [])
    c = [rf"(?:{prop}(?:,{prop})*,?)?", r"(?:[nQf](?:on)?)(?:,[nQf](?:on)?)*,?"]
    if typed:
        c += [rf"(?:m*(?:n|s|b)(?:p?\??:{kind})?[;,])*(?:m*(?:n|s|b)(?:p?\??:{kind})?)?", rf"(?:n(?:a{e})?,?)*"]
    return Grammar(top, block, p, b, c)


def _java() -> Grammar:
    e = _expression(r"n|d|s|p|c|Spc", r"\.(?:n|C|u)|p|b|x|c|iM?n(?:\.n)*b*(?:p?n|p)?", cast=True)
    many = rf"{e}(?:,{e})*"
    kind = r"n(?:\.n)*b*"
    marks = r"(?:@n(?:\.n)*p|M)*"
    declare = rf"{marks}{kind}nb*(?:a{e})?(?:,nb*(?:a{e})?)*"
    simple = [r"c", r";", rf"{declare};", rf"T(?:{e})?;", r"Bn?;", rf"E{e}(?::{e})?;", rf"{many};"]
    lead = rf"(?:L?Ip|L|M?Rp|Wp|O|n:|J(?:{kind}n|{many}):|Q:)*"
    generic = rf"(?:un(?:e{kind}(?:o{kind})*)?(?:,n(?:e{kind}(?:o{kind})*)?)*o)?"
    throws = rf"(?:e{kind}(?:,{kind})*)?"
    class_ = rf"{marks}@?Cnp?(?:e{kind}(?:,{kind})*)*c"
    block = [rf"{lead}(?:{'|'.join(simple)})", rf"{lead}Yp?c", r"Zp?c", r"Vc", r"O?cWp;", r"Wp;", rf"{lead}Spc", r"Mp?c", r"np?c", rf"(?:J(?:{kind}n|{many})|Q)o(?:T?{e};|c)"]
    block += [rf"{marks}Q?{marks}{generic}{kind}np(?:b*{throws}|Q{e})(?:c|;)", rf"{marks}{generic}np{throws}c", class_, class_ + ";"]
    top = [r"(?:@n(?:\.n)*p)*Pn(?:\.n)*;", r"AM?n(?:\.[nu])*;", class_, r";"]
    parameter = rf"{marks}{kind}(?:u|o)?nb*"
    p = [_list(e), rf"(?:{parameter}(?:,{parameter})*)?", rf"(?:{declare}|{many})?;(?:{e})?;(?:{many})?", rf"{marks}{kind}n:{e}", rf"M*{kind}(?:o{kind})*n?", rf"{declare}(?:;{declare})*;?"]
    b = [_list(e), r",*"]
    c = [_list(e), rf"{ENUM_CONSTANTS};?"]
    return Grammar(top, block, p, b, c)


#: What an enum of Java begins with; a semicolon and members may follow.
ENUM_CONSTANTS = r"(?:@n(?:\.n)*p)*np?c?(?:,(?:@n(?:\.n)*p)*np?c?)*,?"


def _csharp() -> Grammar:
    e = _expression(r"n|d|s|p|c|b", r"\.(?:n|C|u)|p|b|x|c", cast=True)
    many = rf"{e}(?:,{e})*"
    kind = r"n(?:\.n)*(?:b|\?)*"
    declare = rf"M*{kind}nb*(?:a{e})?(?:,nb*(?:a{e})?)*"
    simple = [r"c", r";", rf"{declare};", rf"T(?:{e})?;", r"Bn?;", rf"{many};"]
    lead = rf"(?:L?Ip|L|M?Rp|Wp|O|n:|J(?:{kind}n|{e}):|Q:)*"
    block = [rf"{lead}(?:{'|'.join(simple)})", r"Yp?c", r"Zp?c", r"Vc", r"O?cWp;", r"Wp;", r"Spc", r"Apc", rf"M*{kind}np(?:e{kind}(?:,{kind})*)?(?:c|;)", r"M*u?np(?::np)?c", rf"M*u?np(?:e{kind}(?:,{kind})*)?c"]
    class_ = rf"b*M*Cn(?::{kind}(?:,{kind})*)?[c;]"
    block += [class_, class_ + ";"]
    block += [rf"b*M*{kind}nc(?:a{e};)?", rf"M*{kind}no{e};", rf"b*M*{kind}npc", rf"M*A?{declare};", r"M*n;", rf"M*{kind}npo{e};"]
    top = [r"M*AM?(?:na)?n(?:\.n)*;", r"Cn(?:\.n)*[c;]", class_, r";", r"b"]
    parameter = rf"b?M*{kind}(?:u|o)?nb*(?:a{e})?"
    p = [_list(e), rf"(?:{parameter}(?:,{parameter})*)?", rf"(?:{declare}|{many})?;(?:{e})?;(?:{many})?", rf"M*{kind}no{e}", rf"M*{kind}(?:o{kind})*n?", declare, rf"(?:M?{e},?)*", rf"{declare}(?:;{declare})*;?"]
    b = [_list(e), r",*", r"n(?:\.n)*p?(?:,n(?:\.n)*p?)*"]
    c = [_list(e), r"n(?:a[^;]*)?(?:,n(?:a[^;]*)?)*,?", rf"(?:b?a?{e}(?:a{e})?,?)*"]
    return Grammar(top, block, p, b, c)


def _c_like(language: str) -> Grammar:
    plus = language == "cpp"
    e = _expression(r"n|d|s+|p|c|bp?c" if plus else r"n|d|s+|p|c", r"\.(?:u?n|b)|p|b|x|c" if plus else r"\.n|p|b|x", cast=True, between="o" if plus else "[ok]")
    many = rf"{e}(?:,{e})*"
    kind = rf"M*(?:C?n(?:\.n)*)(?:M|n(?:\.n)*)*"
    star = r"(?:[ou]|M)*" if plus else r"(?:[ku]M?)*"  # in C an infix star is a class of its own, as & makes no parameter
    value = rf"(?:a{e}|c|p)?" if plus else rf"(?:a{e})?"
    declare = rf"{kind}{star}(?:n(?:\.n)*|p)(?:b|p)*(?::d)?{value}(?:,{star}n(?:b)*{value})*"
    simple = [r"c", r";", rf"{declare};", rf"T(?:{e})?;", r"Bn?;", rf"{many};"]
    lead = rf"(?:L?Ip|L|Rp|Wp|O|n:|m:|J{e}:|Q:)*"
    function = rf"(?:{kind}{star})?u?n(?:\.u?n)*p(?:M|>)*(?::n(?:p|c)(?:,n(?:p|c))*)?(?:c|;)" if plus else rf"{kind}{star}np(?:c|;)"
    class_ = r"M*CC?n?(?:\.n)*(?::m?n(?:\.n)*(?:,m?n(?:\.n)*)*)?(?:c[ou]*n?b*(?:,n)*(?:ac)?)?;?"
    block = [rf"{lead}(?:{'|'.join(simple)})", r"Yc", r"Zpc", r"O?cWp;", r"Spc", class_, r"m:"]
    if plus:
        block += [rf"(?:m:)?{function}", r"AC?n(?:\.n)*(?:a.*)?;"]
    top = [rf"{declare};", function, class_, r";", r"MMsc|Msc|Ms.*", rf"{e};"] + ([r"AC?n(?:\.n)*(?:a.*)?;", r"M.*"] if plus else [])
    parameter = rf"(?:{kind}{star}n?(?:b|p)*{rf'(?:a{e})?'}|{kind}{star}p(?:b|p)*|u)"
    p = [_list(e), rf"(?:{parameter}(?:,{parameter})*)?", rf"(?:{declare}|{many})?;(?:{many})?;(?:{many})?", rf"{kind}{star}"]
    if plus:
        p += [rf"{kind}{star}(?:n|b):{e}", declare, rf"{declare};{e}"]
    b = [_list(e)] + ([r"[ua](?:,u?n)*"] if plus else [])
    c = [_list(e), rf"(?:(?:\.n(?:b)*a)?{e},?)*", rf"n(?:a{e})?(?:,n(?:a{e})?)*,?"]
    return Grammar(top, block, p, b, c)


def _go() -> Grammar:
    kind = r"(?:(?:[ou]|b)*(?:n(?:\.n)?|kb?c|kb(?:[ou]|b)*n(?:\.n)?|kn|Fp(?:n|p)?|p))"
    e = _expression(rf"n|d|s|p|b+n(?:\.n)?|kb(?:[ou]|b)*n|kc|Fp(?:{kind}|p)?c|kn", r"\.(?:n|p|C)|\.pC|p|b|x|c")
    many = rf"{e}(?:,{e})*"
    assign = rf"(?:r?{many}(?:ar?{many})?)"
    simple = [r"c", r";", rf"{assign};?", rf"T(?:{many})?;?", r"Bn?;?", rf"D(?:n(?:,n)*(?:{kind})?(?:a{many})?|p);?", rf"C(?:na?{kind}|p);?"]
    control = [rf"(?:L?I(?:{assign}?;)?{e}c)+(?:Lc)?;?", rf"L?I(?:{assign}?;)?{e}c;?", r"Lc;?", rf"R(?:{assign}|(?:{assign})?;(?:{assign})?;(?:{assign})?)?c;?", rf"R(?:{many}a)?r{e}c;?", rf"S(?:{assign}?;)?(?:{assign})?c;?"]
    block = [rf"(?:n:|J{assign}:|Q:)*(?:{'|'.join(simple + control)})", rf"(?:J{many}:|Q:)+;?"]
    function = rf"Fp?np(?:{kind}|p)?c?;?"
    top = [r"Pn;?", r"A(?:n|\.|u)?s;?", r"Ap;?", function, rf"D(?:n(?:,n)*(?:{kind})?(?:a{many})?|p);?", rf"C(?:na?{kind}|p);?", r";"]
    parameter = rf"(?:n?u?{kind})"
    p = [rf"(?:{e}u?(?:,{e}u?)*,?)?;?", rf"(?:{parameter}(?:,{parameter})*,?)?", r"(?:(?:n|\.|u)?s;?)*", rf"(?:n(?:,n)*(?:{kind})?(?:a{many})?;?)*", kind, r"C", rf"(?:na?{kind};?)*", rf"u{kind}"]
    b = [_list(e), rf"(?:{e})?:(?:{e})?(?::{e})?", kind, r"u"]
    item = rf"(?:{e}(?::{e})?)"
    c = [rf"(?:{item}(?:,{item})*,?)?;?", rf"(?:(?:n(?:,n)*)?(?:{kind})s?;)*(?:(?:n(?:,n)*)?(?:{kind})s?)?", rf"(?:np(?:{kind}|p)?;?|n(?:\.n)?;?)*"]
    return Grammar(top, block, p, b, c)


def _rust() -> Grammar:
    kind = r"(?:u*(?:n(?:\.n)*|p|b)(?:>u*n(?:\.n)*)?(?:on(?:\.n)*)*)"
    branch = r"I"
    unit = r"n|d|s|p|b|c|M?Oc|M?ux?"
    e0 = _expression(unit, r"\.(?:n|d|u)|p|b|c|\?|x")
    flow = rf"(?:I(?:D{e0}a)?{e0}cL(?:I(?:D{e0}a)?{e0}cL)*c|S{e0}c|Mc|Oc)"
    e = rf"(?:(?:{e0}|{flow})(?:[oa](?:{e0}|{flow}))*)"
    many = rf"{e}(?:,{e})*"
    name = r"(?:u*(?:n(?:\.n)*(?:p|c)?|p|b))"
    let = rf"M*D{name}(?::{kind})?(?:a{e}(?:Lc)?)?;"
    function = rf"M*s?M*Fnp(?:>{kind})?(?:h[^;]*?)?(?:c|;)"
    item = [function, rf"M*p?C[un]n?(?:\.n)*(?:p?;|p?c|c;?)", rf"M*Cu*n(?:\.n)*(?:R{kind})?(?:h.*)?c", rf"M*Cna{kind};", r"M*p?A(?:n|u)?(?:\.?(?:n|c|[ou]))*(?:on)?;", let, rf"Mp{function}", rf"n(?:p|b|c);?"]
    simple = [r"c;?", r";", rf"T(?:{e})?;?", rf"B(?:{e})?;?", rf"{e};?", *item]
    control = [rf"(?:L?{branch}(?:D{name}a)?{e0}c)", r"Lc;?", rf"R{name}o{e}c", rf"W(?:D{name}a)?{e0}c", r"Oc", rf"S{e}c;?", rf"(?:D{name}(?::{kind})?a)?{flow};?", rf"{branch}(?:D{name}a)?{e0}c(?:L{branch}(?:D{name}a)?{e0}c)*(?:Lc)?;?", rf"(?:T|D{name}(?::{kind})?a)I.*"]
    block = simple + control
    parameter = rf"(?:u*n(?::{kind})?|{name}:{kind})"
    p = [_list(e), rf"(?:{parameter}(?:,{parameter})*,?)?", rf"(?:M?p?{kind}(?:,M?p?{kind})*,?)?", r"n|n:.*"]
    b = [_list(e), rf"{e};{e}", rf"{kind}(?:;{e})?"]
    field = rf"(?:M*p?n:{kind})"
    c = [rf"(?:(?:n(?::{e})?|u+{e})(?:,(?:n(?::{e})?|u+{e}))*,?)?", rf"(?:{field}(?:,{field})*,?)?", rf"(?:{name}(?:o(?:{name}|d|s))*(?:I{e})?w(?:{e}|{flow}|T{e}|c),?|(?:d|s)(?:o(?:d|s))*w{e},?)*", rf"(?:n(?:p|c)?(?:a{e})?,?)*", r"(?:n|u|n\.n|nc)(?:,(?:n|u|\.|c|on)+)*,?"]
    return Grammar(item + [r";"], block, p, b, c)


def _python() -> Grammar:
    atom = r"n|d|s+|p|b|c"
    unit = rf"(?:(?:u|N)*(?:{atom})(?:\.n|p|b)*)"
    infix = rf"{unit}(?:(?:o|i|Ni|oN|x){unit})*"
    plain = rf"(?:{infix}(?:I{infix}L{infix})*)"
    e = rf"(?:(?:l(?:u*n(?:a{plain})?(?:,u*n(?:a{plain})?)*)?:)*{plain}|u)"
    many = rf"{e}(?:,{e})*,?"
    path = r"\.*(?:n(?:\.n)*)?"
    simple = rf"(?:{many}(?:a{many})*|{e}:{e}(?:a{many})?|T(?:{many})?(?:f{e})?|B|Gn(?:,n)*|An(?:\.n)*(?:gn)?(?:,n(?:\.n)*(?:gn)?)*|f(?:\.|u)*(?:n(?:\.n)*)?A(?:p|u|n(?:gn)?(?:,n(?:gn)?)*))"
    tail = rf"(?:{simple}(?:;{simple})*;?)?"
    head = rf"(?:[IJW]{e}|L|Y|V|y?R{many.replace('|i', '').replace('i|', '')}i{many}|Zo?(?:{e}(?:gn|,n)?)?|y?H{e}(?:g{e})?(?:,{e}(?:g{e})?)*|y?Dnp(?:>{e})?|Cnp?)"
    line = [rf"{simple}(?:;{simple})*;?", rf"{head}:{tail}", rf"@{e}", ""]
    generator = rf"{e}(?:y?R{unit}(?:,{unit})*,?i{infix}(?:I{infix})*)+"
    parameter = rf"(?:u?n(?::{e})?(?:a{e})?|o|u)"
    argument = rf"(?:{e}(?:a{e})?|{generator})"
    p = [rf"(?:{argument}(?:,{argument})*,?)?", rf"(?:{parameter}(?:,{parameter})*,?)?", r"(?:n(?:gn)?)(?:,n(?:gn)?)*,?", rf"(?:{e}(?:g{e})?)(?:,{e}(?:g{e})?)*,?"]
    slice_ = rf"(?:(?:{e})?(?::(?:{e})?){{0,2}})"
    b = [rf"(?:{argument}(?:,{argument})*,?)?", rf"{slice_}(?:,{slice_})*,?"]
    c = [rf"(?:{e}(?:,{e})*,?)?", rf"(?:(?:{e}:{e}|u{e})(?:,(?:{e}:{e}|u{e}))*,?)?", generator, rf"{e}:{generator}"]
    return Grammar(line, line, p, b, c)


@lru_cache(16)
def grammar(language: str) -> Grammar:
    make = {"python": _python, "javascript": lambda: _javascript(False), "typescript": lambda: _javascript(True), "go": _go, "rust": _rust, "java": _java, "csharp": _csharp, "c": lambda: _c_like("c"), "cpp": lambda: _c_like("cpp")}
    return make[language]()


def _follow(tree) -> tuple[bool, set[str], set[str], set[tuple[str, str]], bool]:
    """Of a parsed regular expression: can it be empty, its first and last symbols, its adjacent pairs; '' stands for any symbol."""
    import re._constants as k

    empty, first, last, pairs = True, set(), set(), set()
    for op, arg in tree:
        if op is k.LITERAL:
            part = (False, {chr(arg)}, {chr(arg)}, set())
        elif op is k.IN:
            got: set[str] = set()
            for o, a in arg:
                got |= {chr(a)} if o is k.LITERAL else {chr(i) for i in range(a[0], a[1] + 1)} if o is k.RANGE else {""}
            if any(o is k.NEGATE for o, _ in arg):
                got = {""}
            part = (False, got, got, set())
        elif op in (k.ANY, k.NOT_LITERAL):
            part = (False, {""}, {""}, set())
        elif op is k.BRANCH:
            each = [_follow(t) for t in arg[1]]
            part = (any(x[0] for x in each), set().union(*(x[1] for x in each)), set().union(*(x[2] for x in each)), set().union(*(x[3] for x in each)))
        elif op is k.SUBPATTERN:
            part = _follow(arg[3])
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            low, high, inner = arg
            x = _follow(inner)
            part = (x[0] or low == 0, x[1], x[2], x[3] | ({(a, b) for a in x[2] for b in x[1]} if high > 1 else set()))
        else:  # look-arounds take no symbol
            continue
        pairs |= part[3] | {(a, b) for a in last for b in part[1]}
        first = first | part[1] if empty else first
        last = part[2] | last if part[0] else part[2]
        empty = empty and part[0]
    return empty, first, last, pairs


@lru_cache(16)
def permissible_pairs(language: str) -> frozenset[str]:
    """All pairs of symbols that the productions of a language put side by side; an asterisk stands for any symbol."""
    import re._parser as parser

    out: set[str] = set()
    g = grammar(language)
    for context, rules in g.sources.items():
        each = [_follow(parser.parse(rule)) for rule in rules]
        pairs = set().union(*(x[3] for x in each))
        if context == "block" or context == "top" and language != "python":  # statements follow one another
            pairs |= {(a, b) for x in each for a in x[2] for y in each for b in y[1]}
        out |= {(a or "*") + (b or "*") for a, b in pairs}
    return frozenset(out)
