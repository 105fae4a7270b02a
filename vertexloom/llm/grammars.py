"""Productions of the syntax check, for source languages with bracket groups.

Tokens become one-letter terminals. A bracket group is parsed before its surroundings and then stands
as one letter: P for (...), L for [...], and for {...} B (statements only), O (a literal or list of
fields only) or M (either). Right sides therefore hold no recursion and are written as regular
expressions over these letters; i, n, s are names, numbers and strings, ! is a token of no language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_SKIP = r"\s+|//[^\n]*|/\*[\s\S]*?\*/"
_NAME = r"[^\W\d]\w*"


@dataclass
class Grammar:
    token: str  # all tokens, in order of preference
    words: dict[str, str]  # token -> terminal; "" drops it
    stmt: str  # one statement, ";" included
    last: str  # a final statement without ";"
    fields: str  # what else a {...} group can hold
    paren: str
    square: str
    goes_on: str  # terminals that continue a statement after a {...} group
    folds: list[tuple[str, str]] = field(default_factory=list)  # rewriting of terminals before brackets
    late: list[tuple[str, str]] = field(default_factory=list)  # rewriting inside each group
    ternary: bool = False  # ":" needs its "?" in expressions
    newline: str = ""  # terminals after which a line end ends the statement

    def __post_init__(self) -> None:
        self.scan = re.compile(self.token).findall
        self.stmt_re, self.last_re = re.compile(self.stmt), re.compile(self.last)
        self.fields_re, self.paren_re, self.square_re = (re.compile(x) for x in (self.fields, self.paren, self.square))
        self.split = re.compile(rf"(?:[^;BOM]|[BOM](?=[{self.goes_on}]))*(?:;|[BOM]|$)").findall
        self.folds = [(re.compile(a), b) for a, b in self.folds]
        self.late = [(re.compile(a), b) for a, b in self.late]


def _words(**kinds: str) -> dict[str, str]:
    return {w: letter for letter, words in kinds.items() for w in words.split()}


def _signs(text: str) -> dict[str, str]:
    return dict(x.rsplit("~", 1) for x in text.split())


_BRACKETS = {b: b for b in "()[]{};,."}

# --- JavaScript and TypeScript -------------------------------------------------------------------
_JS_REGEX = r"(?<![\w$)\]}\s])\s*/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*|(?<=return)\s*/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"
_JS_TOKEN = (
    _JS_REGEX
    + "|"
    + _SKIP
    + r"|`(?:\\[\s\S]|[^`\\])*`|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'"
    + rf"|{_NUM}n?(?![\w$])|\#?[^\W\d][\w$]*|\$[\w$]*"
    + r"|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|\*\*|[\s\S]"
)
_JS_WORDS = (
    _words(K="if while switch catch for with", e="do try finally", E="else", R="return", T="throw", G="const", D="let var", F="function", C="class", X="extends", u="typeof void delete await new yield", b="in instanceof of", J="import", Y="export", f="from", A="as", k="case", d="default", Z="break continue", a="async static get set")
    | _signs("+~m -~m *~* ++~p --~p =~= +=~= -=~= *=~= /=~= %=~= &=~= |=~= ^=~= **=~= <<=~= >>=~= >>>=~= &&=~= ||=~= ??=~= ==~o ===~o !=~o !==~o <=~o >=~o &&~o ||~o ??~o /~o %~o &~o |~o ^~o **~o <~< >~> =>~w ?~q :~c ?.~$ ...~x !~u ~~u @~@")
    | _BRACKETS
)


def _javascript(ts: bool) -> Grammar:
    words = dict(_JS_WORDS)
    if ts:
        words |= _words(C="class interface enum namespace", X="extends implements", a="async static get set public private protected readonly abstract declare override type keyof", A="as satisfies is")
    ty = "(?:[insuabtFLPOMDCA.o<>wq]|x)+?" if ts else "(?!)"
    ann = f"(?:q?c{ty})?" if ts else ""
    w = "[iKeERTGDFCXubJYfAkdZa]"
    name = "[iafAb]"
    heads = f"(?:a?(?:P{ann}|i)w)"
    prim = f"(?:[nsiaPLOMfA]|a?F\\*?i?P{ann}[BM]|C{name}?(?:X{name}(?:\\.i)*P?(?:,i)*)*[BM]|JP?)"
    post = f"(?:\\.{w}|\\$[iPL]|[PLsp]{'|u(?=[.;,)PL=]|$)' if ts else ''})"
    cast = f"(?:A(?:G|{ty}))?" if ts else ""
    one = f"(?:(?:[mp]|u\\*?)*+(?:{heads}+[BM]|(?:{heads}+[um]*+)?{prim}{post}*{cast}))"
    e = f"(?:{one}(?:[om*<>=bqc]{one})*)"
    es = f"(?:{e}(?:,{e})*)"
    target = "(?:[iafA]|[OML])"
    decl = f"(?:D{target}{'u?' if ts else ''}{ann}(?:={e})?(?:,{target}{ann}(?:={e})?)*|G{target}{ann}={e}(?:,{target}{ann}={e})*{f'|aG{target}{ann}' if ts else ''})"
    func = f"(?:a?F\\*?{name}P{ann}[BM])"
    cls = f"(?:(?:@i(?:\\.i)*P?)*a*C{name}(?:X{name}(?:\\.i)*P?(?:,i(?:\\.i)*)*)*[BOM])"
    member = f"(?:(?:@i(?:\\.i)*P?)*[a*]*(?:{w}|[snL])(?:P{ann}[BM]|[uq]?{ann}(?:={e})?))"
    imports = f"(?:Ja?(?:(?:{name}|\\*A{name}|[OM])(?:,(?:{name}|\\*A{name}|[OM]))*f)?s|Y(?:\\*(?:A{w})?fs|a?[OM](?:fs)?|d{e}))"
    enum = f"(?:Y?[DG]?a*Ci[OM]|Y?ai={ty})" if ts else "(?!)"
    ctl = "(?:KP(?!E)|KuP(?!E)|[eE]|ic)*"
    end = f"(?:{es}|{decl}|Y{decl}|R{es}?|T{es}|Zi?|{imports}|{member})"
    stmt = f"(?:(?:k{e}c|dc)*{ctl}(?:;|K?[BM];?|[eE][BM];?|Yd?{func};?|{func};?|(?:Yd?)?{cls}|{enum};?|{member}|{end};)|(?:k{e}|d)c|(?:{ctl})e[BM]KP;)"
    param = f"(?:(?:@iP?)*a*x?{target}{ann}(?:={e})?)"
    loop = f"(?:(?:{decl}|{es})?;{es}?;{es}?|{decl}|(?:[DG]?{target})b{e})"
    prop = f"(?:(?:{w}|[snL])c{e}|{name}(?:={e})?|[a*]*(?:{w}|[snL])P{ann}[BM]|x{e})"
    spec = f"(?:a?{w}(?:A{w})?)"
    fields = f"(?:(?:{prop}(?:,{prop})*,?)?|{spec}(?:,{spec})*,?" + (f"|(?:a*(?:{w}|[sL])q?P?q?c{ty}[;,]?|a*(?:{w})P{ann}[;,]?)*" if ts else "") + ")"
    paren = f"(?:(?:x?{e}(?:,x?{e})*,?)?|{param}(?:,{param})*,?|{loop}" + (f"|{ty}" if ts else "") + ")"
    square = f"(?:(?:,|x?{e}(?=,|$))*" + (f"|{ty}(?:,{ty})*|ic{ty}" if ts else "") + ")"
    return Grammar(
        token=_JS_TOKEN, words=words, stmt=stmt, last=f"(?:(?:k{e}c|dc)*{ctl}{end})", fields=fields, paren=paren, square=square,
        goes_on=r".,;=omq$c*<>bfPLsA", late=[(r"i<(?:[insaLPOM.o<>u]|,(?=[insaLPOM]))+>(?=[PiOBM;,=cq>wX]|$)", "i")] * 2 if ts else [], ternary=not ts,
    )


# --- Rust -----------------------------------------------------------------------------------------
_RUST_TOKEN = (
    _SKIP
    + r"|[bc]?r\"[^\"]*\"|[bc]?r#\"[\s\S]*?\"#|[bc]?r##\"[\s\S]*?\"##|[bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\(?:u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.)|[^\\'\n])'|'[^\W\d]\w*"
    + rf"|(?:{_NUM})(?:_?[iuf](?:8|16|32|64|128|size))?(?!\w)|r#{_NAME}|{_NAME}"
    + r"|\.\.=|\.\.\.|<<=|>>=|->|=>|::|\.\.|==|!=|<=|>=|&&|\|\||[-+*/%&|^]=|[\s\S]"
)
_RUST_WORDS = (
    _words(K="if while match", e="else loop unsafe", R="return break continue", D="let", F="fn", T="struct enum union trait mod", I="impl", U="use extern", v="pub", u="mut ref move dyn", C="const static", Y="type", A="as", b="in", W="where", r="for", a="async")
    | _signs("+~m -~m *~m &~m |~| =~= +=~= -=~= *=~= /=~= %=~= &=~= |=~= ^=~= <<=~= >>=~= ==~o !=~o <=~o >=~o &&~g ||~| /~o %~o ^~o <~< >~> ->~w =>~a ?~q :~c ::~: ..~x ..=~x ...~x !~! #~# @~@ $~$")
    | _BRACKETS
)


def _rust() -> Grammar:
    ty = "(?:[mguilPLnrFCI]|:|<|>|w|=|q|c)+?"
    attr = "(?:#!?L)*"
    path = "(?:i(?::(?:i|<>))*)"
    mac = f"(?:{path}!i?[PLOMB])"
    block = "[BM]"
    prim = f"(?:{mac}|{path}[OM]|{path}|[nsPL]|{block}|K?e?{block})"
    post = "(?:\\.[in]|\\.a|P|L|q)"
    closure = "(?:u?\\|(?:[mguil,cPLns:|<>]*\\|)?(?:w[mgiPL:]+(?=[BM]))?)"
    one = f"(?:(?:[mgu!]|u)*(?:{closure})*(?:[mgu!])*{prim}{post}*(?:A[mgui:]+)*)"
    pat = "(?:[mgu|iLPOMns:x.!@]|,(?!$))+?"
    simple = f"(?:x?{one}(?:(?:[om g|<>=x]|<<|>>){one})*x?|x)".replace(" ", "")
    chain = f"(?:(?:D{pat}=)?{simple}(?:g(?:D{pat}=)?{simple})*)"
    branch = f"(?:K{chain}?{block}(?:eK{chain}{block})*(?:e{block})?|(?:lc)?(?:e|K{chain})[BMO]|r{pat}b{simple}{block}|a?u?e?{block})"
    value = f"(?:(?:{simple}[=omg|<>])?[mu]*(?:{branch})(?:{post})*(?:[omg=]{simple})*|{simple})"
    e = f"(?:R?l?{value}|Rl?)"
    vis = "(?:vP?)?"
    fn = f"(?:{vis}(?:C|a|e|Us?)*Fi(?:<>)?P(?:w{ty})?(?:W.+?)?(?:[BM]|;))"
    item = (
        f"(?:{fn}|{vis}Ti(?:<>)?(?:c.+?)?(?:P;|[BOM]|;|W.+?[BOM])|{vis}Y?T?i;|e?I(?:<>)?!?{ty}(?:W.+?)?[BM]|{vis}U(?:i|:|A|\\*|m|[OM]|s)+;|{vis}UiA?i?;|{vis}Ys?i(?:<>)?(?:c[^=]+)?(?:={ty})?;"
        f"|{vis}Cu?ic{ty}=?{value}?;|{vis}Cu?ic{ty};|Us?[BM]|{mac};?|i!i?[BOM])"
    )
    let = f"(?:D{pat}(?:c{ty})?(?:={e}(?:e{block})?)?;)"
    stmt = f"(?:{attr}(?:;|{item}|{let}|{e};|{branch}|{mac};?))"
    arm = f"(?:{attr}\\|?{pat}(?:K{simple})?a(?:{e},?|[BM],?))"
    fld = f"(?:{attr}{vis}[in](?:c(?:{e}|{ty}))?|x{simple}?)"
    variant = f"(?:{attr}i(?:[POM])?(?:=m?n)?)"
    use = "(?:(?:i|:|A|m|[OM])+(?:,(?:i|:|A|m|[OM])+)*,?)"
    fields = f"(?:(?:{fld}(?:,{fld})*,?)?|(?:{variant}(?:,{variant})*,?)|(?:{arm})+|{use})"
    paren = f"(?:(?:(?:{e}|{pat})(?:,(?:{e}|{pat}))*,?)?|(?:{attr}(?:[mgul]*i|{pat})(?:c{ty})?)(?:,{attr}(?:{pat})(?:c{ty})?)*,?|(?:{vis}{ty})(?:,{vis}{ty})*,?|bi(?::i)*)"
    square = f"(?:(?:{e}(?:,{e})*,?)?|{e};{e}|{ty};{e}|{ty}|i(?::i)*(?:P|=[ns])?)"
    return Grammar(
        token=_RUST_TOKEN, words=_RUST_WORDS, stmt=stmt, last=f"(?:{attr}{e})", fields=fields, paren=paren, square=square, goes_on=r"e.,;qP=omg|A",
        late=[(r"(?<=[iFI:Y])<(?:[mguilPLn:=,rcCwD]|<>)*>", "<>"), (r"(?<=[iI:F])<>", ""), (r"<(?:[mguilPLn:=,rcCwD])*>(?=:|i)", "i")] * 2,
    )


# --- Go -------------------------------------------------------------------------------------------
_GO_TOKEN = (
    r"[ \t\r\f\v]+|//[^\n]*|/\*[\s\S]*?\*/|\n\s*|`[^`]*`|\"(?:\\[^\n]|[^\"\\\n])*\"|'(?:\\[^\n]{1,9}?|[^\\'\n])'"
    + rf"|(?:{_NUM})i?(?!\w)|{_NAME}|<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|&\^|[-+*/%&|^]=|[\s\S]"
)
_GO_WORDS = (
    _words(K="if switch", G="for select", e="else", R="return", Z="break continue goto fallthrough", F="func", V="var const", Y="type", S="struct interface", H="map chan", J="import package", k="case", d="default", g="go defer", r="range")
    | _signs("+~m -~m *~m &~m ^~m <-~m |~o =~= :=~= +=~= -=~= *=~= /=~= %=~= &=~= |=~= ^=~= <<=~= >>=~= &^=~= ==~o !=~o <=~o >=~o &&~o ||~o /~o %~o <<~o >>~o &^~o <~o >~o ++~p --~p :~c ...~x !~u ~~m")
    | _BRACKETS
)


def _go() -> Grammar:
    ty = "(?:(?:m|L|H|x|F|P)*(?:i(?:\\.i)?L?|SB|SO|SM|P))"
    sig = f"P(?:{ty}|P)?"
    prim = f"(?:[ins](?:\\.i)*[OM]|(?:L|HL)?{ty}[OM]|[insPL]|F{sig}[BM]|HLi|{ty}P)"
    post = "(?:\\.[iPY]|\\.P|P|L)"
    one = f"(?:[mu]*{prim}{post}*)"
    e = f"(?:{one}(?:[om]{one})*)"
    es = f"(?:{e}(?:,{e})*)"
    simple = f"(?:{es}(?:=(?:r?{e}|{es}))?|{e}p|r{e})"
    ctl = f"(?:K(?:{simple}?h)?{simple}?[BM](?:eK(?:{simple}h)?{simple}?[BM])*(?:e[BM])?|G(?:{simple}?(?:h{simple}?h{simple}?)?)?[BM])"
    var = f"(?:(?:i(?:,i)*)(?:{ty})?(?:={es})?)"
    spec = f"(?:iL?=?{ty})"
    stmt = (
        f"(?:(?:k(?:{es}|{ty}(?:,{ty})*|{simple})|d)c?(?:{simple})?;?|(?:ic)*(?:;|[BM];?|{ctl};|{simple};|R{es}?;|Zi?;|g{e};|V(?:{var}|P);|Y(?:{spec}|P);|J(?:i?s|i|\\.s|P);"
        f"|FP?iL?{sig};|F(?:P)?iL?P(?:{ty}|P)?[BM];))"
    )
    kv = f"(?:(?:{e}|[OM])(?:c(?:{e}|[OM]))?)"
    fieldline = f"(?:(?:i(?:,i)*{ty}|m?i(?:\\.i)?|i{sig}|{ty}(?:o{ty})*)s?;)"
    fields = f"(?:(?:{kv}(?:,{kv})*,?;?)?|(?:{fieldline})*)"
    par = f"(?:(?:i|i(?:,i)*)?x?{ty}|i)"
    paren = f"(?:(?:(?:{e}|{ty})(?:,(?:{e}|{ty}))*x?,?;?)?|{par}(?:,{par})*,?;?|(?:(?:i?s|\\.s);)*|(?:{var};)*|(?:{spec};)*|Y)"
    square = f"(?:{e}?(?:c{e}?)*|x|{ty}(?:,{ty})*|(?:i(?:,i)*{ty})(?:,i(?:,i)*{ty})*)"
    return Grammar(token=_GO_TOKEN, words=_GO_WORDS, stmt=stmt, last=f"(?:{stmt[:-1]}|{simple}|R{es}?|Zi?|g{e}|{ctl})|V{var}|J(?:i?s|i|P)|FP?iL?P(?:{ty}|P)?[BM])", fields=fields, paren=paren, square=square, goes_on=r"e.,;=omPLpcis", late=[(r"(G[^;BOM]*);([^;BOM]*);(?=[^;BOM]*[BM])", r"\1h\2h"), (r"([KG][^;BOM]*);(?=[^;BOM]*[BM])", r"\1h")], newline="insPLBOMRZp)]}")


# --- C# -------------------------------------------------------------------------------------------
_CS_TOKEN = (
    _SKIP
    + r"|^[ \t]*#[^\n]*|\$*\"\"\"[\s\S]*?\"\"\"|(?:\$@|@\$|@)\"(?:\"\"|[^\"])*\"|\$?\"(?:\\[^\n]|[^\"\\\n])*\"|'(?:\\[^\n]{1,9}?|[^\\'\n])'"
    + rf"|(?:{_NUM})(?:[uUlLfFdDmM]{{0,2}})(?!\w)|@?{_NAME}|>>>=|<<=|>>=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\?\[|\+\+|--|::|->|\.\.|[-+*/%&|^]=|[\s\S]"
)
_CS_WORDS = (
    _words(K="if while switch for foreach lock using fixed catch when", e="else do try finally unsafe checked unchecked", R="return throw yield", Z="break continue goto", N="namespace", C="class struct interface enum record", a="public private protected internal static readonly const abstract virtual override sealed async partial extern volatile new ref out in params this required file event delegate operator implicit explicit", u="await typeof sizeof nameof stackalloc", b="is as and or not with", k="case", d="default", W="where")
    | _signs("+~m -~m *~m &~m =~= +=~= -=~= *=~= /=~= %=~= &=~= |=~= ^=~= <<=~= >>=~= >>>=~= ??=~= ==~o !=~o <=~o >=~o &&~o ||~o ??~o /~o %~o |~o ^~o <~< >~> ++~p --~p =>~w ?~q :~c ?.~. ::~. ->~. ..~o !~u ~~u")
    | _BRACKETS
)


def _csharp() -> Grammar:
    name = "(?:i(?:\\.i)*)"
    ty = f"(?:(?:{name}|P)(?:q|L|m)*)"
    prim = f"(?:a(?:{name})?(?:[PL])*[OMB]?|[insPLud]|a|[OM])"
    post = "(?:\\.i|P|L|p|u(?=[.;,)PL]|$)|q(?=\\.|L))"
    heads = "(?:a?a?(?:P|i)w)"
    one = f"(?:[ump]*+(?:{heads}+[BM]|(?:{heads}+[um]*+)?{prim}{post}*(?:b[a-z]*(?:{ty}|[nsOM])?i?)*))"
    e = f"(?:{one}(?:[om<>=qc]{one})*(?:K[OMB])?)"
    es = f"(?:{e}(?:,{e})*)"
    attr = "(?:L)*"
    var = f"(?:a*(?:K)?{ty}i(?:={e})?(?:,i(?:={e})?)*)"
    ctl = "(?:uK?|KP|Ke?P|e|ic|aKP|(?:k{e}|k{t}i?|d)c)".replace("{e}", e).replace("{t}", ty)
    base = f"(?:P?(?:c{ty}P?(?:,{ty})*)?(?:Wic[\\w.,]+)*)"
    method = f"(?:{attr}a*(?:{ty})?(?:{name}|u i)(?:P)(?:c[a]P)?(?:Wic[\\w.,]+)*(?:[BM]|w{e};|;))".replace(" ", "")
    prop = f"(?:{attr}a*{ty}(?:{name}|aL)(?:[BOM](?:={e};)?|w{e};))"
    item = f"(?:{attr}a*C[iC]?i?{base}(?:[BOM];?|;)|N{name}(?:[BM]|;)|(?:a?)K(?:a)?(?:i=)?{name};|{method}|{prop}|{attr}{var};|a+{ty}iP;)"
    stmt = f"(?:(?:{ctl})*(?:;|[BM]|{item}|{es};|R(?:{es}|Z|R)?;|R?Z(?:i|k{e}|d)?;|{var};|R?R?{es}?;|e[BM]KP;))"
    arm = f"(?:(?:{e}|{ty}i?)(?:K{e})?w{e})"
    enumv = f"(?:{attr}i(?:={e})?)"
    acc = f"(?:{attr}a*i(?:;|[BM]|w{e};))"
    fields = f"(?:(?:{acc})+|(?:{enumv}(?:,{enumv})*,?)?|(?:{e}(?:,{e})*,?)|(?:{arm})(?:,{arm})*,?)"
    par = f"(?:{attr}a*{ty}i(?:={e})?)"
    arg = f"(?:(?:ic)?a*(?:{e}|{ty}i))"
    paren = f"(?:(?:{arg}(?:,{arg})*)?|{par}(?:,{par})*|(?:{var}|{es})?;{es}?;{es}?|a?{ty}ia{e}|{ty}i?|P)"
    square = f"(?:,*|(?:x?{e})(?:,{e})*|{e}?o{e}?|(?:ic)?{name}P?(?:,{name}P?)*)"
    return Grammar(
        token=_CS_TOKEN, words=_CS_WORDS, stmt=stmt, last=f"(?:{es})", fields=fields, paren=paren, square=square, goes_on=r".,;=omqcP",
        late=[(r"(?<=i)<(?:[imqLP.a]|,(?=[iP])|<>)*>(?=[iPLBOM.;,>q)(wu=cW]|$)", "")] * 3,
    )


# --- JSON -----------------------------------------------------------------------------------------
_JSON_TOKEN = r"[ \t\r\n]+|\"(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})|[^\"\\\x00-\x1f])*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z_]\w*|[\s\S]"
_JSON = Grammar(
    token=_JSON_TOKEN, words={"true": "i", "false": "i", "null": "i", ":": "c", **{b: b for b in "[]{},"}}, stmt="(?:[insLO])", last="(?:[insLO])", fields="(?:(?:sc[insLO](?:,sc[insLO])*)?)",
    paren="(?!)", square="(?:(?:[insLO](?:,[insLO])*)?)", goes_on="c",
)

GRAMMARS = {"js": _javascript(False), "ts": _javascript(True), "rs": _rust(), "go": _go(), "cs": _csharp(), "json": _JSON}
