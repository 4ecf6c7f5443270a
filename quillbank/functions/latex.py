"""LaTeX in texts: tokens, formula trees, Office math, and texts that mix CJK and formulas.

A formula is a list of nodes, plain tuples whose first item is the kind:

    ("run", text)                          ("frac", numerator, denominator)
    ("sup", base, upper)                   ("sub", base, lower)
    ("subsup", base, lower, upper)         ("rad", body, degree or None)
    ("nary", sign, body, lower, upper)     ("lim", name, lower)

Reading never fails: unknown commands turn into their names, and what can't be placed is
kept as text. Two deviations from the older behaviour keep formulas whole: ``\\left.``
and delimiters that are commands no longer end the sequence, and a stray ``}`` at the
top of a formula is dropped instead of ending it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# What commands stand for.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "omicron": "ο", "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ",
    "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
SYMBOLS = {
    "times": "×", "div": "÷", "cdot": "·", "ast": "∗", "star": "⋆", "pm": "±", "mp": "∓", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠",
    "approx": "≈", "equiv": "≡", "sim": "∼", "cong": "≅", "propto": "∝", "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃",
    "in": "∈", "notin": "∉", "ni": "∋", "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "cup": "∪", "cap": "∩", "emptyset": "∅", "varnothing": "∅",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐", "leftrightarrow": "↔", "Leftrightarrow": "⇔", "mapsto": "↦",
    "ldots": "…", "dots": "…", "cdots": "⋯", "angle": "∠", "perp": "⊥", "parallel": "∥", "circ": "∘", "prime": "′", "neg": "¬", "wedge": "∧", "vee": "∨",
    "oplus": "⊕", "otimes": "⊗", "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "prod": "∏", "oint": "∮", "sqrt": "√",
    "because": "∵", "therefore": "∴", "degree": "°", "backslash": "\\", "percent": "%",
}
FUNCTION_NAMES = {
    "sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "coth", "log", "ln", "lg", "exp",
    "det", "dim", "ker", "deg", "gcd", "hom", "max", "min", "sup", "inf", "arg", "mod",
}
ACCENTS = {
    "vec": "⃗", "hat": "̂", "widehat": "̂", "bar": "̅", "overline": "̅", "dot": "̇", "ddot": "̈",
    "tilde": "̃", "widetilde": "̃", "check": "̌", "acute": "́", "grave": "̀",
}
TEXT_WRAPPERS = {"text", "mathrm", "mathbf", "mathit", "operatorname", "mbox"}
FRACTIONS = {"frac", "dfrac", "tfrac"}
NARY = {"sum": "∑", "int": "∫"}
CJK = re.compile("[⺀-鿿　-〿＀-￯㐀-䶿]")
EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿\U0001f000-\U0001f0ff\U0001f1e6-\U0001f1ff️]")
CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

_TOKEN = re.compile(r"\\(?P<command>[A-Za-z]+)|(?P<space>\\[,;! :>]|[ \t])|\\(?P<escaped>.?)|(?P<lbrace>\{)|(?P<rbrace>\})|(?P<sup>\^)|(?P<sub>_)|(?P<char>.)", re.S)
_DELIMITED = re.compile(r"\$\$(.+?)\$\$|\$([^$\n]+?)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)

Token = tuple[str, str]


def tokens(text: str) -> list[Token]:
    """(type, value): command, char, space, lbrace, rbrace, sup, sub. An escaped character is a char."""
    found = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "escaped":
            found.append(("char", m["escaped"]))
        else:
            found.append((kind, {"command": m["command"], "char": m["char"], "space": " "}.get(kind, "")))
    return found


def strip_unsafe(text: str) -> str:
    return CONTROLS.sub("", EMOJI.sub("", text))


def spelled(token: Token) -> str:
    kind, value = token
    if kind == "command":
        return GREEK.get(value) or SYMBOLS.get(value) or value
    return value if kind in ("char", "space") else ""


def run(text: str) -> tuple:
    return ("run", text or " ")


class Reader:
    """One pass over tokens. ``in_text``: stop before CJK characters, and before spaces that lead to them or to the end."""

    def __init__(self, found: list[Token], in_text: bool = False):
        self.found, self.at, self.in_text = found, 0, in_text

    def peek(self) -> str:
        return self.found[self.at][0] if self.at < len(self.found) else "end"

    def take(self) -> Token:
        self.at += 1
        return self.found[self.at - 1]

    def leaves_formula(self) -> bool:
        ahead = self.at
        while ahead < len(self.found) and self.found[ahead][0] == "space":
            ahead += 1
        if ahead == len(self.found):
            return True
        kind, value = self.found[ahead]
        return kind == "char" and bool(CJK.match(value))

    def sequence(self, inside: bool = False) -> list:
        """Nodes up to the closing brace (inside a group) or to the end of the formula."""
        nodes: list = []
        while (kind := self.peek()) != "end":
            if kind == "rbrace":
                if inside or self.in_text:
                    break
                self.take()  # stray
                continue
            if not inside and self.in_text and self.leaves_formula():
                break
            nodes += self.scripted()
        return nodes

    def group(self) -> list:
        self.take()
        nodes = self.sequence(inside=True)
        if self.peek() == "rbrace":
            self.take()
        return nodes

    def argument(self) -> list:
        """A group or one atom; a space if there is none."""
        if self.peek() == "end":
            return [run(" ")]
        return (self.group() if self.peek() == "lbrace" else self.atom()) or [run(" ")]

    def scripts(self) -> dict[str, list]:
        found = {}
        while self.peek() in ("sup", "sub"):
            kind, _ = self.take()
            found[kind] = self.argument()
        return found

    def scripted(self) -> list:
        base = self.atom()
        if self.peek() not in ("sup", "sub"):
            return base
        scripts = self.scripts()
        if len(scripts) == 2:
            return [("subsup", base, scripts["sub"], scripts["sup"])]
        (kind, script), *_ = scripts.items()
        return [(kind, base, script)]

    def atom(self) -> list:
        kind = self.peek()
        if kind in ("end", "rbrace"):
            return []
        if kind == "lbrace":
            return self.group()
        kind, value = self.take()
        if kind in ("sup", "sub"):
            return [run("^" if kind == "sup" else "_")]
        return self.command(value) if kind == "command" else [run(value)]

    def raw_argument(self) -> str:
        """The text of a group or of one token, for accents."""
        if self.peek() != "lbrace":
            return spelled(self.take()) if self.peek() != "end" else ""
        self.take()
        text = ""
        while self.peek() not in ("end", "rbrace"):
            text += spelled(self.take())
        if self.peek() == "rbrace":
            self.take()
        return text

    def degree(self) -> list | None:
        """The optional ``[n]`` of a root."""
        if self.peek() != "char" or self.found[self.at][1] != "[":
            return None
        self.take()
        inner = []
        while self.peek() != "end" and self.found[self.at] != ("char", "]"):
            inner.append(self.take())
        if self.peek() != "end":
            self.take()
        return Reader(inner).sequence() or None

    def command(self, name: str) -> list:
        if name in FRACTIONS:
            above = self.argument()
            return [("frac", above, self.argument())]
        if name == "sqrt":
            degree = self.degree()
            return [("rad", self.argument(), degree)]
        if name in NARY:
            scripts = self.scripts()
            while self.peek() == "space":
                self.take()
            return [("nary", NARY[name], self.scripted() or [run(" ")], scripts.get("sub"), scripts.get("sup"))]
        if name == "lim":
            if self.peek() != "sub":
                return [run("lim")]
            self.take()
            return [("lim", [run("lim")], self.argument())]
        if name in ACCENTS:
            return [run("".join(ch + ACCENTS[name] for ch in self.raw_argument()))]
        if name in ("left", "right"):
            if self.peek() not in ("char", "command", "lbrace", "rbrace"):
                return []
            sign = spelled(self.take())
            return [] if sign in (".", "") else [run(sign)]
        if name in TEXT_WRAPPERS:
            return self.argument()
        if name in FUNCTION_NAMES:
            return [run(name)]
        return [run(spelled(("command", name)))]


def parse(text: str) -> list:
    """The nodes of a formula; a formula without any is its own text."""
    return Reader(tokens(text)).sequence() or [run(strip_unsafe(text))]


def omml(nodes: list | None) -> str:
    """Office math markup of nodes."""
    return "".join(_node(n) for n in nodes or ())


def _part(tag: str, nodes: list | None) -> str:
    return f"<m:{tag}>{omml(nodes)}</m:{tag}>"


def _node(node: tuple) -> str:
    kind, *rest = node
    if kind == "run":
        return f'<m:r><m:t xml:space="preserve">{escape(rest[0])}</m:t></m:r>'
    if kind == "frac":
        return f"<m:f>{_part('num', rest[0])}{_part('den', rest[1])}</m:f>"
    if kind == "sup":
        return f"<m:sSup>{_part('e', rest[0])}{_part('sup', rest[1])}</m:sSup>"
    if kind == "sub":
        return f"<m:sSub>{_part('e', rest[0])}{_part('sub', rest[1])}</m:sSub>"
    if kind == "subsup":
        return f"<m:sSubSup>{_part('e', rest[0])}{_part('sub', rest[1])}{_part('sup', rest[2])}</m:sSubSup>"
    if kind == "rad":
        hide = "" if rest[1] else '<m:radPr><m:degHide m:val="1"/></m:radPr>'
        return f"<m:rad>{hide}{_part('deg', rest[1])}{_part('e', rest[0])}</m:rad>"
    if kind == "nary":
        sign, body, lower, upper = rest
        hidden = "".join(f'<m:{tag}Hide m:val="1"/>' for tag, part in (("sub", lower), ("sup", upper)) if not part)
        return f'<m:nary><m:naryPr><m:chr m:val="{sign}"/>{hidden}</m:naryPr>{_part("sub", lower)}{_part("sup", upper)}{_part("e", body)}</m:nary>'
    return f"<m:limLow>{_part('e', rest[0])}{_part('lim', rest[1])}</m:limLow>"


def _mixed(text: str) -> Iterator[tuple[str, object]]:
    """Text outside of delimiters: ("text", str) and ("math", nodes). A command or group opens a formula, and so does a script, which takes the character before it as its base."""
    found, at, plain = tokens(text), 0, ""
    while at < len(found):
        kind, _ = found[at]
        base = re.search(r"([A-Za-z0-9)\]}])\s*$", plain) if kind in ("sup", "sub") else None
        if kind in ("command", "lbrace") or base:
            lead = [("char", base[1])] if base else []
            reader = Reader(lead + found[at:], in_text=True)
            nodes = reader.sequence()
            if nodes and reader.at > len(lead):
                before = plain[: base.start()] if base else plain
                if before:
                    yield "text", before
                plain, at = "", at + reader.at - len(lead)
                yield "math", nodes
                continue
        plain += {"sup": "^", "sub": "_", "rbrace": "}"}.get(kind) or (found[at][1] if kind == "command" else spelled(found[at]))
        at += 1
    if plain:
        yield "text", plain


def components(text: str | None) -> list[tuple[str, str | None, str | None]]:
    """(kind, text, xml) of a paragraph: text, math and break. Delimiters are looked for line by line."""
    out: list[tuple[str, str | None, str | None]] = []

    def put(parts):
        for kind, value in parts:
            out.append(("text", value, None) if kind == "text" else ("math", None, omml(value)))

    if not text:
        return out
    for n, line in enumerate(re.split("\r\n|\r|\n", strip_unsafe(text))):
        if n:
            out.append(("break", None, None))
        done = 0
        for m in _DELIMITED.finditer(line):
            put(_mixed(line[done : m.start()]))
            put([("math", parse(next(g for g in m.groups() if g is not None)))])
            done = m.end()
        put(_mixed(line[done:]))
    return out


# Types as objects: this module is imported where there is no session yet.
COMPONENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("xml", T.StringType())]))
TOKEN = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])


@F.pandas_udf(T.StringType())
def parse_latex(column):
    """Office math of formulas, in Arrow batches; equal texts of a batch are read once."""
    import pandas as pd

    known = {t: omml(parse(t)) for t in column.dropna().unique()}
    return pd.Series([known.get(t) if isinstance(t, str) else None for t in column], dtype=object)


@F.pandas_udf(COMPONENTS)
def render_mixed(column):
    """Paragraph components of texts, in Arrow batches."""
    import pandas as pd

    known = {t: [{"kind": k, "text": x, "xml": m} for k, x, m in components(t)] for t in column.dropna().unique()}
    return pd.Series([known[t] if isinstance(t, str) else [] for t in column], dtype=object)


@F.pandas_udf(T.BooleanType())
def converts(column):
    """Whether a text can be turned into paragraph components."""

    import pandas as pd

    def sound(t):
        try:
            components(t if isinstance(t, str) else None)
        except Exception:  # noqa: BLE001  any failure is the finding
            return False
        return True

    return pd.Series([sound(t) for t in column], dtype=bool)


@udtf(returnType=TOKEN)
class Tokenize:
    """Rows of (pos, type, value): ``SELECT * FROM tokenize('x^2')`` once registered."""

    def eval(self, text: str):
        for pos, (kind, value) in enumerate(tokens(text or "")):
            yield pos, kind, value


def register(spark) -> None:
    spark.udtf.register("tokenize", Tokenize)


def render(c: Column) -> Column:
    return render_mixed(c)
