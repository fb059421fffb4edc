"""Office math to LaTeX: a small recursive helper for the document reader."""

from __future__ import annotations

import unicodedata

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
# LaTeX of operators, accents and functions.
SIGNS = {
    "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∐": r"\coprod", "⋃": r"\bigcup", "⋂": r"\bigcap",
    "⋁": r"\bigvee", "⋀": r"\bigwedge", "→": r"\to", "←": r"\leftarrow", "⇒": r"\Rightarrow", "⇔": r"\Leftrightarrow", "∞": r"\infty", "≤": r"\leq",
    "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "±": r"\pm", "×": r"\times", "÷": r"\div", "⋅": r"\cdot", "∈": r"\in", "∉": r"\notin",
    "⊂": r"\subset", "⊆": r"\subseteq", "∪": r"\cup", "∩": r"\cap", "∂": r"\partial", "∇": r"\nabla", "∀": r"\forall", "∃": r"\exists", "¬": r"\neg",
    "∧": r"\wedge", "∨": r"\vee", "…": r"\ldots", "⋯": r"\cdots", "∅": r"\emptyset", "√": r"\surd", "′": "'",
}
ACCENTS = {"\u0300": "grave", "\u0301": "acute", "\u0302": "hat", "\u0303": "tilde", "\u0304": "bar", "\u0305": "overline", "\u0306": "breve", "\u0307": "dot", "\u0308": "ddot", "\u030c": "check", "\u20d7": "vec", "→": "vec"}
FUNCTIONS = set("sin cos tan cot sec csc sinh cosh tanh coth arcsin arccos arctan log ln exp lim max min sup inf det gcd arg deg dim ker".split())
FENCES = {"{": r"\{", "}": r"\}", "⟨": r"\langle", "⟩": r"\rangle", "‖": r"\|", "⌊": r"\lfloor", "⌋": r"\rfloor", "⌈": r"\lceil", "⌉": r"\rceil", "": "."}


def sign(c: str) -> str:
    """A character in math: known operators, Greek letters by their Unicode name, LaTeX specials escaped."""
    if c in SIGNS:
        return SIGNS[c] + (" " if SIGNS[c][-1].isalpha() else "")
    base = unicodedata.normalize("NFKC", c)
    name = unicodedata.name(base, "") if len(base) == 1 else ""
    for kind, change in (("GREEK SMALL LETTER ", str.lower), ("GREEK CAPITAL LETTER ", str.capitalize)):
        word = name.removeprefix(kind)
        if word != name and word.isalpha():
            return "\\" + change(word.replace("LAMDA", "LAMBDA")) + " "
    return "\\" + base if base in "#$%&_{}" else base


def latex(node) -> str:
    """LaTeX of a math element and all below it; unknown elements give what their children give."""
    tag = node.tag.removeprefix(M)
    get = lambda name: latex(child) if (child := node.find(M + name)) is not None else ""

    def prop(name: str, default: str) -> str:
        value = node.find(f"{M}{tag}Pr/{M}{name}")
        return default if value is None else value.get(f"{M}val", default)

    def rows(name: str) -> list:
        return node.findall(M + name)

    if tag == "t":
        return "".join(map(sign, node.text or ""))
    if tag == "f":
        kind = prop("type", "bar")
        if kind in ("lin", "skw"):
            return f"{get('num')}/{get('den')}"
        return rf"\frac{{{get('num')}}}{{{get('den')}}}" if kind == "bar" else rf"\genfrac{{}}{{}}{{0pt}}{{}}{{{get('num')}}}{{{get('den')}}}"
    if tag == "rad":
        degree = get("deg")
        return rf"\sqrt[{degree}]{{{get('e')}}}" if degree else rf"\sqrt{{{get('e')}}}"
    if tag in ("sSub", "sSup", "sSubSup"):
        return get("e") + (f"_{{{get('sub')}}}" if "Sub" in tag else "") + (f"^{{{get('sup')}}}" if tag != "sSub" else "")
    if tag == "sPre":
        return f"{{}}_{{{get('sub')}}}^{{{get('sup')}}}{get('e')}"
    if tag == "nary":
        low, high, c = get("sub"), get("sup"), prop("chr", "∫")
        return SIGNS.get(c, c) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{get('e')}}}"
    if tag == "d":
        left, right = (FENCES.get(c, c) for c in (prop("begChr", "("), prop("endChr", ")")))
        return rf"\left{left}{prop('sepChr', '|').join(latex(e) for e in rows('e'))}\right{right}"
    if tag == "acc":
        return rf"\{ACCENTS.get(prop('chr', chr(0x302)), 'hat')}{{{get('e')}}}"
    if tag == "bar":
        return rf"\{'overline' if prop('pos', 'bot') == 'top' else 'underline'}{{{get('e')}}}"
    if tag == "groupChr":
        return rf"\{'overbrace' if prop('pos', 'bot') == 'top' else 'underbrace'}{{{get('e')}}}"
    if tag == "func":
        name = get("fName").strip()
        return ("\\" + name if name in FUNCTIONS else name) + f"{{{get('e')}}}"
    if tag in ("limLow", "limUpp"):
        base, limit = get("e").strip(), get("lim")
        if tag == "limLow":
            return ("\\" + base if base in FUNCTIONS else rf"\mathop{{{base}}}\limits") + f"_{{{limit}}}"
        return rf"\overset{{{limit}}}{{{base}}}"
    if tag == "eqArr":
        return r"\begin{array}{c}" + r"\\".join(latex(e) for e in rows("e")) + r"\end{array}"
    if tag == "m":
        return r"\begin{matrix}" + r"\\".join("&".join(latex(e) for e in r.findall(M + "e")) for r in rows("mr")) + r"\end{matrix}"
    return "" if tag.endswith("Pr") else "".join(map(latex, node))
